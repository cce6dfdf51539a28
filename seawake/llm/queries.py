"""The thin registered queries of the numbered operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.llm import bpe_dropout, conversation_trie, decontaminate, embedding_dedup, html_extract, jaccard_join, language_id, line_dedup, packing, quality, secret_scan, token_count, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.graded(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op9_bpe_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_dropout.round_trip(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(_table(spark, sf_dir, "embeddings")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(_table(spark, sf_dir, "documents"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_decontamination, op4_embedding_dedup, op5_html_extraction, op6_quality, op7_jaccard_join, op8_secret_scan, op9_bpe_dropout, op10_language_id, op11_whitening, op12_conversation_trie, op13_packing)}


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id,
        coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT item, least(10, len(w)) AS size, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM bw),
sizes AS (SELECT DISTINCT size FROM p),
dw AS (SELECT n, size, w, unnest(range(1, greatest(len(w) - size, -1) + 2)) AS i FROM d, sizes),
h AS (SELECT n, i, dw.size, item FROM dw JOIN p ON p.size = dw.size AND array_to_string(w[i:i + dw.size - 1], ' ') = phrase),
hit AS (SELECT n, count(DISTINCT pos) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS pos FROM h) GROUP BY n),
it AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM h) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (n) LEFT JOIN it USING (n)"""


#: The CRC-32 of the decimal id is said bit by bit.
OP12_SQL = r"""
WITH own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT conv_id, turns, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, i: xor(a >> 1, (a & 1) * 3988292384))), 4294967295) % 6 AS h FROM own),
re AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS p FROM c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
m AS (SELECT conv_id, len(p) AS n, p, unnest(range(0, len(p) + 1)) AS depth FROM re),
nodes AS (SELECT p[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM m GROUP BY ALL),
kids AS (SELECT k[1:depth - 1] AS k, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
w AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(length(nodes.k[-1].t), 0) AS saved FROM nodes LEFT JOIN kids USING (k, depth)),
up AS (SELECT *, unnest(range(0, depth + 1)) AS d FROM w),
sums AS (SELECT k[1:d] AS k, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN sums USING (k, depth) LEFT JOIN nodes p ON p.depth = w.depth - 1 AND p.k = w.k[1:w.depth - 1]"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op8_secret_scan": secret_scan.oracle_sql(), "op12_conversation_trie": OP12_SQL}
