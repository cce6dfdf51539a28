"""Filtered retrieval over chunks with vectors, its evaluation, and the text of row documents."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from html.parser import HTMLParser
from unicodedata import combining, normalize

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seawake.functions import text
from seawake.operators import fuzzy
from seawake.session import kept

#: Pages whose visible texts a worker holds at once.
PAGES = 64
# Words that route a question to documents or to traffic.
DOCUMENT_WORDS = "regulation policy guideline guidance document report procedure definition convention".split()
TRAFFIC_WORDS = "vessel vessels arrival arrivals port ship ships mmsi dwell congestion traffic position jump".split()


def matching(chunks: DataFrame, equal: dict[str, object] | None = None, start: str | None = None, end: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Chunks whose fields equal the given values, within dates and a bounding box; nulls match nothing."""
    for k, v in (equal or {}).items():
        chunks = chunks.filter(F.col(k) == v)
    if start:
        chunks = chunks.filter(F.col("date") >= start)
    if end:
        chunks = chunks.filter(F.col("date") <= end)
    if box:
        s, n, w, e = box
        chunks = chunks.filter(F.col("latitude").between(s, n) & F.col("longitude").between(w, e))
    return chunks


def chosen(chunks: DataFrame, port: str | None = None, vessel_type: str | None = None, anomaly: bool | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Chunks (port, locode, vessel_type, anomaly, date) that fit what a user gave: a port equal to name or code, or part of
    the name; a type in any case, `all` for every one; days from start to end, without a day none."""
    if port:
        p = port.strip().upper().replace(" ", "")
        name = F.upper(F.coalesce("port", F.lit("")))
        tight = lambda c: F.replace(F.upper(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
        chunks = chunks.filter((tight("port") == p) | (tight("locode") == p) | name.contains(p))
    kind = (vessel_type or "").strip().lower()
    if kind and kind != "all":
        chunks = chunks.filter(F.lower(F.coalesce("vessel_type", F.lit(""))) == kind)
    if anomaly is not None:
        chunks = chunks.filter(F.coalesce("anomaly", F.lit(False)) == anomaly)
    return matching(chunks, start=start, end=end)


def counted(chunks: DataFrame, key: str, ids: int = 200) -> DataFrame:
    """How many match, and the first ids of them."""
    first = chunks.orderBy(key).limit(ids).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("first_ids"))
    return chunks.agg(F.count("*").alias("n")).crossJoin(first)  # one row with one row


def hit_rate(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Per strategy: the share of questions with an expected id among the first k, and mean latency."""
    top = results.filter(F.col("rank") <= k).join(expected.withColumn("hit", F.lit(1)), ["question", "id"], "left")
    per = top.groupBy("strategy", "question").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"), F.max("latency_ms").alias("latency_ms"))
    return per.groupBy("strategy").agg(F.avg("hit").alias("hit_at_k"), F.avg("latency_ms").alias("latency_ms"), F.count("*").alias("questions"))


def grounding(answers: DataFrame) -> DataFrame:
    """Per answer: the share of question words its evidence has, and whether it names what the evidence lacks."""
    q, a, e = (text.tokens(F.col(c)) for c in ("question", "answer", "evidence"))
    return answers.withColumn("relevance", text.overlap_share(q, e)).withColumn("hallucinated", text.novel(a, e))


def routed(questions: DataFrame) -> DataFrame:
    """`docs`, `traffic` or `both` by the words of a question."""
    words = text.tokens(F.col("question"))
    has = lambda ws: F.arrays_overlap(words, F.array(*map(F.lit, ws)))
    return questions.withColumn("route", F.when(has(DOCUMENT_WORDS) & ~has(TRAFFIC_WORDS), "docs").when(has(TRAFFIC_WORDS) & ~has(DOCUMENT_WORDS), "traffic").otherwise("both"))


def chunked(docs: DataFrame, column: str, key: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Overlapping slices of a text, with ids."""
    out = docs.select(key, F.posexplode(text.chunk_texts(F.col(column), size, overlap)).alias("chunk_index", "chunk"))
    return out.withColumn("id", F.concat_ws("_", F.col(key).cast("string"), F.col("chunk_index").cast("string")))


def position_sentences(positions: DataFrame) -> DataFrame:
    """A sentence per position row."""
    said = F.format_string("Vessel %s (%s) reported %.3f kn at %.5f, %.5f on %s, bound for %s.", "mmsi", "vessel_type_norm", "speed", "latitude", "longitude", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "destination_raw")
    return positions.select("position_id", said.alias("text"))


class _Visible(HTMLParser):
    HIDDEN = frozenset(("script", "style", "noscript", "header", "footer"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN and self.depth:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.parts.append(data)


def visible_text(page: str | None) -> str:
    """All text of a page but scripts, styles, header and footer, with single spaces."""
    parser = _Visible()
    parser.feed(page or "")
    parser.close()
    return " ".join(" ".join(parser.parts).split())


def web_chunks(pages: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Chunks of the visible text of pages. A worker holds a batch of pages as it came and the texts of a few of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in (batch.slice(i, PAGES) for i in range(0, len(batch), PAGES)):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([visible_text(page.as_py()) for page in part.column(1)], pa.string())], ["page_id", "visible"])
        finally:  # workers live on for other tasks
            gc.collect()
            pa.default_memory_pool().release_unused()

    kind = T.StructType([pages.schema["page_id"], T.StructField("visible", T.StringType())])
    return chunked(pages.select("page_id", "html").mapInArrow(task, kind), "visible", "page_id", size, overlap)


def plain(name: str) -> str:
    """Lower case without accents and without `port of`."""
    base = "".join(c for c in normalize("NFKD", name or "") if not combining(c)).lower().strip()
    return base.removeprefix("port of ").strip()


def _plain(df: DataFrame, column: str, name: str) -> DataFrame:
    """`df` with the plain form of a column."""

    @F.pandas_udf("string")
    def made(c: pd.Series) -> pd.Series:
        return c.map(plain)

    return df.withColumn(name, made(column))


def resolve_ports(asked: DataFrame, catalog: DataFrame, least: float = 0.80) -> DataFrame:
    """(asked, port_key): the catalog port a name means: of the same key or name, else contained, else most similar; among
    equals the one with most arrivals, then the first key.

    Joins on keys, plain names and pairs of characters, so neither side has to be small.
    """
    names = _plain(asked.select("asked").filter("asked <> ''").distinct(), "asked", "a")
    ports = _plain(catalog.select("port_key", F.coalesce("port_label", F.lit("")).alias("port_label"), "arrivals_total"), "port_label", "b")
    shown = lambda df, tier, distance: df.select("asked", F.lit(tier).alias("tier"), distance.cast("double").alias("distance"), (-F.col("arrivals_total")).alias("arrivals"), "port_key")
    ports, names = kept(ports), kept(names)
    forms, labels = names.select("a").distinct(), ports.select("b").distinct()
    zero = F.lit(0.0)
    by_key = shown(names.withColumn("port_key", F.upper(F.trim("asked"))).join(ports, "port_key"), 0, zero)
    by_name = shown(names.join(ports, F.col("a") == F.col("b")), 1, zero)
    parts = shown(names.join(fuzzy.contained(forms, labels), "a").join(ports, "b"), 2, zero)
    like = shown(names.join(fuzzy.alike(forms, labels, least), "a").join(ports, "b"), 3, -F.col("ratio"))
    found = by_key.unionByName(by_name).unionByName(parts).unionByName(like)
    top = found.groupBy("asked").agg(F.min(F.struct("tier", "distance", "arrivals", "port_key")).alias("best"))
    return asked.select("asked").join(top, "asked", "left").select("asked", F.col("best.port_key").alias("port_key"))


def resolve_scopes(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per question of `candidates(question, place, source, token)`: the port that it is about.

    Tokens are tried by place (what the user chose, what was understood first, other places named, other words); the first
    that names a port of the catalog wins. Where none does, a port that the user chose stays as given (source `user_filter`),
    anything else is dropped. `correction` says which token was mapped or ignored, null where none was.
    """
    c = candidates.withColumn("token", F.trim("token")).filter("token <> ''")
    known = resolve_ports(c.select(F.col("token").alias("asked")).distinct(), catalog).withColumnRenamed("asked", "token")
    tried = c.join(known, "token", "left")
    at = F.struct("place", "token")
    per = tried.groupBy("question").agg(
        F.min_by("token", F.when(F.col("source").isin("user_filter", "entity_primary"), at)).alias("raw"), F.min_by("token", F.when(F.col("source") == "user_filter", at)).alias("chosen"),
        F.min_by(F.struct("port_key", "source"), F.when(F.col("port_key").isNotNull(), at)).alias("hit"), F.count("*").alias("tried"),
    )
    port = F.coalesce("hit.port_key", "chosen")
    note = F.when(F.col("raw").isNotNull() & port.isNotNull() & (F.col("raw") != port), F.concat(F.col("raw"), F.lit(" -> "), port)).when(F.col("raw").isNotNull() & port.isNull(), F.concat(F.col("raw"), F.lit(" ignored")))
    source = F.when(F.col("hit.port_key").isNotNull(), F.col("hit.source")).when(F.col("chosen").isNotNull(), "user_filter")
    return candidates.select("question").distinct().join(per, "question", "left").select("question", port.alias("port"), source.alias("source"), F.coalesce("tried", F.lit(0)).alias("tried"), note.alias("correction"))
