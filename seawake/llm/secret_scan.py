"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression yields a Boolean trigram query: the literal strings that any match must contain, as a
conjunction of alternatives. The index has a posting (trigram, document) for each trigram that some rule asks for and
that the lower-cased text contains. Intersecting the postings of a document gives the rules that can match there; only
those are verified on the text. A rule without a mandatory trigram (here the hex run) scans every text.

Spans are code points, end exclusive; matches are leftmost and non-overlapping within a rule, those with too short a
value are dropped afterwards. Null and empty texts have no spans; repeated rows each get their row; order is by start,
then by the order of the rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.llm.words import row_key


@dataclass(frozen=True)
class Rule:
    """A kind with its pattern; a match counts if its `group` has at least `least` characters. Case-blind text is fine:
    the trigram query is on lower case, the pattern decides."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 30),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 35),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: A rule whose only test is the length of a run of one class may ask for that length in the pattern: same spans.
_RUN = re.compile(r"^\[[^\]]+\]\+$")


def literals(pattern: str) -> list[set[str]]:
    """For each stretch of the pattern that can be spelled out, the lower-cased strings one of which a match contains."""
    clauses: list[set[str]] = []

    def spell(items: list) -> set[str]:
        """All strings of a sequence; where it cannot go on, what it has so far becomes a clause."""
        have = {""}
        for kind, value in items:
            name = str(kind)
            if name == "LITERAL":
                options = {chr(value).lower()}
            elif name == "IN" and all(str(k) == "LITERAL" for k, _ in value) and len(value) <= 5:
                options = {chr(v).lower() for _, v in value}
            elif name == "MAX_REPEAT" and value[:2] == (0, 1) and all(str(k) == "LITERAL" for k, _ in value[2]):
                options = {"", "".join(chr(v).lower() for _, v in value[2])}
            elif name == "SUBPATTERN":
                options = spell(list(value[3]))
            elif name == "BRANCH":
                before = len(clauses)
                options = {s for branch in value[1] for s in spell(list(branch))}
                del clauses[before:]  # what holds in one branch only is not mandatory
            else:
                clauses.append(have)
                have = {""}
                continue
            if len(have) * len(options) > 64:
                clauses.append(have)
                have = {""}
            have = {a + b for a, b in product(have, options)}
        return have

    clauses.append(spell(list(re._parser.parse(pattern))))
    return clauses


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of alternatives, each a set of trigrams that must all occur; empty if nothing is mandatory."""
    query = []
    for strings in literals(pattern):
        alternatives = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if frozenset() not in alternatives:
            query.append(sorted({a for a in alternatives if not any(b < a for b in alternatives)}, key=sorted))
    return query


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(trigram, key): the trigrams of the rules' queries that each text contains."""
    wanted = sorted({t for r in rules for clause in trigram_query(r.pattern) for a in clause for t in a})
    low = docs.select(row_key().alias("key"), F.lower("text").alias("low"))
    found = F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col("low"), t))
    return low.select("key", F.explode(found).alias("trigram")) if wanted else low.select("key", F.lit("").alias("trigram")).limit(0)


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): for each document the indexed rules whose trigram query its postings satisfy."""

    def holds(rule: Rule) -> Column:
        clauses = F.lit(True)
        for clause in trigram_query(rule.pattern):
            either = F.lit(False)
            for a in clause:
                every = F.lit(True)
                for t in sorted(a):
                    every = every & F.array_contains("grams", t)
                either = either | every
            clauses = clauses & either
        return clauses

    grams = index.groupBy("key").agg(F.collect_set("trigram").alias("grams"))
    hits = F.array_compact(F.array(*(F.when(holds(r), F.lit(r.kind)) for r in rules), F.lit(None).cast("string")))
    return grams.select("key", hits.alias("rules")).filter(F.size("rules") > 0)


def _spans(rule: Rule, order: int) -> Column:
    """The rule's spans in `text`: the lengths of what lies between the matches and of the matches give the places."""
    pattern = rule.pattern[:-1] + f"{{{rule.least},}}" if rule.group == 0 and _RUN.match(rule.pattern) else rule.pattern
    between = F.transform(F.split("text", pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(rule.group)), F.length) if rule.group else whole
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,ok:boolean>>").alias("out"))
    steps = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("n"), value.alias("v"))
    walked = F.aggregate(
        steps,
        start,
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["n"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), (x["v"] >= rule.least).alias("ok")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.transform(F.filter(walked, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document row: doc_id and `spans`, an array of (start, order, kind, end)."""
    indexed = tuple(r for r in rules if trigram_query(r.pattern))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("key"))
    hits = candidates(postings(docs, rules), indexed).withColumnRenamed("rules", "may")
    rows = texts.join(hits, "key", "left")
    found = [F.when(F.array_contains("may", r.kind), _spans(r, i)).otherwise(none) if r in indexed else _spans(r, i) for i, r in enumerate(rules)]
    return rows.select("doc_id", F.array_sort(F.concat(none, *found)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(n, BASE), F.sha2(shown(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same for DuckDB, scanning every text with every rule."""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT n, {i} AS k, '{r.kind}' AS kind, string_split_regex(text, '{p}') AS gap, "
            f"regexp_extract_all(text, '{p}', 0) AS whole, regexp_extract_all(text, '{p}', {r.group}) AS val, {r.least} AS least FROM d"
        )
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT n, k, kind, least, unnest(range(1, len(whole) + 1)) AS i, gap, whole, val FROM m WHERE len(whole) > 0),
s AS (SELECT n, k, kind, length(val[i]) >= least AS ok,
        list_sum(list_transform(gap[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s,
        length(whole[i]) AS len FROM e),
g AS (SELECT n, {counts},
        string_agg(kind || ':' || s || ':' || (s + len), ',' ORDER BY s, k) FILTER (WHERE kind IN ({base})) AS base,
        string_agg(kind || ':' || s || ':' || (s + len), ',' ORDER BY s, k) AS spans
      FROM s WHERE ok GROUP BY n)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)"""
