"""Line deduplication by winnowing over line hashes.

A document is the sequence of its lines that are not blank, each trimmed and hashed. Fingerprints are hashes of `gram`
neighbouring lines: of every `window` neighbouring ones the least (the rightmost of equals), so a shared run of
`window + gram - 1` lines shares one for certain. A gram that holds a line of at least half of `min_words` is always a
fingerprint, and so is a single line of `min_words`; with the defaults every shared run of `min_words` words therefore
has one. Each fingerprint's first place (by doc_id, then text hash, then line) is joined to its later places; the match
is extended both ways, line by line, and a later run of at least `min_words` words is deleted with the blank lines in it.

The first place need not be the one with which a later place shares the most. So at fingerprints of three places or more
the later places also give their shortest runs of `min_words` words (each as short as its first or as its last line
allows) that hold the fingerprint and are not within the match just found. Two later places that share such a run both
give it, since the match of neither holds it; these runs are joined by their hashes, and all but the first are deleted.

Null texts stay null, empty texts empty; a text whose every line repeats becomes empty. A null doc_id comes first.
Repeated rows (same id, same text) are one document and do not delete each other's lines; rows that share only the id
are two documents. Lines longer than the rest need no special care: a line is one hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.words import U64, cut, mix, parts, row_key, tidy

#: Rows that a task takes apart at once.
PART = 1000

SEQUENCE = "hashes array<long>, words array<int>, at array<int>, prints array<struct<print:long,pos:int>>"


def sequence(text: str | None) -> tuple[np.ndarray, list[int], list[int]]:
    """Hash, number of words and line number of each line that is not blank."""
    hashes, words, at = [], [], []
    for i, line in enumerate((text or "").split("\n")):
        if line := line.strip():
            hashes.append(xxhash.xxh64_intdigest(line))
            words.append(len(line.split()))
            at.append(i)
    return np.array(hashes, U64), words, at


def fingerprints(hashes: np.ndarray, words: list[int], gram: int, window: int, min_words: int) -> list[tuple[int, int]]:
    """(hash, position) of the chosen grams and long lines."""
    found = [(int(h), i) for i, (h, n) in enumerate(zip(mix(hashes ^ U64(0x5BD1E995)), words, strict=True)) if n >= min_words]
    m = len(hashes) - gram + 1
    if m > 0:
        grams = np.zeros(m, U64)
        for g in range(gram):
            grams = mix(grams * U64(0x9E3779B97F4A7C15) + hashes[g : g + m])
        long = np.array(words) * 2 >= min_words
        chosen = np.array([long[i : i + gram].any() for i in range(m)])
        for i in range(max(1, m - window + 1)):
            part = grams[i : i + window]
            chosen[i + len(part) - 1 - int(part[::-1].argmin())] = True
        found += [(int(grams[i]), int(i)) for i in np.flatnonzero(chosen)]
    return found


def _matches(mine: np.ndarray, other: np.ndarray, shift: int, anchors: list[int]) -> list[tuple[int, int]]:
    """The maximal matching run through each anchor, as first and last position; `shift` is the distance to the other place."""
    low, high = max(0, shift), min(len(mine), len(other) + shift)
    equal = np.zeros(len(mine) + 2, np.int8)
    equal[low + 1 : high + 1] = mine[low:high] == other[low - shift : high - shift]
    edge = np.diff(equal)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    return [(int(starts[k]), int(ends[k])) for k in np.searchsorted(starts, np.array(anchors, np.int64), side="right") - 1]


def _shortest(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The runs of at least `least` words that are the shortest from their first line or up to their last."""
    total = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(total, total[:-1] + least)  # line ends[i] - 1 is the last of the run from line i
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    found = {(i, e - 1) for i, e in enumerate(ends.tolist()) if e < len(total)}
    return sorted(found | {(s, i) for i, s in enumerate(starts.tolist()) if s >= 0})


def sequences(docs: DataFrame, gram: int, window: int, min_words: int) -> DataFrame:
    """Line hashes and fingerprints of every distinct document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, PART):
            rows = []
            for text in batch.column(1).to_pylist():
                hashes, words, at = sequence(text)
                prints = [{"print": h - (1 << 64) if h >= 1 << 63 else h, "pos": i} for h, i in fingerprints(hashes, words, gram, window, min_words)]
                rows.append((hashes.view(np.int64), words, at, prints))
            columns = [[r[i] for r in rows] for i in range(4)]
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([("print", pa.int64()), ("pos", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", "hashes", "words", "at", "prints"])

    rows = docs.select(row_key().alias("key"), "text")
    return rows.mapInArrow(tidy(task), f"key struct<i:bigint,h:bigint>, {SEQUENCE}").dropDuplicates(["key"])


def repeated_runs(docs: DataFrame, *, gram: int = 2, window: int = 2, min_words: int = 50) -> DataFrame:
    """(key, runs): for each document with later repeated runs their first and last line numbers."""
    seq = cut(sequences(docs, gram, window, min_words))
    prints = seq.select("key", F.inline("prints"))
    place = F.struct("key", "pos")
    first = prints.groupBy("print").agg(F.min(place).alias("first"), F.max(place).alias("last"), (F.count("*") > 2).alias("more")).filter("first <> last").drop("last")
    later = prints.join(first, "print").filter(place > F.col("first")).select("key", "pos", F.col("first.key").alias("source"), (F.col("pos") - F.col("first.pos")).alias("shift"), "more")
    pairs = later.groupBy("key", "source", "shift").agg(F.collect_set("pos").alias("anchors"), F.collect_set(F.when(F.col("more"), F.col("pos"))).alias("open"))
    other = seq.select(F.col("key").alias("source"), F.col("hashes").alias("theirs"))
    both = pairs.join(seq.select("key", "hashes", "words", "at"), "key").join(other, "source").select("key", "hashes", "theirs", "shift", "anchors", "words", "at", "open")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, PART):
            found = []
            for i, (mine, theirs, shift, anchors, words, at, open_) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                mine, words = np.array(mine), np.array(words)
                matches = dict(zip(anchors, _matches(mine, np.array(theirs), shift, anchors), strict=True))
                found += [(i, None, None, at[a], at[b]) for a, b in {*matches.values()} if words[a : b + 1].sum() >= min_words]
                if open_ and any(a > 0 or b < len(words) - 1 for a, b in (matches[p] for p in open_)):
                    runs = _shortest(words, min_words)
                    begins, ends = (np.array([r[k] for r in runs], np.int64) for k in (0, 1))
                    wanted = np.zeros(len(runs), bool)
                    for p in open_:
                        a, b = matches[p]
                        wanted |= (begins <= p) & (p <= ends) & ((begins < a) | (ends > b))
                    for a, b in (runs[k] for k in np.flatnonzero(wanted)):
                        found.append((i, xxhash.xxh64_intdigest(mine[a : b + 1].tobytes()) - (1 << 63), a, at[a], at[b]))
            columns = [[x[k] for x in found] for k in range(5)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            index, *rest = (pa.array(c, k) for c, k in zip(columns, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), *rest], ["key", "print", "pos", "first", "last"])

    found = cut(both.mapInArrow(tidy(task), "key struct<i:bigint,h:bigint>, print bigint, pos int, first int, last int"))
    runs = found.filter("print IS NULL").select("key", "first", "last")
    shared = found.filter("print IS NOT NULL")
    least = shared.groupBy("print").agg(F.min(place).alias("begin"), F.max(place).alias("end")).filter("begin <> end").drop("end")
    runs = runs.unionByName(shared.join(least, "print").filter(place > F.col("begin")).select("key", "first", "last"))
    return runs.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, *, gram: int = 2, window: int = 2, min_words: int = 50) -> DataFrame:
    """`docs` with later repeated runs cut from `text`, and `line_runs`, the array of (first, last) line numbers cut from
    it (null where nothing was), which replaces a column of that name. `n_chars` follows the text if there is one."""
    docs = docs.drop("line_runs")
    runs = repeated_runs(docs, gram=gram, window=window, min_words=min_words).select(F.col("key").alias("line_key"), F.col("runs").alias("line_runs"))
    keyed = docs.select("*", row_key().alias("the line key"))
    lines = F.filter(F.split("text", "\n"), lambda _, i: ~F.exists("line_runs", lambda r: i.between(r["first"], r["last"])))
    joined = keyed.join(runs, F.col("the line key") == F.col("line_key"), "left").drop("the line key", "line_key")
    out = joined.withColumn("text", F.when(F.col("line_runs").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("line_runs").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of lines and of lines cut, and the text that is left."""
    out = dedup_lines(docs.select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines")))
    gone = F.aggregate(F.sequence(F.lit(0), F.col("n_lines") - 1), F.lit(0), lambda n, i: n + F.exists("line_runs", lambda r: i.between(r["first"], r["last"])).cast("int"))
    return out.select("doc_id", F.greatest(F.col("n_lines"), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("line_runs").isNull(), 0).otherwise(gone).cast("long").alias("n_removed"), "text")
