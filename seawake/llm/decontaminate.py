"""Benchmark decontamination: an FM-index over each shard of the training texts, searched for the test phrases.

Each task packs the texts it reads into shards of a bounded number of tokens. A shard's tokens are the words that the
benchmark uses; any other word ends a segment, and segments shorter than the shortest phrase cannot hold one. The shard
gets a suffix array, from it a Burrows-Wheeler transform in a wavelet matrix, and every eighth suffix position is kept.
All phrases are then searched backward at once through wavelet ranks, and their occurrences located by walking to the
next kept position. Nothing is shuffled: a text meets only the phrases, which are shipped in blocks of bounded size.

Rules: A-Z is lower-cased; words are runs of digits, letters and non-ASCII characters. A phrase is `window` consecutive
words of an item, or the whole item if it is shorter (an item without words has no phrase). Null texts have no words.
Repeated document rows each get their row; repeated or null item ids count once, a null id by the name `null`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seawake.llm.words import ALNUM, cut, parts, row_key, tidy

WORD = regex.compile(rb"[0-9A-Za-z\x80-\xff]+")
SAMPLE = 8
#: Rows that `remove_leaks` searches and cuts at once.
PART = 2000
SCHEMA = "doc_id long, n_words long, hits array<int>, items array<string>"


def words(text: str | bytes | None) -> list[bytes]:
    """The item words of a text."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(ALNUM).split()


class WaveletMatrix:
    """Ranks over a sequence of small integers: one bit vector with running counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.bits = range(max(1, int(top).bit_length()) - 1, -1, -1)
        self.levels = []
        for b in self.bits:
            bit = (symbols >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
            self.levels.append((bit.astype(bool), ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        first = np.zeros_like(at)
        for b, (_, ones, zeros) in zip(self.bits, self.levels, strict=True):
            one = ((symbol >> b) & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            first = np.where(one, zeros + ones[first], first - ones[first])
        return at - first

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the positions."""
        symbol = np.zeros_like(at)
        for bit, ones, zeros in self.levels:
            one = bit[at]
            symbol = 2 * symbol + one
            at = np.where(one, zeros + ones[at], at - ones[at])
        return symbol


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Prefix doubling; every 0 is a terminator of its own, so no comparison runs past the end of a segment."""
    ends = tokens == 0
    rank = np.where(ends, np.cumsum(ends) - 1, tokens + int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    step, n = 1, len(tokens)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank.astype(np.int64) * (int(second.max(initial=0)) + 1) + second
        order = np.argsort(key, kind="stable")
        change = np.concatenate(([0], np.diff(key[order]) != 0))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change)
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over tokens in which 0 separates segments; the last token is 0."""

    def __init__(self, tokens: np.ndarray) -> None:
        order = suffix_array(tokens)
        top = int(tokens.max(initial=0))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(tokens, minlength=top + 1))))
        self.top = top
        self.tree = WaveletMatrix(tokens[order - 1], top)
        starts = np.concatenate(([True], tokens[:-1] == 0))  # kept, so that no walk has to pass a separator
        kept = (order % SAMPLE == 0) | starts[order] | (tokens[order] == 0)
        self.kept, self.slot, self.place = kept, np.cumsum(kept) - 1, order[kept]
        self.n = len(tokens)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase; phrases are rows filled up with -1 on the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for column in phrases.T[::-1]:
            live = np.flatnonzero((column >= 0) & (low < high))
            gone = column[live] > self.top
            high[live[gone]] = low[live[gone]]
            live = live[~gone]
            symbol = column[live]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps to the last kept position before each."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.kept[rows])
        while len(live):
            symbol = self.tree.access(rows[live])
            rows[live] = self.before[symbol] + self.tree.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.kept[rows[live]]]
        return self.place[self.slot[rows]] + steps


class Phrases:
    """The distinct phrases of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.owners = [sorted(x) for x in owners.values()]
        self.length = np.array([len(x) for x in owners], np.int64)
        self.matrix = np.full((len(owners), window), -1, np.int64)
        for row, phrase in enumerate(owners):
            self.matrix[row, window - len(phrase) :] = phrase
        self.shortest = int(self.length.min(initial=window))


class Shard:
    """Texts of one task until their tokens fill a shard."""

    def __init__(self, phrases: Phrases) -> None:
        self.p, self.rows, self.segments, self.size = phrases, [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = words(text)
        ids = np.fromiter(map(self.p.vocabulary.get, found, repeat(0)), np.int64, len(found))
        edge = np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b in zip(start, end, strict=True):
            if b - a >= self.p.shortest:
                self.segments.append((len(self.rows), a, ids[a:b]))
                self.size += b - a + 1
        self.rows.append((doc_id, len(found)))

    def results(self) -> list[tuple]:
        """(doc_id, words, starts and ends of the merged hit runs, items) of each text."""
        hits: dict[int, list] = {}
        if self.segments:
            tokens = np.concatenate([x for s in self.segments for x in (s[2], [0])])
            index = FMIndex(tokens)
            low, high = index.search(self.p.matrix)
            count = high - low
            phrase = np.repeat(np.arange(len(count)), count)
            rows = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(phrase))
            place = index.locate(rows)
            length = np.array([len(s[2]) + 1 for s in self.segments])
            begin = np.cumsum(length) - length
            segment = np.searchsorted(begin, place, side="right") - 1
            for s, at, ph in zip(segment.tolist(), (place - begin[segment]).tolist(), phrase.tolist(), strict=True):
                doc, offset, _ = self.segments[s]
                hits.setdefault(doc, []).append((int(offset) + at, ph))
        out = []
        for row, (doc_id, n) in enumerate(self.rows):
            spans, items = [], set()
            for at, ph in sorted(hits.get(row, ())):
                end = at + int(self.p.length[ph])
                items.update(self.p.owners[ph])
                if spans and at <= spans[-1]:
                    spans[-1] = max(spans[-1], end)
                else:
                    spans += [at, end]
            out.append((doc_id, n, spans, sorted(items)))
        return out


def _shards(batches: Iterator[pa.RecordBatch], phrases: Phrases, shard_tokens: int) -> Iterator[tuple[list, list]]:
    """The rows' results with their texts, shard by shard."""
    shard, texts = Shard(phrases), []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = text.as_py()
            shard.add(doc_id, text)
            texts.append(text)
            if shard.size >= shard_tokens or len(texts) >= 4000:
                yield shard.results(), texts
                shard, texts = Shard(phrases), []
    if texts:
        yield shard.results(), texts


def _each_block(benchmark: DataFrame, window: int, block_bytes: int) -> tuple[int, Iterator[Phrases]]:
    """The number of blocks of about `block_bytes` and, one at a time, the items of each: what is shipped to the tasks at
    once does not grow with the table."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // block_bytes + 1
    part = F.pmod(F.xxhash64("item"), F.lit(n))
    return n, (Phrases([(r.item, r.text) for r in items.filter(part == i).collect()], window) for i in range(n))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shard_tokens: int = 1 << 19, block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document row: its id, number of words, merged hit runs as word positions
    `[start, end, start, end, ...]` (end exclusive) and the ids of the items found, as sorted strings.

    With several blocks of items each block is a pass over the documents, and the runs are merged per row.
    """
    n, blocks = _each_block(benchmark, window, block_bytes)
    if n == 1:
        phrases = next(blocks)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, _ in _shards(batches, phrases, shard_tokens):
                ids, n, spans, items = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "hits", "items"])

        return docs.select("doc_id", "text").mapInArrow(tidy(task), SCHEMA)
    key = F.xxhash64("text").alias("h")
    texts = docs.select("doc_id", key, "text")
    merged = None
    for phrases in blocks:

        def keyed(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard = Shard(phrases)
                for text in batch.column(2).cast(pa.binary()):
                    shard.add(None, text.as_py())
                rows = shard.results()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.string()))], ["doc_id", "h", "n_words", "hits", "items"])

        part = cut(texts.mapInArrow(tidy(keyed), "doc_id long, h long, n_words long, hits array<int>, items array<string>"))  # so that the block can go
        merged = part if merged is None else merged.unionByName(part)
    runs = F.transform(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), lambda i: F.struct(F.get("hits", i).alias("a"), F.get("hits", i + 1).alias("b")))
    merged = merged.withColumn("runs", F.when(F.size("hits") > 0, runs).otherwise(F.array().cast("array<struct<a:int,b:int>>")))
    merged = merged.groupBy("doc_id", "h").agg(
        (F.count("*") / F.lit(n)).cast("long").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("runs")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    one = F.aggregate(
        "runs",
        F.array().cast("array<int>"),
        lambda out, r: F.when(
            (F.size(out) > 0) & (r["a"] <= F.element_at(out, -1)),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(F.element_at(out, -1), r["b"]))),
        ).otherwise(F.concat(out, F.array(r["a"], r["b"]))),
    )
    return merged.select("doc_id", "n_words", F.when(F.size("runs") > 0, one).otherwise(F.array().cast("array<int>")).alias("hits"), "items", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def digest(leaks: DataFrame) -> DataFrame:
    """The counts and the digest of the item ids of each row of `find_leaks`."""
    ends = F.transform(F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2)), lambda i: F.get("hits", i + 1) - F.get("hits", i))
    n_hit = F.when(F.size("hits") > 0, F.aggregate(ends, F.lit(0), lambda a, x: a + x)).otherwise(0).cast("long")
    return leaks.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_runs(text: bytes, runs: list[int]) -> str:
    """`text` without the words of the runs and what stands between them; one space joins what is left."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out.append(text[last : at[a][0]].rstrip())
        last = at[b - 1][1]
    return b" ".join(x for x in (*out, text[last:].lstrip()) if x).decode()


def _merged(runs: list[int]) -> list[int]:
    """Runs in any order as sorted runs that do not touch."""
    out: list[int] = []
    for a, b in sorted(zip(runs[::2], runs[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _cut_batch(batch: pa.RecordBatch, texts: list[bytes | None], runs: list[list[int]], at: int, counted: int | None) -> pa.RecordBatch:
    """The batch with the runs cut from its texts, and `n_chars` after them."""
    arrays = list(batch.columns)
    if any(runs):
        new = [cut_runs(t, r) if r else t and t.decode() for t, r in zip(texts, runs, strict=True)]
        new = ["" if t == b"" else t for t in new]
        arrays[at] = pa.array(new, pa.string())
        if counted is not None:
            old = arrays[counted].to_pylist()
            arrays[counted] = pa.array([len(t) if r else o for t, r, o in zip(new, runs, old, strict=True)], arrays[counted].type)
    return pa.RecordBatch.from_arrays(arrays, batch.schema.names)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shard_tokens: int = 1 << 19, block_bytes: int = 8 << 20) -> DataFrame:
    """`docs` with the benchmark passages cut from `text`; all columns stay, `n_chars` follows the text if there is one.

    Rows without a passage, null texts among them, stay as they are. One block of items is one narrow pass. Of several
    blocks each is searched for in the texts as they were, one after another, and what it found is kept by row key; then
    the runs of all blocks are merged and cut at once.
    """
    columns = docs.columns
    at = columns.index("text")
    counted = columns.index("n_chars") if "n_chars" in columns else None
    n, blocks = _each_block(benchmark, window, block_bytes)

    def whole(batch: pa.RecordBatch, texts: pa.Array, phrases: Phrases) -> tuple[list, list]:
        rows, raw = [], []
        for some, of in _shards(iter([pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), texts], ["doc_id", "text"])]), phrases, shard_tokens):
            rows += some
            raw += of
        return rows, raw

    if n == 1:
        phrases = next(blocks)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches, PART):
                rows, texts = whole(batch, batch.column(at), phrases)
                yield _cut_batch(batch, texts, [r[2] for r in rows], at, counted)

        return docs.mapInArrow(tidy(task), docs.schema)

    keyed, found = docs.select(row_key().alias("key"), "text"), None
    for phrases in blocks:

        def search(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches, PART):
                runs = [r[2] for r in whole(batch, batch.column(1), phrases)[0]]
                some = pa.array([i for i, r in enumerate(runs) if r], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array([r for r in runs if r], pa.list_(pa.int32()))], ["key", "runs"])

        part = cut(keyed.mapInArrow(tidy(search), "key struct<i:bigint,h:bigint>, runs array<int>").distinct())  # so that the block can go
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("the runs")).withColumnRenamed("key", "the key")
    joined = docs.withColumn("row key", row_key()).join(found, F.col("row key") == F.col("the key"), "left").select(*columns, "the runs")

    def cut_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, PART):
            runs = [_merged(r or []) for r in batch.column(len(columns)).to_pylist()]
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield _cut_batch(pa.RecordBatch.from_arrays(batch.columns[:-1], columns), texts, runs, at, counted)

    return joined.mapInArrow(tidy(cut_once), docs.schema)


def items_digest(items: list[str]) -> str:
    """What `digest` writes for these item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
