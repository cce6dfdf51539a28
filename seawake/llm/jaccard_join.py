"""N-gram Jaccard join with PartEnum signatures.

A document is the set of its distinct word shingles. Sets are banded by size, each band a quarter wider than the one
below; a set takes part in its own band and in the one below, so two sets that can be similar meet in the band of the
smaller, where a similarity of at least `percent` bounds the size of their difference by a number k. The shingle domain
is split into groups of `cells` cells, so many that in at least one group without an empty choice at most `spoiled`
cells differ; a set has a signature for every group and every choice of the other cells. Similar sets therefore share a
signature for certain, whatever the data. (A set with too many empty choices for that tries further partitions of
the domain, and at last says so by one signature that such sets of a band share.)

Equal sets are joined by their hash, and only one document of each set is signed. Signatures are made and shuffled once;
sorted by signature they stream past, and only those of two and more documents are kept: two are a pair, three and more a
bucket. No bucket is expanded into all its pairs: each set is first verified against the member of its buckets that has
most buckets in common with others. If buckets that are too large for a passage hold too many pairs of different components,
their sets are verified, for a few turns that find links, against a member of the bucket's largest component that changes with
the turn. Only sets of a bucket that are then still in different components are paired, after a test on sizes and on parity
sketches that no similar pair can fail, and buckets of equal members count once. Verification intersects the whole shingle sets, which are written once for all candidates.

The links inside a component are counted block against block, as products of incidence matrices, so that a component of
any size is spread over many tasks and no pair of it is ever written.

A text is words split at ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one shingle; null
and blank texts have the empty set and link with nothing, as do rows with a null doc_id. Rows that share a doc_id are
one document with several sets. Shingles are compared by 64-bit hashes, sets by a 64-bit hash and their size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seawake.llm.components import components
from seawake.llm.words import U64, cut, mix, shingles, tidy

#: A sketch has at least so many bits, and so many for each element; more of them let fewer pairs pass that are not similar.
SKETCH_BITS, SKETCH_WIDTH = 2048, 4
#: A shingle that at least one in so many documents has is common; there are at most so many times the mean set size.
COMMON = 1024
#: Partitions of the domain that a set tries in turn.
PARTITIONS = 6
#: Up to so many hashes (8 bytes each) are shipped to the tasks to pick rows by; beyond, rows are joined by a shuffle.
SHIPPED = 1_000_000
#: A block of a component has about so many sets, or so many shingles if they are large.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 18
#: Most pairs fail by so many words of their sketches, before the others are read.
QUICK = 16
#: A bucket of more than so many times the documents that make a shingle common holds near copies, and is joined in so many turns at most.
LARGE, TURNS = 2, 3
#: Up to so many pairs (a, b) and (b, a) of large buckets are tested by their sketches at once, as that takes less than a turn.
PAIRS = 1 << 28
#: So many pairs of a block are tested at once, and so many of a set's signatures tell where it has met another set before.
TESTED, LOW = 1 << 17, 32


class Bands:
    """Upper ends of the size bands and, for each, the bound on the difference of similar sets."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def top(self, band: int) -> int:
        return int((100 / self.percent) ** band + 1e-9)

    def of(self, size: int) -> int:
        band = 0
        while self.top(band) < size:
            band += 1
        return band

    def difference(self, band: int) -> int:
        """|A^B| <= (|A|+|B|)(1-s)/(1+s) and the larger is at most 1/s times the smaller."""
        p = self.percent
        return self.top(band) * (100 + p) * (100 - p) // (p * (100 + p))

    def tags(self, size: int) -> list[int]:
        band = self.of(size)
        below = band - 1
        lower = below >= 0 and -(-size * self.percent // 100) <= self.top(below)
        return [t for t in ([band, below] if lower else [band]) if self.difference(t) > 0]


def _choices(s: np.ndarray, mixed: np.ndarray | None, tag: int, k: int, cells: int, spoiled: int, salt: int) -> tuple[list[np.ndarray], bool]:
    """Signatures of a set of hashes for one band, and whether the set is lame: with so many empty choices that a
    similar set need not share one that is not empty. `mixed`, if given, is what `_mixed` makes of the set."""
    if salt > 1:
        s, mixed = np.sort(mix(s ^ U64(salt))), None
    good = k // (spoiled + 1)  # so many groups can have more than `spoiled` cells that differ
    groups = good + 2 + k // 16
    cell = ((s >> U64(32)) * U64(groups * cells)) >> U64(32)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1])))
    total, some = np.zeros(groups * cells, U64), np.zeros(groups * cells, bool)
    if len(s):
        total[cell[first]] = mix(np.add.reduceat(_mixed(s) if mixed is None else mixed, first))
    some[cell[first]] = True
    total, some = total.reshape(groups, cells), some.reshape(groups, cells)
    lame = np.zeros(groups, bool)
    base = mix(np.arange(groups, dtype=U64) * U64(64) + U64(tag * (1 << 40) + (salt << 36)))
    out = []
    for c, choice in enumerate(combinations(range(cells), cells - spoiled)):
        sig, any_ = base + U64(c + 1), np.zeros(groups, bool)
        for x in choice:
            sig = mix(sig + total[:, x])
            any_ |= some[:, x]
        out.append(sig[any_])
        lame |= ~any_
    return out, bool(lame.sum() >= groups - good)


def _mixed(s: np.ndarray) -> np.ndarray:
    return mix(s ^ U64(0xA5A5A5A5A5A5A5A5))


def signatures(s: np.ndarray, bands: Bands, cells: int, spoiled: int, hot: np.ndarray) -> np.ndarray:
    """The PartEnum signatures of a sorted set of hashes.

    Very common shingles (`hot`) are left out first: two sets differ no more without them, so the bound holds, and a
    passage that many documents quote makes no bucket. A set that is lame has the signatures of the whole set as well, if
    need be under several partitions of the domain: of two similar sets one is not lame under the last that both try, or
    both are lame under all of them and share one more signature.
    """
    out: list[np.ndarray] = []
    rare = s[hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] != s] if len(hot) else s
    mixed = _mixed(rare)  # the same for every band
    for tag in bands.tags(len(s)):
        k = bands.difference(tag)
        for salt in range(1 + PARTITIONS):
            found, lame = _choices(s if salt else rare, None if salt else mixed, tag, k, cells, spoiled, salt)
            out += found
            if not lame:
                break
        else:
            out.append(mix(np.array([tag * (1 << 40) + 63], U64)))
    return np.concatenate(out) if out else np.empty(0, U64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of hashed buckets: two sets differ in at least as many elements as their parities do. A sketch of
    twice the buckets folds onto a smaller one."""
    bits = max(SKETCH_BITS, 1 << max(0, SKETCH_WIDTH * len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ U64(0x1234567)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


PROFILE = "doc_id long, h long, n long, set long, odd array<long>"


def _set_hash(s: np.ndarray) -> int:
    return int((mix(s).sum() if len(s) else U64(0)).view(np.int64))


def _row_hash(doc_id: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A 64-bit name of a document's set."""
    return mix(mix(doc_id.astype(np.int64).view(U64)) ^ whole.astype(np.int64).view(U64))


def _profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h, n, set, odd) of every row: text hash, and size, hash and parity sketch of its shingle set.

    There are also rows without a sketch: shingles (`set`) with the number of rows (`n`) that have them, wherever that is
    at least one in `COMMON` of a batch. What is so common overall is so in some batch.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "n", "set", "odd"]
        for batch in batches:
            for part in (batch.slice(i, 2 * COMMON) for i in range(0, len(batch), 2 * COMMON)):
                sets = [shingles(t.as_py(), shingle) for t in part.column(2).cast(pa.binary())]
                rows = [*part.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_set_hash, sets), pa.int64()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(rows, names)
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                often = n >= max(2, len(sets) // COMMON)
                h, n = h[often].view(np.int64), n[often]
                none = pa.nulls(len(h), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(n, pa.int64()), pa.array(h), pa.nulls(len(h), pa.list_(pa.int64()))], names)

    return docs.select("doc_id", F.xxhash64("text"), "text").mapInArrow(tidy(task), PROFILE)


def _hashes(df: DataFrame, column: str) -> np.ndarray:
    """A column of a table of at most `SHIPPED` rows, sorted."""
    return np.sort(df.select(column).toArrow().column(0).to_numpy().astype(np.int64).view(U64))


def _in(some: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of `x` are in the sorted `some`."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x if len(some) else np.zeros(len(x), bool)


def _postings(docs: DataFrame, hot: np.ndarray, shingle: int, percent: int, cells: int, spoiled: int, without: np.ndarray) -> DataFrame:
    """(sig, doc_id) for every signature of every row whose set is not in `without`."""
    bands = Bands(percent)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                sets = [shingles(t.as_py(), shingle) for t in part.column(1).cast(pa.binary())]
                names, once = np.unique(_row_hash(ids, np.array([*map(_set_hash, sets)], np.int64)), return_index=True)
                signed = once[~_in(without, names)]
                sigs = [signatures(sets[i], bands, cells, spoiled, hot) for i in signed]
                flat, ids = np.concatenate([*sigs, np.empty(0, U64)]), np.repeat(ids[signed], [len(s) for s in sigs])
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(ids, pa.int64())], ["sig", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(tidy(task), "sig long, doc_id long")


def _shared(postings: DataFrame, least: int) -> DataFrame:
    """What signatures of several documents say, with the number of times (`met`) it is said: (null, a, b) for a pair of
    documents, (sig, a, null) for a member of a signature of at least `least` rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wide = np.empty((0, 2), np.int64), None  # rows of the last signature while they are few, or its name
        for batch in batches:
            rows = np.concatenate((held, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])))
            if not len(rows):
                continue
            start = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
            n = np.diff(np.append(start, len(rows)))
            many = n >= least
            many[0] |= wide is not None and rows[0, 0] == wide
            held, wide = (rows[:0], rows[-1, 0]) if many[-1] else (rows[start[-1] :], None)
            yield out(rows[np.repeat(many, n)], rows, start[:-1][(n[:-1] == 2) & ~many[:-1]])
        if len(held) == 2:
            yield out(held[:0], held, np.zeros(1, np.int64))

    def out(members: np.ndarray, rows: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        x, y = rows[at, 1], rows[at + 1, 1]
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        none = [pa.nulls(k, pa.int64()) for k in (len(x), len(members))]
        columns = [(none[0], pa.array(members[:, 0])), (pa.array(x), pa.array(members[:, 1])), (pa.array(y), none[1])]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["sig", "a", "b"])

    by_sig = postings.repartition("sig").sortWithinPartitions("sig")
    return by_sig.mapInArrow(tidy(task), "sig long, a long, b long").groupBy("sig", "a", "b").agg(F.count("*").alias("met"))


def _possible(percent: int) -> Column:
    """False only for pairs (na, odda), (nb, oddb) that cannot be similar, by size or by parity."""
    half = lambda v: F.zip_with(F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2).cast("int") + 1, (F.size(v) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    x, y = (F.when(F.size(f"odd{i}") > F.size(f"odd{j}"), half(F.col(f"odd{i}"))).otherwise(F.col(f"odd{i}")) for i, j in ("ab", "ba"))
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, n: t + n)
    some = sum((F.bit_count(F.get("odda", i).bitwiseXOR(F.get("oddb", i))) for i in range(1, QUICK)), F.bit_count(F.get("odda", 0).bitwiseXOR(F.get("oddb", 0))))
    quick = (F.size("odda") != F.size("oddb")) | (some * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))  # a part of the parities
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & quick & (differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, s): the distinct shingle sets of the documents in `ids`."""
    some = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= SHIPPED else ids, "doc_id", "left_semi")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                sets = [shingles(t.as_py(), shingle) for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_set_hash, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "set", "s"])

    return some.mapInArrow(tidy(task), "doc_id long, set long, s array<long>").filter(F.size("s") > 0).dropDuplicates(["doc_id", "set"])


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that have similar sets."""
    a, b = (sets.select(F.col("doc_id").alias(i), F.col("s").alias(f"s{i}")) for i in "ab")
    both = pairs.select("a", "b").join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).select("a", "b")


def _count_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The weight that each set of two blocks of a component gains by links between the blocks (or in the one block)."""
    mine = (rows.part == rows.i).to_numpy()
    a, b = np.flatnonzero(mine), np.flatnonzero((rows.part == rows.j).to_numpy())
    size = rows.n.to_numpy()
    name, column = np.unique(np.concatenate(rows.s.tolist()), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, len(name), 4096):
        first, last = np.searchsorted(column, [low, low + 4096])
        has = np.zeros((len(rows), 4096), np.float32)
        has[row[first:last], column[first:last] - low] = 1
        common += has[a] @ has[b].T
    common = common.astype(np.int64)
    link = common * 100 >= (size[a][:, None] + size[b][None, :] - common) * percent
    link &= a[:, None] != b[None, :]
    weight, gain = rows.copies.to_numpy(), np.zeros(len(rows), np.int64)
    gain[a] += link @ weight[b]
    if rows.i.iloc[0] != rows.j.iloc[0]:
        gain[b] += link.T @ weight[a]
    return pd.DataFrame({"set": rows.set[gain > 0], "n": size[gain > 0], "gain": gain[gain > 0]})


def _renamed(joined: DataFrame, more: DataFrame) -> DataFrame:
    """(node, c), the components of edges, after more edges (a, b): only what these connect is followed."""
    a_, b_ = (joined.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    between = more.join(a_, "a", "left").join(b_, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    to = cut(components(between)).select(F.col("node").alias("c"), F.col("component").alias("least"))
    new = to.select(F.col("c").alias("node"), "c").join(joined.select("node"), "node", "left_anti")
    return cut(joined.unionByName(new).join(to, "c", "left").select("node", F.coalesce("least", "c").alias("c")))


def _across(named: DataFrame, large: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each large bucket's sets outside its largest component with one set of that component."""
    rows = named.join(large.select("sig"), "sig")
    parts = rows.groupBy("sig", "c").agg(F.count("*").alias("k"), F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("rep"))
    centre = parts.groupBy("sig").agg(F.max_by(F.struct("rep", "c"), F.struct("k", F.xxhash64("rep", F.lit(turn)))).alias("o"))
    return rows.join(centre, "sig").filter("c <> o.c").select(F.least("rep", "o.rep").alias("a"), F.greatest("rep", "o.rep").alias("b")).distinct()


def _alike(odd: pa.Array, n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs of rows (x, y) can be similar by their parities, and by how many of these they differ."""
    length, words = odd.value_lengths().to_numpy(), odd.flatten().to_numpy().view(U64)
    at, row, of = np.cumsum(length) - length, np.empty(len(length), np.int64), {}
    for k in np.unique(length):
        rows = np.flatnonzero(length == k)
        row[rows] = np.arange(len(rows))
        of[k] = words.reshape(-1, k) if len(rows) == len(length) else words[at[rows][:, None] + np.arange(k)]
    able, differ, most = np.zeros(len(x), bool), np.zeros(len(x), np.int64), (n[x] + n[y]) * (100 - percent)
    for k in of:
        for o in of:
            some = np.flatnonzero((length[x] == k) & (length[y] == o)) if len(of) > 1 else np.arange(len(x))
            if not len(some):
                continue
            least = min(k, o)
            s, t = (np.bitwise_xor.reduce(of[v].reshape(-1, v // least, least), axis=1) for v in (k, o))
            for columns in (slice(0, QUICK), slice(QUICK, None)):  # most pairs fail by the first
                differ[some] += np.bitwise_count(s[row[x[some]], columns] ^ t[row[y[some]], columns]).sum(1, dtype=np.int64)
                some = some[differ[some] * (100 + percent) <= most[some]]
            able[some] = True
    return able, differ


def _passing(rows: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of rows of one block in different components that can be similar: the block, both rows, and the share of
    their elements that surely differ. `rows` are sorted by block."""
    i, j, part, c, n = (rows.column(v).to_numpy() for v in ("i", "j", "part", "c", "n"))
    block = _blocks(rows)
    number = np.arange(len(rows))
    after = np.searchsorted(block, block, side="right") - number - 1  # rows of the block that follow
    total, low, out = np.concatenate(([0], np.cumsum(after))), 0, []
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(total, total[low] + TESTED, side="right")) - 1)
        x = np.repeat(number[low:high], after[low:high])
        y = x + 1 + np.arange(len(x)) - np.repeat(total[low:high] - total[low], after[low:high])
        able = (c[x] != c[y]) & ((i[x] == j[x]) | (part[x] != part[y])) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        x, y = x[able], y[able]
        able, differ = _alike(rows.column("odd"), n, x, y, percent)
        out.append((block[x[able]], x[able], y[able], differ[able] / (n[x] + n[y])[able]))
        low = high
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _blocks(rows: pa.RecordBatch) -> np.ndarray:
    """A number for each run of rows of one block (sig, i, j)."""
    new = np.zeros(len(rows), bool)
    for v in ("sig", "i", "j"):
        key = rows.column(v).to_numpy()
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def _forest(block: np.ndarray, a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which pairs of components (a, b) of blocks make up a forest of each block, those that differ least first."""
    low, high, to, out = np.minimum(a, b), np.maximum(a, b), {}, []
    order = np.lexsort((share, high, low, block))
    key = np.column_stack((block, low, high))[order]
    once = order[np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]).any(1)))]

    def top(v: tuple[int, int]) -> tuple[int, int]:
        while (up := to.get(v, v)) != v:
            to[v] = v = to.get(up, up)
        return v

    for k in once[np.lexsort((share[once], block[once]))].tolist():
        p, q = top((block[k], a[k])), top((block[k], b[k]))
        if p != q:
            to[p] = q
            out.append(k)
    return np.array(out, np.int64)


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (sig, a, b) of different components inside buckets that can be similar, from `rows` (sig, m, rep, c, n, odd): of a
    block of a bucket only a forest, so fewer pairs than sets. With a column `low`, the least signatures of the set, all
    such pairs: each at the least signature that both have there, so that sets that share many buckets make one row.

    A bucket is tested part against part, so that one of any size is spread over many tasks.
    """
    parts = F.ceil(F.col("m") / BLOCK_SETS).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    block = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    whole = "low" in rows.columns
    dealt = dealt.withColumn("block", F.explode(block)).select("sig", "block.i", "block.j", "part", "rep", "c", "n", "odd", *["low"][: int(whole)])

    def out(rows: pa.RecordBatch) -> pa.RecordBatch:
        sig, rep, c = (rows.column(v).to_numpy() for v in ("sig", "rep", "c"))
        block, x, y, share = _passing(rows, percent)
        if whole:
            size = rows.column("low").value_lengths().to_numpy()
            low = np.full((len(rows), LOW), np.iinfo(np.int64).max)
            low[np.arange(LOW) < size[:, None]] = rows.column("low").flatten().to_numpy()
            met = [np.empty(0, bool)]
            for k in range(0, len(x), 4096):
                p, q = x[k : k + 4096], y[k : k + 4096]
                earlier = np.where(low[p] < sig[p][:, None], low[p], -1 << 63)
                met.append(((earlier[:, :, None] == low[q][:, None, :]) & (earlier[:, :, None] > -1 << 63)).any((1, 2)))
            some = np.flatnonzero(~np.concatenate(met))
        else:
            some = _forest(block, c[x], c[y], share)
        a, b = rep[x[some]], rep[y[some]]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (sig[x[some]], np.minimum(a, b), np.maximum(a, b))], ["sig", "a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last block while more of it may follow
        for batch in batches:
            if not len(batch):
                continue
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            start = np.flatnonzero(np.diff(_blocks(held), prepend=-1))
            done = 0
            for k in range(1, len(start)):  # some whole blocks at once
                if start[k] - done >= 2 * BLOCK_SETS or k == len(start) - 1:
                    yield out(held.slice(done, start[k] - done))
                    done = start[k]
            held = held.slice(done)
        if held is not None:
            yield out(held)

    by_block = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return by_block.mapInArrow(tidy(task), "sig long, a long, b long")


def _edges(docs: DataFrame, profiles: DataFrame, hot: np.ndarray, reps: DataFrame, shingle: int, percent: int, cells: int, spoiled: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b) of first documents of different sets, whose components are those of all links; and the sets
    of all candidates."""
    copies = profiles.select("doc_id", "set", "n").join(reps.select("set", "n", "rep"), ["set", "n"]).filter("doc_id <> rep").select("doc_id", "set").distinct()
    copies, without = cut(copies), np.empty(0, U64)
    few = copies.count() <= SHIPPED
    if few:
        got = copies.toArrow()
        without = np.sort(_row_hash(*(got.column(i).to_numpy() for i in range(2))))
    shared = cut(_shared(_postings(docs, hot, shingle, percent, cells, spoiled, without), 3 if few else 2))
    members = shared.filter("sig IS NOT NULL").select("sig", F.col("a").alias("doc_id"))
    of = reps.select("rep", "n", "odd")
    if not few:  # copies are signed too, and stand for their sets
        first = copies.join(profiles.select("doc_id", "set", "n"), ["doc_id", "set"]).join(reps.select("set", "n", "rep"), ["set", "n"]).select("doc_id", "rep")
        members = cut(members.join(first, "doc_id", "left").select("sig", F.coalesce("rep", "doc_id").alias("doc_id")).distinct())
    members = members.withColumnRenamed("doc_id", "rep")
    often = members.groupBy("rep").agg(F.count("*").alias("often"))
    centre = members.join(often, "rep").groupBy("sig").agg(F.max_by("rep", F.struct("often", F.bitwise_not("rep"))).alias("centre"))

    a, b = (of.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("odd").alias(f"odd{x}")) for x in "ab")
    met = shared.filter("sig IS NULL").select("a", "b", F.col("b").alias("of"), "met")
    met = met.unionByName(members.join(centre, "sig").filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"), F.col("rep").alias("of"), F.lit(1).cast("long").alias("met")))
    star = cut(met.groupBy("a", "b", "of").agg(F.sum("met").alias("met")).join(b, "b").join(a, "a").filter(_possible(percent)).select("a", "b", "of", "met"))
    best = cut(star.groupBy("of").agg(F.max_by(F.struct("a", "b"), F.struct("met", F.bitwise_not("a"), F.bitwise_not("b"))).alias("p")).select("p.a", "p.b").distinct())
    ids = star.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(members.select(F.col("rep").alias("doc_id"))).distinct()
    sets = cut(_sets(docs, cut(ids), shingle))
    found = cut(_verified(sets, best, percent))

    joined = cut(components(found).withColumnRenamed("component", "c"))
    a_, b_ = (joined.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    rest = cut(star.select("a", "b").distinct().join(best, ["a", "b"], "left_anti").join(a_, "a", "left").join(b_, "b", "left").filter(apart).select("a", "b"))
    done, turn, grown = best, 0, True
    while True:
        named = cut(members.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "rep", F.coalesce("c", "rep").alias("c")))
        parts = named.groupBy("sig", "c").agg(F.count("*").alias("k"), F.sum(F.xxhash64("rep").bitwiseAND((1 << 40) - 1)).alias("who"), F.bit_xor(F.xxhash64("rep")).alias("mix"))
        open_ = parts.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("within"), F.sum("who").alias("who"), F.bit_xor("mix").alias("mix"))
        open_ = cut(open_.filter("lo < hi").groupBy("m", "within", "who", "mix").agg(F.min("sig").alias("sig")).select("sig", "m", (F.col("m") * F.col("m") - F.col("within")).alias("apart")))
        large = open_.filter(F.col("m") > LARGE * least)
        if not grown or turn == TURNS or (large.agg(F.sum("apart")).first()[0] or 0) <= PAIRS:
            break
        across = _across(named, large, turn).join(b, "b").join(a, "a").filter(_possible(percent)).select("a", "b")
        tried = cut((across if turn else across.unionByName(rest).distinct()).join(done, ["a", "b"], "left_anti"))
        more = cut(_verified(sets, tried, percent))
        grown, turn, done = not more.isEmpty(), turn + 1, done.unionByName(tried)
        if grown:
            found = cut(found.unionByName(more))
            joined = _renamed(joined, more)
    forest = cut(_pairs(named.join(open_.select("sig", "m"), "sig").join(of, "rep"), percent))
    pairs = forest.select("a", "b")
    tried = cut((pairs if turn else pairs.unionByName(rest)).distinct().join(done, ["a", "b"], "left_anti"))
    more = cut(_verified(sets, tried, percent))
    found = found.unionByName(more)
    joined = joined if more.isEmpty() else _renamed(joined, more)
    a_, b_ = (joined.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    still = cut(forest.join(a_, "a", "left").join(b_, "b", "left").filter(apart).select("sig").distinct().join(open_.select("sig", "m"), "sig"))
    if still.isEmpty():  # the forests hold, so nothing else in their buckets is apart
        return found, sets
    rows = cut(members.join(still, "sig").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "m", "rep", F.coalesce("c", "rep").alias("c")))
    low = rows.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, LOW).alias("low"))
    last = cut(_pairs(rows.join(low, "rep").join(of, "rep"), percent).select("a", "b").distinct().join(done.unionByName(tried), ["a", "b"], "left_anti"))
    return found.unionByName(cut(_verified(sets, last, percent))), sets


def _grouped(docs: DataFrame, shingle: int, percent: int, cells: int = 2, spoiled: int = 1) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(doc_id, h, n, set) of every row; (set, n, rep, copies, component) of every set that is not alone, the component being
    the smallest doc_id that its documents reach; the sets of candidates; and the components of ids with several sets."""
    both = cut(_profiles(docs, shingle))
    rows, docs = both.filter("odd IS NOT NULL").drop("odd"), docs.filter("doc_id IS NOT NULL")
    profiles = both.filter("odd IS NOT NULL AND doc_id IS NOT NULL AND n > 0")
    least = max(2, profiles.count() // COMMON)
    hot = _hashes(both.filter("odd IS NULL").groupBy("set").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "set")
    named = profiles.groupBy("set", "n", "doc_id").agg(F.any_value("odd").alias("odd"))  # repeated rows are one
    reps = cut(named.groupBy("set", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("odd").alias("odd")))
    pairs, sets = _edges(docs, profiles, hot, reps, shingle, percent, cells, spoiled, least)

    several = profiles.groupBy("doc_id").agg(F.min(F.struct("set", "n")).alias("lo"), F.max(F.struct("set", "n")).alias("hi")).filter("lo <> hi").select("doc_id")
    same = profiles.join(several, "doc_id").join(reps.select("set", "n", "rep"), ["set", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    joined = cut(components(pairs.unionByName(same)))
    alone = (F.col("copies") == 1) & F.col("component").isNull()
    found = reps.drop("odd").join(joined.withColumnRenamed("node", "rep"), "rep", "left").filter(~alone)
    found = cut(found.withColumn("component", F.coalesce("component", "rep")))
    return rows, found, sets, same.select(F.col("a").alias("node")).distinct().join(joined, "node").select("component", F.lit(True).alias("mixed")).distinct()


def links(docs: DataFrame, *, shingle: int = 5, percent: int = 80, cells: int = 2, spoiled: int = 1) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, set) of every row, and (set, n, component, links) of every set that is not alone: the smallest doc_id
    that its documents reach, and the number of other documents that its documents are linked with directly."""
    rows, found, sets, mixed = _grouped(docs, shingle, percent, cells, spoiled)
    groups = found.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.sum("copies").alias("all"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("m > 1")
    two = (F.col("m") == 2) & (F.col("lo") < F.col("hi")) & F.col("mixed").isNull()  # such a pair has been verified
    groups = cut(groups.join(mixed, "component", "left").withColumn("two", two))
    parts = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    large = found.join(groups.filter("NOT two").select("component", parts.alias("parts")), "component")
    dealt = large.withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")).join(sets.withColumnRenamed("doc_id", "rep"), ["rep", "set"])
    block = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    dealt = dealt.withColumn("block", F.explode(block)).select("component", "block.i", "block.j", "part", "set", "n", "copies", "s")
    gains = dealt.groupBy("component", "i", "j").applyInPandas(lambda g: _count_links(g, percent), "set long, n long, gain long")
    two = found.join(groups.filter("two").select("component", "all"), "component").select("set", "n", (F.col("all") - F.col("copies")).alias("gain"))
    gains = gains.unionByName(two).groupBy("set", "n").agg(F.sum("gain").alias("gain"))
    return rows, cut(found.join(gains, ["set", "n"], "left").select("set", "n", "component", (F.coalesce("gain", F.lit(0)) + F.col("copies") - 1).alias("links")))


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, the smallest doc_id reachable by links, and n_links,
    the number of other documents (of a document with several sets: of its sets) whose sets are similar to the row's."""
    rows, found = links(docs, shingle=shingle, percent=percent)
    real = F.col("doc_id").isNotNull()
    out = rows.join(found, ["set", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(real, F.coalesce("component", "doc_id")).alias("component_id"), F.when(real, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group, that of the smallest doc_id; rows of it that share its id but not its text
    stay too, of repeated rows (same id, same text) one does. Documents without words and rows without an id stay. Links are
    not counted for it."""
    rows, found, _, _ = _grouped(docs, shingle, percent)
    keyed = rows.filter("doc_id IS NOT NULL").join(found, ["set", "n"], "left").groupBy("doc_id", "h").agg(F.count("*").alias("times"), F.min("component").alias("component"))
    marked = cut(keyed.filter("times > 1 OR component <> doc_id").select(F.col("doc_id").alias("the id"), F.col("h").alias("the hash"), (F.coalesce("component", "doc_id") != F.col("doc_id")).alias("gone")))
    key = (F.col("doc_id") == F.col("the id")) & (F.xxhash64("text") == F.col("the hash"))
    left = docs.join(marked, key, "left_anti")
    twice = docs.join(marked.filter("NOT gone"), key, "left_semi")
    return left.unionByName(twice.withColumn("the hash", F.xxhash64("text")).dropDuplicates(["doc_id", "the hash"]).select(*docs.columns))
