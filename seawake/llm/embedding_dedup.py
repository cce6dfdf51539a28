"""Embedding near-duplicates by a forest of random-projection trees with spill overlap.

Each tree splits recursively: a level has a random direction, a node a threshold near a random quantile of the sample
points it holds, the one of a few that fewest points lie close to. A vector within `overlap` of the threshold goes to
both sides; a node most of whose points would spill is not split. Vectors that share a leaf and a label are compared by
cosine in double precision, so every link is verified, and a link counts in the first leaf that its two vectors share.
Large leaves are compared block against block, so no task holds more than two blocks and no pair is ever written: a
block pair yields the number of links and one union edge for each of its vectors. Equal vectors are compared once and
weighed by their number.

The upper part of the forest is fitted on at most `sample` distinct vectors (smallest hashes). Leaves that then hold more
than `GROW` times `leaf_rows` vectors are split further, each by a tree fitted on about `LEAF_SAMPLE` of its own vectors,
round by round until none is large but those that no threshold splits; so the size of leaves does not grow with the table.
Every vector is indexed. Rows whose vec_id or
label is null, and vectors that are null, empty, zero or hold null or non-finite components link with nothing; only
vectors of equal length are compared. Repeated rows count as copies that link with each other. Each row gets its row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seawake.llm.components import components
from seawake.llm.words import cut, mix

LEAF_BITS = 24
#: A leaf of more than so many times `leaf_rows` vectors is split further, by a tree of its own of at most so many levels,
#: fitted on about so many of its vectors.
GROW, LEVELS, LEAF_SAMPLE = 4, 7, 2048


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither large nor tiny components lose their length."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(d: int, depth: int, rng: np.random.Generator) -> np.ndarray:
    """A random unit direction for each level, at right angles where there are enough dimensions."""
    return np.linalg.qr(rng.standard_normal((d, max(d, depth))))[0][:, :depth] if depth <= d else unit(rng.standard_normal((depth, d))).T


class Tree:
    """One tree: a direction for each level, thresholds for its nodes; an infinite threshold does not split."""

    def __init__(self, sample: np.ndarray, depth: int, overlap: float, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.direction = directions(sample.shape[1], depth, rng)
        self.overlap, self.threshold = overlap, []
        p, node = sample @ self.direction, np.zeros(len(sample), np.int64)
        for level in range(depth):
            t = np.full(1 << level, np.inf)
            for n in range(1 << level):
                x = p[node == n, level]
                if len(x) >= 16:
                    tries = np.quantile(x, rng.uniform(0.3, 0.7, 7))
                    close = (np.abs(x[:, None] - tries) <= overlap).mean(0)
                    if close.min() <= 0.5:
                        t[n] = tries[close.argmin()]
            self.threshold.append(t)
            node = 2 * node + (p[:, level] > t[node])

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf each vector falls into."""
        p, row, node = x @ self.direction, np.arange(len(x)), np.zeros(len(x), np.int64)
        for level, t in enumerate(self.threshold):
            d = p[row, level] - t[node]
            left, right = d <= self.overlap, d >= -self.overlap
            row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
        return row, node


def grown(tree_seed: int, overlap: float, thresholds: np.ndarray, d: int) -> Tree:
    """The tree of a leaf from its thresholds, level after level."""
    t = Tree.__new__(Tree)
    depth = (len(thresholds) + 1).bit_length() - 1
    t.direction = directions(d, depth, np.random.default_rng(tree_seed))
    t.overlap, t.threshold = overlap, [thresholds[(1 << k) - 1 : (2 << k) - 1] for k in range(depth)]
    return t


def _fitter(leaf_rows: int, overlap: float, salt: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Fits a tree on the sample of one leaf."""

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        depth = min(LEVELS, max(1, math.ceil(math.log2(g["count"].iloc[0] / leaf_rows))))
        own = zlib.crc32(repr((g.label.iloc[0], int(g.d.iloc[0]), int(g.leaf.iloc[0]), salt)).encode())
        t = Tree(unit(np.array(g.embedding.tolist(), np.float64)), depth, overlap, own)
        return pd.DataFrame({"label": g.label.iloc[:1], "d": g.d.iloc[:1], "leaf": g.leaf.iloc[:1], "own": [own], "thresholds": [np.concatenate(t.threshold)]})

    return fit


def split_large(placed: DataFrame, leaf_rows: int, overlap: float, seed: int, rounds: int = 16) -> DataFrame:
    """(label, d, leaf, rep, code) of every vector in every leaf, large leaves split; a vector near a threshold is in both
    parts. Only vectors of large leaves go on with their embedding from round to round, the others as ids."""
    key = ["label", "d", "leaf"]
    ids = [*key, "rep", "code"]
    settled: list[DataFrame] = []
    active = placed.select(*ids, "embedding")
    for k in range(rounds):
        sizes = active.groupBy(key).count()
        large = cut(sizes.filter(F.col("count") > GROW * leaf_rows))
        if large.isEmpty():
            break
        share = F.pmod(F.xxhash64("rep", F.lit(seed + k)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        some = active.join(large, key).filter(share * F.col("count") <= LEAF_SAMPLE)
        kinds = placed.schema
        own = T.StructType([*(kinds[c] for c in key), T.StructField("own", T.LongType()), T.StructField("thresholds", T.ArrayType(T.DoubleType()))])
        trees = cut(some.select(*key, "embedding", "count").groupBy(key).applyInPandas(_fitter(leaf_rows, overlap, seed + k), own))
        trees = trees.filter(F.exists("thresholds", lambda t: t < float("inf")))  # a leaf that no threshold splits stays
        settled.append(active.select(*ids).join(trees.select(key), key, "left_anti"))

        def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                leaf, own, d = (batch.column(i).to_numpy() for i in (2, 6, 1))
                label = pc.dictionary_encode(batch.column(0)).indices.to_numpy()
                groups = np.unique(np.stack((label, d, leaf)), axis=1, return_inverse=True)[1].ravel()
                for g in range(groups.max() + 1):
                    mine = np.flatnonzero(groups == g)
                    t = grown(int(own[mine[0]]), overlap, np.array(batch.column(7)[int(mine[0])].as_py()), int(d[mine[0]]))
                    row, node = t.leaves(unit(_matrix(batch.column(5).take(pa.array(mine)))))
                    new = mix(mix(np.full(len(node), leaf[mine[0]], np.int64).view(np.uint64)) + node.astype(np.uint64)).view(np.int64)
                    part = batch.take(pa.array(mine[row]))
                    yield pa.RecordBatch.from_arrays([pa.array(new) if i == 2 else part.column(i) for i in range(6)], [*ids, "embedding"])

        active = cut(active.join(trees, key).select(*ids, "embedding", "own", "thresholds").mapInArrow(divide, active.schema))
    for part in settled:
        active = active.drop("embedding").unionByName(part)
    return active.drop("embedding")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return a @ b.T >= least


def compare(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one block pair: for each vector the weight it gains and the smallest vector of its union."""
    leaf = rows.leaf.iloc[0]
    mine, other = (rows.part == rows.i).to_numpy(), (rows.part == rows.j).to_numpy()
    same = rows.i.iloc[0] == rows.j.iloc[0]
    x = unit(np.array(rows.embedding.tolist(), np.float64))
    earlier = rows.leaves.map(lambda v: v[v < leaf])
    known = np.unique(np.concatenate(earlier.tolist() or [np.empty(0, np.int64)]))
    shared = np.zeros((len(rows), len(known)), np.float32)
    for k, v in enumerate(earlier):
        shared[k, np.searchsorted(known, v)] = 1
    a, b = np.flatnonzero(mine), np.flatnonzero(other)
    link = _linked(x[a], x[b], least)
    if same:
        np.fill_diagonal(link, False)
    first = link & (shared[a] @ shared[b].T < 0.5)
    weight = rows.copies.to_numpy()
    gain = np.zeros(len(rows), np.int64)
    gain[a] += first @ weight[b]
    if not same:
        gain[b] += first.T @ weight[a]
    ids = rows.rep.to_numpy()
    low = ids.copy()
    while True:  # smallest id spreads along the links of the two blocks
        new = low.copy()
        if link.size:
            big = np.iinfo(np.int64).max
            new[a] = np.minimum(new[a], np.where(link, low[b], big).min(1))
            new[b] = np.minimum(new[b], np.where(link, new[a][:, None], big).min(0))
        if (new == low).all():
            break
        low = new
    some = (gain > 0) | (low < ids)
    return pd.DataFrame({"rep": ids[some], "gain": gain[some], "low": low[some]})


def near_duplicates(
    vectors: DataFrame, *, least: float = 0.98, trees: int = 6, leaf_rows: int = 256, overlap: float = 0.04, sample: int = 16_384, block_rows: int = 1024, seed: int = 11
) -> DataFrame:
    """One row per row of `vectors(vec_id, embedding, label)`: vec_id, n_links, component_id, kept."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    reps = cut(rows.filter("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    sizes = reps.groupBy("label", F.size("embedding").alias("d")).count().groupBy("d").agg(F.max("count").alias("n")).collect()
    forests: dict[int, list[Tree]] = {}
    for r in sizes:
        depth = min(14, max(0, math.ceil(math.log2(r.n / leaf_rows))))
        some = reps.filter(F.size("embedding") == r.d).orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").toArrow().column(0).combine_chunks() if depth else None
        forests[r.d] = [Tree(unit(_matrix(some)) if depth else np.zeros((0, r.d)), depth, overlap, seed + t) for t in range(trees)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                x = unit(_matrix(part.column("embedding")))
                found = [t.leaves(x) for t in forests[int(d)]]
                row = np.concatenate([r for r, _ in found])
                leaf = np.concatenate([(k << LEAF_BITS) + n for k, (_, n) in enumerate(found)])
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                ends = np.cumsum(np.bincount(row, minlength=len(x)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(leaf, pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "leaves"])

    indexed = reps.mapInArrow(assign, T.StructType([*reps.schema.fields, T.StructField("leaves", T.ArrayType(T.LongType()))]))
    placed = cut(indexed.withColumns({"d": F.size("embedding"), "code": F.xxhash64("embedding")}))
    key, who = ["label", "d", "leaf"], ["label", "d", "rep", "code"]
    spread = cut(split_large(placed.withColumn("leaf", F.explode("leaves")), leaf_rows, overlap, seed).distinct())
    full = spread.groupBy(key).count().filter("count > 1").withColumn("parts", F.ceil(F.col("count") / block_rows).cast("int")).drop("count")
    spread = cut(spread.join(full, key).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(7)), "parts").cast("int")))
    leaves = spread.groupBy(who).agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))  # of several vectors each
    whole = placed.select(*who, "copies", "embedding").join(leaves, who)
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    blocks = spread.join(whole, who).withColumn("pair", F.explode(pairs)).select(*key, "rep", "copies", "embedding", "leaves", "part", "pair.i", "pair.j")
    found = cut(blocks.groupBy(*key, "i", "j").applyInPandas(lambda g: compare(g, least), "rep long, gain long, low long"))
    gains = found.groupBy("rep").agg(F.sum("gain").alias("gain"))
    joined = components(found.filter("low < rep").select(F.col("rep").alias("a"), F.col("low").alias("b")))
    links = reps.join(gains, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    links = links.select("label", "embedding", (F.coalesce("gain", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"), F.lit(True).alias("sound"))
    return rows.join(links, ["label", "embedding", "sound"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), (F.coalesce("c", "vec_id") == F.col("vec_id")).alias("kept")
    )
