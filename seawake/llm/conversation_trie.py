"""A trie of conversation prefixes, grouped by digests of blocks of turns first.

A conversation is cut into blocks of `block` turns. A block's hash mixes its number with the SHA-256 of its turns, and
the hashes up to a block, combined, name the prefix that ends there (128 bits). Conversations are grouped by those names,
so a prefix that very many share is one row per task before anything is shuffled. Only where blocks that differ follow one
prefix are these blocks, one row for each different one and weighed by their members, taken apart into turns to find where
they part; everywhere else all turns of a block have the members of the block.

A node is named by its smallest member and its depth. The nodes that one conversation names are a path, and a path hangs on
a node of another, so sums over subtrees are sums over a tree of paths (by doubling of pointers, rounds as the logarithm
of its height) and running sums along each path.

No step needs a conversation, a node's members or a path in one task: turns are numbered in fixed ranges of all rows,
blocks and paths are summed in segments with one carry each, and the ids that end at a node are joined in groups of at
most 65,536 and led through the hash one group after another.

Rows with a null conv_id belong to no conversation and are left out. Null turns come first; turns of one number go by role,
then by digest. Null role and text are empty. Repeated rows are turns of their own. An empty table has no node, no root
either. Columns besides conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seawake.llm.words import cut

#: Turns of a block; rows of a segment; the bits of an id below those that name its group.
BLOCK, SEGMENT, GROUP_BITS = 4, 4096, 16
EMPTY = hashlib.sha256(b"").hexdigest()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts the rows of each conversation in a sorted partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not len(batch):
            continue
        conv = batch.column(0).to_numpy()
        starts = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1))
        first = np.repeat(starts, np.diff(np.append(starts, len(conv))))
        idx = np.arange(len(conv)) - first + 1
        if last is not None and conv[0] == last:
            idx[first == 0] += seen
        last, seen = conv[-1], int(idx[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(idx, pa.int64()), batch.column(3), batch.column(4), pa.array(np.full(len(conv), part), pa.int32())], ["conv_id", "idx", "digest", "chars", "part"])


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, idx from 1, digest of role and text, chars of the text) and conversations (conv_id, n).

    All rows are ranged by conversation and turn, so a long conversation is spread over tasks. At most one conversation
    goes on from one range into the next, so the table of what comes before has a row per range at most.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.length(text).cast("long").alias("chars"), F.rand(7).alias("salt")
    )
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    ranged = rows.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys)  # equal rows are interchangeable, so they may be dealt at random
    placed = cut(ranged.select("conv_id", "turn", "role", "digest", "chars").mapInArrow(_numbered, "conv_id long, idx long, digest binary, chars long, part int"))
    spans = placed.groupBy("conv_id", "part").agg(F.max("idx").alias("n"))
    spans = cut(spans.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))))
    carried = F.broadcast(spans.filter("before > 0").select("conv_id", "part", "before"))
    turns = placed.join(carried, ["conv_id", "part"], "left").select("conv_id", (F.col("idx") + F.coalesce("before", F.lit(0))).alias("idx"), "digest", "chars")
    return turns, spans.groupBy("conv_id").agg(F.sum("n").alias("n"))


def grafted(turns: DataFrame, convs: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of that whose id is the next lower multiple of `every`, then the own turns
    after the first h; h is the CRC-32 of the id modulo `heads`. Turns get their place `pos` and their conversation's `length`."""
    base, h = F.col("conv_id") - F.col("conv_id") % every, F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    first = turns.filter((F.col("conv_id") % every == 0) & (F.col("idx") < heads)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "chars"))).alias("head"))
    convs = convs.select("conv_id", "n", base.alias("base"), h.alias("h")).join(first, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
    taken = F.size("head").cast("long")
    convs = cut(convs.select("conv_id", "n", "h", "head", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    segment = F.floor(F.col("idx") / SEGMENT)
    places = convs.filter("n > h").select("conv_id", "h", "taken", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SEGMENT))).alias("segment"))
    own = turns.withColumn("segment", segment).join(places, ["conv_id", "segment"]).filter("idx > h").select("conv_id", (F.col("idx") - F.col("h") + F.col("taken")).alias("pos"), "digest", "chars", "length")
    taken = convs.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", F.col("t.idx").alias("pos"), "t.digest", "t.chars", "length")
    return own.unionByName(taken), convs.select("conv_id", "length")


def _name(turns: Column) -> Column:
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), ""), 256)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's ids; its groups come in order, and no more than one is held."""
    key, state = None, hashlib.sha256()
    done = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], ["x1", "x2", "sha"])
    for batch in batches:
        for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (a, b) == key:
                state.update(b"," + ids.encode())
                continue
            if key:
                yield done()
            key, state = (a, b), hashlib.sha256(ids.encode())
    if key:
        yield done()


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """Each conversation's blocks with the names of the prefix that ends with them (x1, x2) and of the one before (p1, p2)."""
    blocks = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / block).alias("k")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("turns"), F.max("length").alias("length"))
    blocks = blocks.withColumn("name", _name(F.col("turns"))).withColumns({"h1": F.xxhash64("k", "name"), "h2": F.xxhash64(F.lit(1), "k", "name"), "segment": F.floor(F.col("k") / SEGMENT)})
    blocks = cut(blocks.select("conv_id", "k", "segment", "turns", "h1", "h2", ((F.col("k") + 1) * block >= F.col("length")).alias("last")))
    totals = blocks.groupBy("conv_id", "segment").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"))
    w = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv_id", "segment", F.bit_xor("c1").over(w).alias("c1"), F.bit_xor("c2").over(w).alias("c2")).filter("segment > 0")
    w = Window.partitionBy("conv_id", "segment").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    inner = blocks.withColumns({"x1": F.bit_xor("h1").over(w), "x2": F.bit_xor("h2").over(w)}).join(carry, ["conv_id", "segment"], "left")
    inner = inner.withColumns({f"x{i}": F.col(f"x{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))) for i in (1, 2)})
    return inner.select("conv_id", "k", "turns", "last", "x1", "x2", F.col("x1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("h2")).alias("p2"))


def _nodes(known: DataFrame, top: int, members: int, block: int) -> tuple[DataFrame, DataFrame]:
    """All nodes from the different blocks: conv_id (smallest member), depth, n_convs, chars, parent; and the node (conv_id,
    depth) at which each named prefix ends."""
    follow = known.groupBy("p1", "p2").agg(F.count("*").alias("next"))
    before = known.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("owner").alias("up")).join(follow, ["p1", "p2"])
    first = known.filter("k = 0")
    first = first.withColumns({"up": F.lit(top).cast("long"), "next": F.lit(first.count())})
    after = cut(first.unionByName(known.filter("k > 0").join(before, ["p1", "p2"])))
    same = after.filter("next = 1").select("owner", "n", "up", F.posexplode("turns").alias("i", "t"))
    same = same.select(F.col("owner").alias("conv_id"), F.col("t.pos").alias("depth"), F.col("n").alias("n_convs"), F.col("t.chars").alias("chars"), F.when(F.col("i") == 0, F.col("up")).otherwise(F.col("owner")).alias("parent"))
    apart = after.filter("next > 1").select("p1", "p2", "owner", "n", "up", "turns", F.posexplode("turns").alias("i", "t"))
    apart = apart.select("p1", "p2", "owner", "n", "up", "t.pos", "t.chars", _name(F.slice("turns", F.lit(1), F.col("i") + 1)).alias("name"), F.when(F.col("i") > 0, _name(F.slice("turns", F.lit(1), F.col("i")))).alias("prior"))
    refined = apart.groupBy("p1", "p2", "name", "pos").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"), F.max("chars").alias("chars"), F.min("up").alias("up"), F.max("prior").alias("prior"))
    refined = cut(refined)
    above = refined.select("p1", "p2", F.col("name").alias("prior"), F.col("owner").alias("parent"))
    shape = lambda df, parent: df.select(F.col("owner").alias("conv_id"), F.col("pos").alias("depth"), F.col("n").alias("n_convs"), "chars", F.col(parent).alias("parent"))
    root = known.sparkSession.createDataFrame([(top, 0, members, 0, None)], "conv_id long, depth long, n_convs long, chars long, parent long")
    deeper = refined.filter("prior is not null").join(above, ["p1", "p2", "prior"])
    nodes = cut(root.unionByName(same).unionByName(shape(refined.filter("prior is null"), "up")).unionByName(shape(deeper, "parent")))
    whole = (F.size("turns") == block) | (F.col("next") == 1)
    end = F.element_at("turns", -1)["pos"].alias("depth")
    short = after.filter(~whole).select("x1", "x2", "p1", "p2", _name(F.col("turns")).alias("name")).join(refined, ["p1", "p2", "name"])  # others may go on from where these end
    spots = after.filter(whole).select("x1", "x2", F.col("owner").alias("conv_id"), end).unionByName(short.select("x1", "x2", F.col("owner").alias("conv_id"), F.col("pos").alias("depth")))
    return nodes, spots.unionByName(root.select(F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), "conv_id", "depth"))


def _path_totals(nodes: DataFrame, hung: DataFrame, top: int) -> DataFrame:
    """(conv_id, saved, leaves): sums over the subtree of the top of each conversation's path.

    Round after round a path gives what it has gathered to the path that its pointer reaches and doubles the pointer; after
    round i it has gathered all paths less than 2^i below it.
    """
    forked = hung.select(F.col("up").alias("conv_id"), F.col("at").alias("end")).distinct().withColumn("forked", F.lit(1))
    own = nodes.groupBy("conv_id").agg(F.sum(F.expr("(n_convs - 1) * chars")).alias("saved"), F.max("depth").alias("end"))
    left = own.join(forked, ["conv_id", "end"], "left").join(hung.select("conv_id", "up"), "conv_id", "left")
    left = cut(left.select("conv_id", "up", "saved", F.when(F.col("forked").isNull(), 1).otherwise(0).cast("long").alias("leaves")))
    while not (pointing := left.filter("up is not null")).isEmpty():
        given = pointing.groupBy(F.col("up").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        further = pointing.filter(F.col("up") != top).select("conv_id", "up").join(left.select(F.col("conv_id").alias("up"), F.col("up").alias("on")).filter("on is not null"), "up").select("conv_id", "on")
        left = left.drop("up").join(given, "conv_id", "left").join(further, "conv_id", "left")
        left = cut(left.select("conv_id", F.col("on").alias("up"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")))
    return left.drop("up")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of `turns(conv_id, pos, digest, chars, length)` of `convs(conv_id, length)`."""
    top, members = convs.agg(F.min("conv_id"), F.count("*")).first()
    if not members:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    blocks = cut(_blocks(turns, block))
    known = blocks.groupBy("x1", "x2").agg(F.count("*").alias("n"), F.min("conv_id").alias("owner"), F.min("k").alias("k"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.first("turns").alias("turns"))
    known = cut(known)
    nodes, spots = _nodes(known, top, members, block)
    hung = nodes.filter("parent <> conv_id").select("conv_id", F.col("parent").alias("up"), (F.col("depth") - 1).alias("at"))
    totals = _path_totals(nodes, hung, top)

    ends = blocks.filter("last").select("x1", "x2", "conv_id").unionByName(convs.filter("length = 0").select(F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), "conv_id"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    groups = ends.groupBy("x1", "x2", F.shiftright("conv_id", GROUP_BITS).alias("g")).agg(ids.alias("ids"))
    hashes = groups.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "g").mapInArrow(_hashed, "x1 long, x2 long, sha string")
    hashes = hashes.join(spots, ["x1", "x2"]).select("conv_id", "depth", "sha")

    hangs = hung.join(totals, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.count("*").alias("forks"))
    own = nodes.select("conv_id", "depth", "parent", "n_convs", F.expr("(n_convs - 1) * chars").alias("saved"))
    merged = own.unionByName(hangs, allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True).withColumn("segment", F.floor(F.col("depth") / SEGMENT))
    merged = merged.repartition("conv_id", "segment").groupBy("conv_id", "segment", "depth").agg(F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("saved", "leaves", "forks")), F.max("sha").alias("sha"))
    merged = cut(merged)
    w = Window.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    sums = merged.groupBy("conv_id", "segment").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.max("depth").alias("end"), F.max_by("forks", "depth").alias("at_end"))
    later = sums.select("conv_id", "segment", F.sum("saved").over(w).alias("later_saved"), F.sum("leaves").over(w).alias("later_leaves"), F.first("at_end").over(w).alias("last_forks")).filter("later_saved is not null")
    w = Window.partitionBy("conv_id", "segment").orderBy(F.desc("depth"))
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    goes_on = F.col("below").isNotNull() | F.col("later_saved").isNotNull()
    ended = F.when(F.coalesce("last_forks", F.col("end_forks")) == 0, 1).otherwise(0)  # a path that nothing hangs on at its end has a leaf there
    full = merged.withColumns({"below": F.lag("depth").over(w), "s": F.sum("saved").over(up_to), "l": F.sum("leaves").over(up_to), "end_forks": F.first("forks").over(up_to)}).join(later, ["conv_id", "segment"], "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("forks") + goes_on.cast("long")).alias("n_children"), (F.col("l") + F.coalesce("later_leaves", F.lit(0)) + ended).cast("long").alias("n_leaves"),
        (F.col("s") + F.coalesce("later_saved", F.lit(0))).alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, *, every: int = 100, heads: int = 6, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = grafted(*ordered(conversations), every, heads)
    return prefix_trie(turns, convs, block)
