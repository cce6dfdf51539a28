"""The prefix trie of conversations against a brute-force trie on small tables."""

import hashlib
import math
import random
import zlib

import pytest

from seawake.llm import conversation_trie as ct

KIND = "conv_id long, turn long, role string, text string, digest string, n_convs long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, every=100, heads=6):
    """Every node of the trie of the rebuilt conversations, by sets of members of every prefix."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    paths = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        paths[c] = tuple(own.get(c - int(math.fmod(c, every)), [])[:h] + x[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = sum(saved[k] for k in kids) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = sorted(c for c in members[p] if paths[c] == p)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


def table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], KIND).repartition(parts)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: r[:2])


def talks(rng, n, texts, longest=14):
    """Conversations that part after any number of turns, some alike, some without a turn where they are rebuilt."""
    rows, seen = [], [[]]
    for i in range(n):
        talk = list(rng.choice(seen)[: rng.randint(0, longest)])
        talk += [(rng.choice(["user", "assistant", None]), rng.choice(texts)) for _ in range(rng.randint(0 if talk else 1, longest - len(talk) + 1))]
        seen.append(talk)
        rows += [(i * 37 % 1000 + (i % 3) * 100, k - 2 if k else None, r, t) for k, (r, t) in enumerate(talk)]
    return rows


@pytest.mark.parametrize("block", [1, 3, 4])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(ct, "SEGMENT", 2)  # so that paths, conversations and names are carried over segments
    rng = random.Random(block)
    rows = talks(rng, 150, ["", "a", "b", "ccc", "Ünï 😀", None])
    rng.shuffle(rows)
    assert got(ct.conversation_trie(table(spark, rows), block=block)) == brute(rows)


def test_equals_brute_force_with_long_segments(spark):
    rng = random.Random(9)
    rows = talks(rng, 200, ["x", "yy", "zzz"], 30)
    assert got(ct.conversation_trie(table(spark, rows))) == brute(rows)


def test_a_conversation_that_holds_most_rows_and_one_that_many_share(spark):
    rows = [(7, k, "user", f"t{k % 5}") for k in range(900)] + [(100 + c, k, "user", "hello" if k < 3 else f"own {c % 4}") for c in range(300) for k in range(4)]
    assert got(ct.conversation_trie(table(spark, rows, 8))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (205, None, None, None), (205, 1, "user", "a"), (205, 1, "user", "a"), (-3, 1, "user", "b"), (200, 0, "system", "s"), (299, 5, "user", "x" * 100_000), (299, 5, "user", "x" * 100_000)]
    assert got(ct.conversation_trie(table(spark, rows))) == brute(rows)
    turnless = [(c, 0, "u", "t") for c in range(301, 330)]  # few turns and no base: nothing is left of most
    assert got(ct.conversation_trie(table(spark, turnless))) == brute(turnless)


def test_the_query_equals_its_sql(spark):
    import duckdb

    from seawake.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    theirs = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op12_conversation_trie']})").fetchall()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_trie(spark, sf)) == sorted(theirs, key=lambda r: r[:2]) == brute(rows)


def test_an_empty_table_has_no_node(spark):
    assert got(ct.conversation_trie(spark.createDataFrame([], KIND))) == []


def test_ends_are_hashed_over_groups_of_ids(spark, monkeypatch):
    monkeypatch.setattr(ct, "GROUP_BITS", 2)
    rows = [(c, 0, "user", "same") for c in range(-40, 60)]
    assert got(ct.conversation_trie(table(spark, rows))) == brute(rows)
