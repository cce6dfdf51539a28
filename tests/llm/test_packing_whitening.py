"""Packing of tokenized documents and whitening of embeddings against brute force on small tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seawake.llm import packing, queries, whitening

DOCS = "doc_id long, text string, length string, ids long, rank int, sequence_id string"
SF = "/root/testdata/sf0.001"


def table(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in enumerate(texts)], DOCS).repartition(parts)


# ---- packing

ODD = [
    None, "", "  \n\t ", "Don'T I'LL 'S it’s 'tis we'rE", "ΟΔΥΣΣΕΥΣ Σ İstanbul ﬁ é ́x a b\u0085c\x1cd\x00e  ", "日本語 テキスト😀 x😀y1２３ ½ ×÷", "a\x7fb \x0b\x0c Ǆ ß ẞ Ünï ſ", "x" * 9000, "the " * 9000,
    "one <|endoftext|> two <|STARTOFTEXT|> <|startoftext|>", "<|", "A" * 70 + " é" * 40, "straße ÀÉÎÕÜ œuvre ŁÓDŹ 12345 ?!... --", "hello",
]


def expected(texts, capacity, end=1):
    t = Tokenizer.from_file(packing.VOCABULARY)
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end]
        for k in range(0, len(ids), capacity):
            yield i, k // capacity, k, ids[k : k + capacity]


def whole(rows, capacity):
    """Sequences without gap or overlap."""
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("at_once", [20, 1 << 22])
def test_pieces_hold_the_ids_of_the_tokenizer(spark, monkeypatch, at_once):
    monkeypatch.setattr(packing, "AT_ONCE", at_once)
    sample = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    got = packing.pieces(table(spark, ODD + sample), capacity=50).collect()
    mine = sorted((r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert mine == sorted(expected(ODD + sample, 50)) and all(r.length * 4 == len(r.ids) for r in got)


def test_a_full_cache_starts_anew(spark, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    e = packing.Encoder()
    t = Tokenizer.from_file(packing.VOCABULARY)
    for text in [x for x in ODD if x and "<|" not in x]:
        import pyarrow as pa

        ids, n = e.many(pa.array([text, None, text]))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids * 2 and n[1] == 0


def fewest(items, capacity):
    best, bins = len(items), []
    items = sorted(items, reverse=True)

    def go(i):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in {*bins}:
            if room + items[i] <= capacity:
                k = bins.index(room)
                bins[k] += items[i]
                go(i + 1)
                bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1)
        bins.pop()

    go(0)
    return best


def test_search_finds_the_fewest_sequences():
    rng = random.Random(5)
    for _ in range(300):
        c = rng.choice([10, 20, 37])
        items = [rng.randint(1, c) if rng.random() < 0.3 else rng.randint(c // 5, c // 2) for _ in range(rng.randint(1, 12))]
        counts = np.bincount(items, minlength=c + 1)
        runs = packing.complete_bins(counts, c, 3000)
        used = np.zeros(c + 1, int)
        for q, p in runs:
            assert sum(x * m for x, m in p.items()) <= c
            for x, m in p.items():
                used[x] += q * m
        assert (used == counts).all()
        least = fewest(items, c)
        assert sum(q for q, _ in runs) == least >= packing.lower_bound(counts, c)


def test_search_does_not_grow_with_the_counts():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.minimum(4096, rng.lognormal(6.3, 1.2, 20_000).astype(int) + 1), minlength=4097)
    for times in (1, 1_000_003):
        runs = packing.complete_bins(counts * times, 4096)
        least = packing.lower_bound(counts * times, 4096)
        assert least <= sum(q for q, _ in runs) <= least * (1 + 1e-6) and len(runs) < 40_000


def test_packed_documents_are_whole(spark):
    texts = [*ODD, *ODD[3:8], *["equal text"] * 300]
    for capacity in (16, 50):
        rows = packing.pack(packing.pieces(table(spark, texts, 7), capacity=capacity), capacity=capacity).collect()
        want = [*expected(texts, capacity)]
        assert sorted((r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted(want)
        runs = packing.complete_bins(np.bincount([len(x[3]) for x in want], minlength=capacity + 1), capacity)
        assert whole(rows, capacity) == sum(q for q, _ in runs) <= packing.lower_bound(np.bincount([len(x[3]) for x in want], minlength=capacity + 1), capacity) + 4


def test_empty_table_and_null_ids(spark):
    assert packing.packed_documents(table(spark, ["a"]).filter("false")).count() == 0
    rows = packing.packed_documents(table(spark, ["a", None, "b"]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(rows) == 3 and whole(rows, 4096) == 1


def test_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_packing(spark, SF).collect()
    want = {(docs[i][0], p): (s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, p, s, x in expected([t for _, t in docs], 4096)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert whole(got, 4096) == -(-sum(v[1] for v in want.values()) // 4096)


# ---- whitening

VECTORS = "vec_id long, embedding array<float>, label int, n string, deviation string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], VECTORS).repartition(parts)


def brute(rows, most=4):
    """By exact sums and a symmetric eigensolver."""
    x = [(i, [math.floor(256 * c) for c in np.array(v, np.float32).astype(np.float64)]) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [*{tuple(v) for _, v in x}]
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    y = np.array([[n * v[j] - s[j] for j in range(d)] for v in fit], object)
    e, u = np.linalg.eigh((y.T @ y).astype(float) / n**3)
    e, u = e[::-1], u[:, ::-1]
    z = {i: (np.array([n * v[j] - s[j] for j in range(d)], float) / n @ u[:, :most] / np.sqrt(np.maximum(e[:most], 1e-300))) for i, v in x}
    return n, {i: sum((n * v[j] - s[j]) ** 2 for j in range(d)) for i, v in x}, z, e / e.sum(), e


def random_rows(rng, n, d, scale=1.0):
    a = rng.standard_normal((n, d)) @ np.diag(scale / np.arange(1, d + 1)) @ np.linalg.qr(rng.standard_normal((d, d)))[0] + rng.standard_normal(d)
    return [(i, a[i].tolist()) for i in range(n)]


def test_whitening_equals_an_eigensolver(spark):
    rng = np.random.default_rng(1)
    rows = random_rows(rng, 120, 7)
    rows += [(1000 + i, rows[i % 3][1]) for i in range(90)]  # copies count once in the fit
    rows += [(2000, None), (2001, []), (2002, [None, *[1.0] * 6]), (2003, [float("nan"), *[1.0] * 6]), (2004, [float("inf"), *[1.0] * 6])]
    got = whitening.digest(whitening.whiten(vectors(spark, rows))).collect()
    n, deviation, z, share, _ = brute(rows)
    assert len(got) == 4 * 210 and {r.vec_id for r in got} == z.keys()
    sign = {}
    for r in sorted(got, key=lambda r: r.vec_id):
        k = r.component - 1
        s = sign.setdefault(k, np.sign(r.whitened * z[r.vec_id][k]))
        assert r.n == n and r.deviation == deviation[r.vec_id] and abs(r.whitened * s - z[r.vec_id][k]) < 1e-9
        assert abs(r.explained / share[k] - 1) < 1e-9 and r.identity_error < 1e-9


def test_factor_and_rotation_keep_small_eigenvalues():
    rng = np.random.default_rng(3)
    q, scale = rng.standard_normal((9, 9)), 10.0 ** (-np.arange(9) / 2)
    a = scale[:, None] * (np.eye(9) + 0.02 * (q + q.T)) * scale  # eigenvalues from 1 to 1e-8
    factor = whitening.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a, rtol=1e-12, atol=1e-17)
    values, vectors_ = whitening.one_sided_jacobi(factor)
    assert np.allclose(vectors_.T @ vectors_, np.eye(9), atol=1e-12) and (np.diff(values) <= 0).all()
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-7, atol=0) and np.allclose(a @ vectors_, vectors_ * values, atol=1e-15)
    low = np.outer([1.0, 2, 3], [1.0, 2, 3])
    assert whitening.pivoted_cholesky(low).shape == (3, 1) and whitening.pivoted_cholesky(np.zeros((2, 2))).shape == (2, 0)


def test_large_entries_and_deviations(spark):
    rng = np.random.default_rng(4)
    rows = random_rows(rng, 40, 3, 3e9)
    rows.append((99, [1e30, 0.0, 0.0]))  # has no exact x
    got = whitening.digest(whitening.whiten(vectors(spark, rows))).collect()
    n, deviation, z, share, _ = brute(rows[:-1])
    assert len(got) == 3 * 40 and all(r.n == n and r.deviation == (d if (d := deviation[r.vec_id]) < 1 << 63 else None) for r in got)
    assert any(r.deviation is None for r in got) and all(abs(abs(r.whitened) - abs(z[r.vec_id][r.component - 1])) < 1e-6 and abs(r.explained / share[r.component - 1] - 1) < 1e-9 for r in got)
    assert (whitening.gram(np.array([[1 << 40, 3], [5, -7]])) == np.array([[(1 << 80) + 25, 3 * (1 << 40) - 35], [3 * (1 << 40) - 35, 58]], object)).all()


def test_vectors_without_variance_and_of_other_lengths(spark):
    rows = [(i, [0.5, 0.25]) for i in range(5)] + [(10 + i, [float(i), 1.0, 2.0 * i]) for i in range(6)] + [(20, [1.0])]
    got = {(r.vec_id, r.component): r for r in whitening.digest(whitening.whiten(vectors(spark, rows))).collect()}
    assert len(got) == 5 * 2 + 6 * 3 + 1
    assert all(got[i, k].whitened is None and got[i, k].explained is None and got[i, k].n == 1 and got[i, k].deviation == 0 and got[i, k].identity_error is None for i in range(5) for k in (1, 2))
    assert all(got[10 + i, 1].n == 6 and abs(got[10 + i, 1].explained - 1) < 1e-12 and got[10 + i, 2].whitened is None and got[10 + i, 2].explained == 0 for i in range(6))
    assert abs(sum(got[10 + i, 1].whitened ** 2 for i in range(6)) / 6 - 1) < 1e-12


def test_whitening_of_an_empty_table_and_null_ids(spark):
    assert whitening.digest(whitening.whiten(vectors(spark, [(1, None)]))).count() == 0
    assert whitening.digest(whitening.whiten(vectors(spark, [(None, [0.0, 1.0]), (None, [1.0, 3.0])]))).count() == 4


def test_whitening_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = queries.op11_whitening(spark, SF).collect()
    n, deviation, z, share, e = brute(rows)
    assert len(got) == 4 * len(rows)
    assert all(r.n == n and r.deviation == deviation[r.vec_id] and abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)
    assert all(abs(abs(r.whitened) - abs(z[r.vec_id][r.component - 1])) < 1e-7 for r in got) or min(-np.diff(e[:5])) / e[0] < 1e-6
