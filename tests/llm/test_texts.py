"""Operators on documents against brute force on small tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from seawake.llm import bpe_dropout, components, decontaminate, jaccard_join, language_id, line_dedup, quality, secret_scan, token_count, vocab, words
from seawake.llm.words import shingles

DOCS = "doc_id long, text string, key string, spans string, lang string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "Ünïcödé wörds ▁ and  spaces", "x" * 3000, "the " * 2000, "日本語 テキスト 😀"]


def table(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "k", None, "en", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(parts)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def sample():
    import pandas as pd

    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.tolist()


# ---- line dedup


def repeats(docs, least=50):
    """Later runs of lines that occur earlier, of at least `least` words: brute force over all pairs of places."""
    seqs = [(i, [x.strip() for x in (t or "").split("\n") if x.strip()]) for i, t in docs]
    places, found = defaultdict(list), []
    for k, (i, s) in enumerate(seqs):
        for p, line in enumerate(s):
            for k2, p2 in places[line]:
                o, n, w = seqs[k2][1], 0, 0
                while p + n < len(s) and p2 + n < len(o) and s[p + n] == o[p2 + n]:
                    w, n = w + len(s[p + n].split()), n + 1
                if w >= least:
                    found.append((i, p, n))
            places[line].append((k, p))
    return found


def lines(rng, n, words=12):
    return [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(words)) for _ in range(n)]


def test_line_dedup_leaves_no_run_and_no_loss(spark):
    rng = random.Random(3)
    shared, docs = lines(rng, 8), []
    long = " ".join(f"w{i}" for i in range(60))
    for i in range(30):
        own = lines(rng, 6)
        docs.append("\n".join(own[:3] + (shared[i % 3 : i % 3 + 5] if i % 2 else []) + [""] + own[3:] + ([long] if i % 5 == 0 else []) + ["short line"]))
    got = by_id(line_dedup.deduplicated(table(spark, docs)))
    assert not repeats([(i, got[i].text) for i in range(30)])
    assert got[0].text == docs[0] and got[2].text == docs[2]
    assert sum(long in r.text for r in got.values()) == 1 and all("short line" in r.text for i, r in got.items() if i % 5)
    kept = {x for r in got.values() for x in r.text.split("\n")}
    assert kept >= {x for d in docs for x in d.split("\n")}
    assert {i for i, r in got.items() if r.n_removed} == {i for i, _, _ in repeats(list(enumerate(docs)))}


def test_runs_shared_behind_a_shorter_first_copy_go(spark):
    rng, docs = random.Random(11), []
    for _ in range(25):
        run = lines(rng, rng.choice([2, 4, 6]), rng.choice([9, 16, 30]))
        for _ in range(rng.randint(2, 3)):  # parts of a run, some too short to be repeats
            a = rng.randrange(len(run))
            docs.append(lines(rng, 2) + run[a : a + rng.randint(1, 3)] + lines(rng, 2))
        docs += [lines(rng, rng.randint(0, 2)) + run + lines(rng, rng.randint(0, 2)) for _ in range(3)]
    docs = ["\n".join(d) for d in docs]
    gone = defaultdict(set)
    for i, p, n in repeats(list(enumerate(docs))):
        gone[i].update(range(p, p + n))
    got = by_id(line_dedup.deduplicated(table(spark, docs)))
    assert {i: r.text for i, r in got.items()} == {i: "\n".join(x for p, x in enumerate(d.split("\n")) if p not in gone[i]) for i, d in enumerate(docs)}


def test_winnowing_guarantee():
    rng = random.Random(1)
    h = np.array([rng.getrandbits(64) for _ in range(60)], np.uint64)
    for window in (2, 4, 7):
        at = {p for _, p in line_dedup.fingerprints(h, [1] * 60, 3, window, 50)}
        assert all(any(q in at for q in range(p, p + window)) for p in range(60 - 3 - window + 2))


def test_line_dedup_odd_rows(spark):
    same = "\n".join(lines(random.Random(5), 6))
    texts = [*ODD, same, same]
    df = table(spark, texts)
    df = df.unionByName(df.filter("doc_id = 9")).unionByName(spark.createDataFrame([(None, "b", "k", None, "en", 1)], DOCS))
    out = line_dedup.dedup_lines(df)
    rows = out.collect()
    assert out.columns == [*df.columns, "line_runs"] and len(rows) == len(texts) + 2
    first = [r for r in rows if r.doc_id == 9]
    assert [r.text for r in first] == [same, same]
    assert next(r for r in rows if r.doc_id == 10).text == "" and next(r for r in rows if r.doc_id == 10).n_chars == 0
    assert {r.doc_id: r.text for r in rows if r.doc_id is not None and r.doc_id < 9} == dict(enumerate(ODD))
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


# ---- token counts


def test_token_counts_equal_the_tokenizer(spark, sample):
    normal, _ = vocab.pieces(vocab.read_model())
    words = [("<unk>", 0.0)] + [(p, s) for p, (_, s) in normal.items()] + [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    t = Tokenizer(models.Unigram(words, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    texts = [*ODD, *sample[:60]]
    got = by_id(token_count.count_tokens(table(spark, texts)))
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(t.encode(x).ids) if x else 0 for i, x in enumerate(texts)}
    assert token_count.count_tokens(table(spark, texts).limit(0)).count() == 0


# ---- decontamination


def leaks(docs, items, window=10):
    phrases = defaultdict(set)
    for item, t in items:
        w = decontaminate.words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases[tuple(w[i : i + window])].add(str(item) if item is not None else "null")
    out = []
    for i, t in docs:
        w, hit, found = decontaminate.words(t), set(), set()
        for p, owners in phrases.items():
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a : a + len(p)]) == p:
                    hit.update(range(a, a + len(p)))
                    found |= owners
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("setting", [{}, {"shard_tokens": 40}, {"block_bytes": 60, "shard_tokens": 30}])
def test_decontamination(spark, setting):
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "Delta", "é9"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([14, 12, 3, 1, 0, 25])] + [(None, None), (7, "..."), (0, "other words here")]
    docs = [" ".join(word() if rng.random() < 0.97 else "zzz" for _ in range(n)) for n in (0, 5, 60, 200)] + [f"Intro, {items[0][1].upper().replace("É", "é")}! end {items[1][1]}", items[5][1] * 2, "alpha", *ODD]
    d = table(spark, docs)
    d = d.unionByName(d.filter("doc_id = 4"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.digest(decontaminate.find_leaks(d, b, **setting)).collect())
    assert got == sorted(leaks([*enumerate(docs), (4, docs[4])], items))
    clean = decontaminate.remove_leaks(d, b.filter("item_id in (0, 1)"), **setting)
    assert clean.columns == d.columns and clean.count() == d.count()
    rest = by_id(clean)
    assert rest[4].text == "Intro, end" or rest[4].text == "Intro, ! end"
    assert rest[4].n_chars == len(rest[4].text) and rest[6].text == "alpha" and rest[7].text is None
    assert decontaminate.digest(decontaminate.find_leaks(d.limit(0), b)).count() == 0
    assert not decontaminate.digest(decontaminate.find_leaks(d, b.limit(0))).filter("contaminated").count()


def test_removal_does_not_depend_on_the_blocks(spark):
    w = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(w[9 * i : 9 * i + 14])) for i in range(30)]  # every item overlaps the next
    docs = [" ".join(["before", *w[9 * a : 9 * a + n], "after"]) for a, n in [(0, 40), (3, 12), (7, 100), (20, 23), (1, 5)]] + [None, "", f"x {items[2][1]} y"]
    d = table(spark, docs)
    d = d.unionByName(d.filter("doc_id in (0, 4)"))
    b = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(tuple(r) for r in decontaminate.remove_leaks(d, b, **s).select("doc_id", "text", "n_chars").collect()) for s in ({}, {"block_bytes": 200}))
    assert one == many and len(one) == 10 and [r[1] for r in one if r[0] == 7] == ["x y"]
    left = decontaminate.find_leaks(d, b, block_bytes=200).filter("size(hits) > 0").select("doc_id").distinct().count()
    assert left == sum(r[1] != docs[r[0]] for r in {*one})


# ---- quality


def test_ordinal_regression(spark):
    rng = random.Random(4)
    docs, grades = [], []
    for i in range(400):
        g = i % 3
        docs.append(" ".join([rng.choice("one two three four five six".split()) for _ in range(20)] + ["awful"] * (g == 0) + ["superb"] * (g == 2)))
        grades.append(g)
    d = table(spark, docs + ["", None])
    r = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i < 300] + [(None, 1), (5000, 2), (1, None)], "doc_id long, g int")
    model = quality.fit(d, r, F.col("g"))
    assert list(model.threshold) == sorted(model.threshold)
    got = by_id(quality.score(d, model))
    assert all(round(got[i].expected_grade) == grades[i] for i in range(300, 400))
    assert all((got[i].tail > 0.5) == (grades[i] == 2) for i in range(300, 400))
    assert got[400].tail == got[401].tail == 0.0
    one = quality.fit(d, r.filter("g = 1"), F.col("g"))
    assert by_id(quality.score(d, one))[0].expected_grade == 1.0
    none = quality.fit(d, r.limit(0), F.col("g"))
    assert by_id(quality.score(d, none))[0].expected_grade == 0.0


def test_quality_catches_toxic_and_keeps_clean(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    rating = F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1)
    scored = quality.score(d, quality.fit(d, labels.filter(half), rating)).join(labels.filter(~half), "doc_id").collect()
    right = [(r.tail >= 0.5) == (r.toxic == 0 and r.quality == 1) for r in scored]
    assert sum(right) / len(right) > 0.9


# ---- n-gram Jaccard


def classes(docs, percent=80):
    """(set size, smallest document of the component, links) of each document, each with one text."""
    sets = {i: {*shingles((t or "").encode()).tolist()} for i, t in docs}
    part, linked = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
                linked[a] += 1
                linked[b] += 1
    return {i: (len(sets[i]), find(i), linked[i]) for i in ids}


@pytest.mark.parametrize("choice", [(2, 1), (3, 1), (1, 0)])
def test_signatures_are_shared_by_all_similar_sets(choice):
    rng, bands, none = random.Random(9), jaccard_join.Bands(80), np.empty(0, np.uint64)
    for _ in range(600):
        n = rng.choice([4, 5, 6, 9, 15, 40, 120, 500])
        common = [rng.getrandbits(64) for _ in range(n)]
        extra = rng.randint(0, n // 4)
        a, b = common + [rng.getrandbits(64) for _ in range(extra // 2)], common + [rng.getrandbits(64) for _ in range(extra - extra // 2)]
        assert 100 * n >= 80 * (n + extra)
        hot = np.sort(np.array(rng.sample(common, n // 3), np.uint64)) if rng.random() < 0.3 else none
        x, y = (np.sort(np.array(s, np.uint64)) for s in (a, b))
        if extra:
            assert np.intersect1d(jaccard_join.signatures(x, bands, *choice, hot), jaccard_join.signatures(y, bands, *choice, hot)).size
        differ = np.unpackbits((jaccard_join.sketch(x) ^ jaccard_join.sketch(y)).view(np.uint8)).sum() if n < 400 else 0
        assert differ <= extra


@pytest.mark.parametrize("shipped", [None, 0])
def test_jaccard_join(spark, monkeypatch, shipped):
    if shipped is not None:
        monkeypatch.setattr(jaccard_join, "SHIPPED", shipped)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    docs = []
    for _ in range(12):
        w = [word() for _ in range(rng.choice([6, 10, 40, 150]))]
        for _ in range(rng.randint(1, 9)):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                v[rng.randrange(len(v))] = word()
            docs.append(" ".join(v).upper() if rng.random() < 0.2 else " ".join(v))
    docs += ["a b", "A  B", "a b c", *ODD, None, ""]
    d = table(spark, docs)
    extra = spark.createDataFrame([(None, docs[0], "k", None, "en", 1), (None, docs[0], "k", None, "en", 1)], DOCS)
    d = d.unionByName(d.filter("doc_id < 3")).unionByName(extra)
    rows = jaccard_join.near_duplicates(d).collect()
    want = classes(list(enumerate(docs)))
    assert len(rows) == d.count() and {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in rows if r.doc_id is not None} == want
    assert [(r.n_shingles, r.component_id, r.n_links) for r in rows if r.doc_id is None] == [(want[0][0], None, 0)] * 2
    left = jaccard_join.one_of_each(d)
    assert left.columns == d.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == [-1, -1, *sorted(i for i, (_, c, _) in want.items() if i == c)]
    assert jaccard_join.near_duplicates(d.limit(0)).count() == 0


def test_jaccard_join_of_large_groups(spark):
    rng = random.Random(16)
    text = lambda n: " ".join(str(rng.getrandbits(30)) for _ in range(n))
    copied, base, passage = text(60), [*text(120).split()], text(40)
    docs = [copied] * 1500
    for _ in range(150):  # near copies, some too far from each other
        v = list(base)
        for _ in range(rng.randint(1, 3)):
            v[rng.randrange(len(v))] = text(1)
        docs.append(" ".join(v))
    docs += [f"{text(30)} {passage} {text(30)}" for _ in range(100)]  # one passage quoted by unlike texts
    docs += [text(rng.choice([5, 6, 7, 8, 9])) for _ in range(80)]  # small sets, lame among them
    docs += [" ".join(docs[-k].split()[:-1]) for k in range(1, 20)]
    rng.shuffle(docs)
    got = by_id(jaccard_join.near_duplicates(table(spark, docs, 5)))
    first = {}
    for i, t in enumerate(docs):
        first.setdefault(t, []).append(i)
    some = classes([(ids[0], t) for t, ids in first.items()])
    sets = {t: {*shingles(t.encode()).tolist()} for t in first}
    for t, ids in first.items():
        near = sum(len(first[u]) for u in first if 100 * len(sets[t] & sets[u]) >= 80 * len(sets[t] | sets[u])) - 1
        for i in ids:
            assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (*some[ids[0]][:2], near)


def test_rows_that_share_an_id_are_one_document(spark):
    rng = random.Random(26)
    a, b, c = (" ".join(str(rng.getrandbits(30)) for _ in range(40)) for _ in range(3))
    rows = [(5, a), (5, b), (3, b), (4, c), (4, c), (9, a), (7, c + " x")]
    d = spark.createDataFrame([(i, t, "k", None, "en", 1) for i, t in rows], DOCS)
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in jaccard_join.near_duplicates(d).collect())
    assert got == [(3, 3, 1), (4, 4, 1), (4, 4, 1), (5, 3, 1), (5, 3, 1), (7, 4, 1), (9, 3, 1)]
    assert sorted(r.doc_id for r in jaccard_join.one_of_each(d).collect()) == [3, 4]


# ---- secrets


def test_secret_scan(spark):
    import re

    hexed = "0123456789abcdef" * 2
    texts = [*ODD, f'PassWord = "hunter2secret" é {hexed} AKIA{"A1" * 10}', "token: token: abcdefgh", "api_key=abc", "apikey='abcdefg'", f"xx{hexed}yy ghp_{'a1' * 18}", "secret" * 50, "AKIA AKIAB", "-----BEGIN RSA PRIVATE KEY-----", "token=abcdef" * 3]
    d = table(spark, texts)
    got = by_id(secret_scan.digest(secret_scan.scan(d)))
    for i, t in enumerate(texts):
        spans = []
        for k, r in enumerate(secret_scan.RULES):
            spans += [(m.start(), k, r.kind, m.end()) for m in re.finditer(r.pattern, t or "") if len(m[r.group]) >= r.least]
        show = lambda s: ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(s))
        assert got[i].spans == show(spans), t
        assert got[i].base_sha256 == hashlib.sha256(show([s for s in spans if s[2] in secret_scan.BASE]).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[2] == k for s in spans) for k in secret_scan.BASE)
    assert secret_scan.trigram_query(r"[0-9a-f]+") == []
    assert secret_scan.trigram_query("AKIA[A-Z]+") == [[frozenset({"aki", "kia"})]]
    plan = secret_scan.digest(secret_scan.scan(d))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert secret_scan.scan(d.limit(0)).count() == 0


# ---- merge-dropout


def test_dropout_is_lossless_varied_and_repeatable(spark, sample):
    m = vocab.read_model()
    sp, plain = sentencepiece.SentencePieceProcessor(model_proto=m), bpe_dropout.Encoder(m, 0.0)
    for t in [x for x in ODD if x] + sample[:40]:
        if vocab.SPACE not in t:
            assert plain.encode(t) == sp.encode(t)
        assert plain.decode(plain.encode(t)) == t
    texts = [*ODD, *sample[:40]]
    d = table(spark, texts)
    a, b, c = (by_id(bpe_dropout.round_trip(x, seed=s)) for x, s in ((d, 1), (d.repartition(2), 1), (d, 2)))
    assert all(r.lossless for r in a.values()) and a == b and sum(a[i].ids != c[i].ids for i in a) > 20
    assert a[0].ids is None and a[1].ids == [] and bpe_dropout.encode(d).columns == [*d.columns, "ids"]
    assert bpe_dropout.round_trip(d.limit(0)).count() == 0


def test_both_ways_to_merge_agree():
    e, rng = bpe_dropout.Encoder(vocab.read_model(), 0.3, 5, 2), random.Random(8)
    for _ in range(200):
        w, k = vocab.SPACE + "".join(rng.choice("abetinorsé") for _ in range(rng.randint(1, 40))), rng.getrandbits(64)
        one = e.merge(w, k)
        assert one == e._merge_long(w, k) and e._ids(one) == e.merge_many([w, "ab"], np.array([k, 1], np.uint64))[0]


def test_every_occurrence_draws_its_own_skips(sample):
    e, m = bpe_dropout.Encoder(vocab.read_model(), 0.1, 3), 1500
    for text in ("segmentation " * m, "日本語the " * m):
        words = e.chunks(text)
        one = [e._ids(e.merge(w, int(k))) for w, k in zip(words, e.keys(text, len(words)), strict=True)]
        assert e.encode_many([text])[0] == b"".join(one) and len({*one}) > 4  # the segmentations of a word in one text
    texts = [*sample[:30], *(x for x in ODD if x)]
    small = bpe_dropout.Encoder(vocab.read_model(), 0.1, 3, 50)
    whole = e.encode_many(texts)
    assert whole == [small.encode_many([t])[0] for t in texts] and [e.decode(np.frombuffer(x, "<i4").tolist()) for x in whole] == texts


# ---- language


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.predicted(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == d.count() and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in held) <= len(held) / 100 and all(0 <= r.score <= 1 for r in rows)
    model = language_id.fit(d, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "the of and that"), (5, "ЖЖЖЖ ЩЩЩЩ")], "doc_id long, text string")
    got = by_id(language_id.identify(odd, model))
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[4].lang_pred == "en" and not got[4].rejected and got[5].rejected
    assert {r.lang_pred for r in language_id.predicted(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_what_is_in_no_learned_language_is_rejected(spark):
    d, rng = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), random.Random(1)
    known = language_id.fit(d, ~language_id.held_out())
    random_words = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(80))
    code = '#include <stdio.h>\nint main(void) { for (int i = 0; i < 10; i++) { printf("%d", i); } return 0; } static char *buf = malloc(sizeof(char) * len); if (!buf) exit(1);'
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    swahili = "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu. Kila mtu anastahili kuwa na haki zote na uhuru wote ambao umeelezwa katika Taarifa hii bila ubaguzi wa aina yo yote."
    assert [x[2] for x in known.predict([random_words, code, finnish, swahili])] == [True] * 4
    for left_out in ("es", "fr"):
        model = language_id.fit(d, (F.col("lang") != left_out) & ~language_id.held_out())
        texts = [r.text for r in d.filter((F.col("lang") == left_out) & (F.length("text") > 400)).limit(300).collect()]
        assert sum(x[2] for x in model.predict(texts)) > 0.95 * len(texts)


def test_language_of_odd_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    d = d.unionByName(d.limit(5)).unionByName(spark.createDataFrame([(None, "the of and that", "en"), (None, None, None), (7, "x" * 50_000, None)], d.schema))
    clash = d.withColumn("lang_pred", F.lit("mine")).withColumn("score", F.lit(-1.0)).withColumn("rejected", F.lit("no"))
    out = language_id.identify(clash, language_id.fit(clash, F.lit(True)))
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"] and len(rows) == d.count() and "mine" not in {r.lang_pred for r in rows}
    assert len({(r.doc_id, r.text): r.lang_pred for r in rows}) == len({(r.doc_id, r.text, r.lang_pred) for r in rows})
    flat = language_id.Model(["a", "b"], np.array([0, 1]), np.ones((2, 4096), np.float32) / 64, np.ones(4096, np.float32), np.zeros((2, language_id.CLASSES)))
    assert flat.predict(["equally near"])[0][0] == "a"


# ---- odd rows


def test_null_ids_repeated_and_long_rows(spark):
    texts = [(1, "some words here"), (None, "some words here"), (None, None), (1, "some words here"), (2, ""), (3, "long words " * 30_000), (None, 'password = "abcdefgh"')]
    d = spark.createDataFrame([(i, t, "k", None, "en", 1) for i, t in texts], DOCS).repartition(3)
    rated = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (None, 1)], "doc_id long, g int")
    model = quality.fit(d, rated, F.col("g"), least_rows=1)
    for out in (token_count.count_tokens(d), secret_scan.digest(secret_scan.scan(d)), bpe_dropout.round_trip(d), quality.score(d, model)):
        rows = [tuple(str(x) for x in r) for r in out.collect()]
        assert len(rows) == len(texts) and sorted(r[0] for r in rows) == sorted(str(i) for i, _ in texts)
        assert len({r[1:] for r in rows if r[0] == "1"}) == 1 and {r[1:] for r in rows if r[0] == "1"} <= {r[1:] for r in rows if r[0] == "None"}
    clash = d.withColumn("ids", F.lit("mine"))
    out = bpe_dropout.decode(bpe_dropout.encode(clash).withColumn("decoded", F.lit("mine")))
    assert out.columns == [*d.columns, "ids", "decoded"] and all(r.decoded == r.text for r in out.collect())


def test_jaccard_join_signs_once_and_joins_large_buckets_in_turns(spark, monkeypatch):
    calls, postings = [], jaccard_join._postings
    monkeypatch.setattr(jaccard_join, "_postings", lambda *a: calls.append(1) or postings(*a))
    monkeypatch.setattr(jaccard_join, "LARGE", 0, raising=False)
    monkeypatch.setattr(jaccard_join, "TURNS", 1, raising=False)
    rng = random.Random(36)
    base, docs = [str(rng.getrandbits(30)) for _ in range(100)], []
    for _ in range(30):  # some too far from each other, so that their buckets stay open
        v = list(base)
        for _ in range(rng.randint(1, 4)):
            v[rng.randrange(len(v))] = str(rng.getrandbits(30))
        docs.append(" ".join(v))
    got = by_id(jaccard_join.near_duplicates(table(spark, docs)))
    assert {i: (r.n_shingles, r.component_id, r.n_links) for i, r in got.items()} == classes(list(enumerate(docs)))
    assert len(calls) == 1


def test_shared_signatures_stream_in_any_batches(spark):
    rows = [(1, 5), (2, 4), (2, 3), *((3, i) for i in range(9)), (4, 7), (4, 7), (5, 8), (5, 1), (5, 2), (6, 2), (6, 6)]
    for size in (1, 2, 3, 5, 100):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {(*r,) for r in jaccard_join._shared(spark.createDataFrame(rows, "sig long, doc_id long"), 3).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {(None, 3, 4, 1), (None, 2, 6, 1), *((3, i, None, 1) for i in range(9)), *((5, i, None, 1) for i in (1, 2, 8))}


def test_rounds_of_joins_keep_the_guess_of_sizes_small(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    joined = edges
    for _ in range(3):
        found = components.components(joined)
        joined = words.cut(found.join(found.withColumnsRenamed({"node": "other"}), "component").filter("node < other AND other < node + 3").select(F.col("node").alias("a"), F.col("other").alias("b")))
    assert words.size_bits(joined) <= 512 and words.size_bits(components.components(joined)) <= 2048
    assert sorted((r.node, r.component) for r in components.components(joined).collect()) == [(i, 0) for i in range(61)]


def test_tables_of_unknown_size_keep_rows_and_types(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, [1, None], "é"), (None, 2.5, None, None), (1, None, [1, None], "é")], "a long, `the b` double, s array<long>, t string").repartition(3)
    monkeypatch.setattr(words, "GUESS_BITS", 0)
    got = words.cut(df)
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect())) and words.size_bits(got) == 63


def test_jaccard_join_tests_few_pairs_of_large_buckets_at_once(spark, monkeypatch):
    """Turns are for more pairs than can be tested at once; they start from a bucket's largest component and end alike."""
    rng = random.Random(36)
    base, docs = [str(rng.getrandbits(30)) for _ in range(100)], []
    for _ in range(30):
        v = list(base)
        for _ in range(rng.randint(1, 4)):
            v[rng.randrange(len(v))] = str(rng.getrandbits(30))
        docs.append(" ".join(v))
    turns, across = [], jaccard_join._across
    monkeypatch.setattr(jaccard_join, "_across", lambda *a: turns.append(1) or across(*a))
    monkeypatch.setattr(jaccard_join, "LARGE", 0)
    for pairs in (jaccard_join.PAIRS, -1):
        monkeypatch.setattr(jaccard_join, "PAIRS", pairs)
        got = by_id(jaccard_join.near_duplicates(table(spark, docs)))
        assert {i: (r.n_shingles, r.component_id, r.n_links) for i, r in got.items()} == classes(list(enumerate(docs)))
        assert bool(turns) == (pairs < 0)


def test_jaccard_join_pairs_what_is_outside_the_largest_component(spark):
    named = spark.createDataFrame([(s, r, 0 if r < 90 else r) for s in range(3) for r in range(100)], "sig long, rep long, c long")
    for turn in range(3):
        rows = jaccard_join._across(named, spark.createDataFrame([(0,), (2,)], "sig long"), turn).collect()
        assert {r.b for r in rows} == {*range(90, 100)} and len({r.a for r in rows}) == 1 and rows[0].a < 90
    joined = spark.createDataFrame([(0, 0), (4, 0), (5, 5), (7, 5), (8, 8), (9, 8)], "node long, c long")
    more = spark.createDataFrame([(7, 20), (4, 20), (30, 31)], "a long, b long")
    assert {(*r,) for r in jaccard_join._renamed(joined, more).collect()} == {(0, 0), (4, 0), (5, 0), (7, 0), (20, 0), (8, 8), (9, 8), (30, 30), (31, 30)}


@pytest.mark.parametrize(("sets", "tested", "batch"), [(512, 1 << 17, 10000), (16, 50, 7)])
def test_jaccard_join_makes_no_row_for_each_bucket_that_a_pair_shares(spark, monkeypatch, sets, tested, batch):
    """Two components of one group share 20 buckets: a forest has at most a pair of them for a block, and all pairs are one row each."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", sets)
    monkeypatch.setattr(jaccard_join, "TESTED", tested, raising=False)
    rng = random.Random(46)
    new = lambda k: [rng.getrandbits(63) for _ in range(k)]
    base, rows = new(505), []
    for rep in range(60):  # with sketches of two sizes
        v = np.array(base[rng.randint(1, 60) :] + new(rng.randint(1, 60)), np.uint64)
        odd = jaccard_join.sketch(np.sort(v)).tolist()
        rows += [(sig, 60, rep, rep // 30 if rep < 50 else rep, len(v), odd) for sig in range(20)]
    rows += [(sig, 2, rep, rep, 400, jaccard_join.sketch(np.array(new(400), np.uint64)).tolist()) for sig in range(20, 40) for rep in (sig * 10, sig * 10 + 1)]
    assert len({len(r[5]) for r in rows}) == 2
    rows = spark.createDataFrame(rows, "sig long, m long, rep long, c long, n long, odd array<long>")
    x, y = (rows.select("sig", F.col("rep").alias(s), F.col("c").alias(f"c{s}"), F.col("n").alias(f"n{s}"), F.col("odd").alias(f"odd{s}")) for s in "ab")
    every = x.join(y, "sig").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & jaccard_join._possible(80)).select("a", "b", "ca", "cb").collect()
    want = {(r.a, r.b) for r in every}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        low = rows.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, jaccard_join.LOW).alias("low"))
        whole = [(r.a, r.b) for r in jaccard_join._pairs(rows.join(low, "rep"), 80).collect()]
        forest = [(*r,) for r in jaccard_join._pairs(rows, 80).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(every) == 20 * len(want) > 0 and sorted(whole) == sorted(want)
    c = {r.rep: r.c for r in rows.select("rep", "c").distinct().collect()}
    blocks = -(-60 // sets) * (-(-60 // sets) + 1) // 2
    assert {p[1:] for p in forest} <= want and len(forest) <= 20 * 11 * blocks
    for sig in range(20):  # what it joins is what all pairs join
        joined = [components_of([(c[a], c[b]) for a, b in pairs]) for pairs in ([p[1:] for p in forest if p[0] == sig], want)]
        assert joined[0] == joined[1]


def components_of(edges):
    least = {v: v for e in edges for v in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_workers_keep_nothing_of_other_operators(spark):
    docs = table(spark, ["a b c"] * 4, 1)

    def held(keeps):
        def task(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([len(words.KEPT)] * len(batch))], ["n"])

        return max(r.n for r in docs.select("doc_id").mapInArrow(words.tidy(task, keeps), "n long").collect())

    assert bpe_dropout.encode(docs).count() == 4 and bpe_dropout.encode(docs).agg(F.sum(F.size("ids"))).first()[0] > 0
    assert held("bpe_dropout") == 1  # one core and partition, so one worker
    assert held(None) == 0


def test_tasks_take_batches_in_parts():
    batch = pa.RecordBatch.from_pydict({"x": [*range(10)]})
    got = [*words.parts(iter([batch, batch.slice(0, 0), batch]), 4)]
    assert [len(b) for b in got] == [4, 4, 2, 4, 4, 2] and pa.Table.from_batches(got)["x"].to_pylist() == [*range(10)] * 2
