"""Pages, vectors, components and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seawake.llm import components, embedding_dedup, html_extract


def test_page_text():
    t = html_extract.text_of
    assert t(None) == "" and t("") == "" and t("just text") == "just text"
    assert t("<p>a<p>b &amp; c<br>d<ul><li>e<li>f</ul>") == "a\nb & c d\ne\nf"
    page = "<html><head><title>x</title><style>p{}</style></head><body><nav><a>m</a></nav><header>h</header><article><h1>T</h1><p><b>x\n y<br><p>z</p><aside>s</aside><form>f</form><div class='comments'>c</div></article><footer>f</footer>"
    assert t(page) == "T\nx y\nz"
    assert t("<script>var t='<p>no</p>'</script><!-- <p>no</p> --><p>yes</p>") == "yes"
    assert t("<div>" * 3000 + "deep") == "deep"
    assert t("a < b <p title='x>y'>c</p>") == "a < b\nc"


def test_template_text_goes_and_content_stays(spark):
    rng = random.Random(1)
    words = lambda: " ".join(rng.choice("red green blue cyan pink".split()) for _ in range(9))
    pages, want = [], []
    for i in range(60):
        body = [f"story {i}", words(), words()]
        want.append("\n".join(body))
        pages.append((i, f"https://Host.com/{i}", "<body><div>Welcome to the host</div><div class=x>" + "".join(f"<p>{b}</p>" for b in body) + "</div><div>All rights reserved</div></body>", "k"))
    pages += [(100, None, None, "k"), (101, "http://one.org/a", "<div>only page</div>", "k"), (102, "http://one.org/a", "<div>only page</div>", "k")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string").repartition(4)
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert [got[i] for i in range(60)] == want and got[100] == "" and got[101] == got[102] == "only page"
    assert html_extract.main_text(df.limit(0)).count() == 0
    out = html_extract.extract(df.withColumn("text", F.lit("old")))
    assert out.columns == [*df.columns, "text"] and {r.host for r in out.collect()} == {"k"}


def test_constants_in_runs_of_like_siblings_go(spark):
    rng = random.Random(4)
    words = lambda: " ".join(rng.choice("red green blue cyan pink".split()) for _ in range(9))
    pages, want = [], []
    for i in range(40):
        body = [f"story {i}", *(words() for _ in range(rng.choice([1, 3, 40])))]
        want.append("\n".join([f"box {i}", *body, f"cell {i}", f"last {i}"]))
        menu, rows = "".join(f"<li><a href='{k}'>Menu {k}</a>" for k in range(5)), f"<tr><td>Rates<td>cell {i}</tr><tr><td>Fees<td>Same</tr>"
        boxes = f"<div><p>box {i}</p></div><div><p>Sign up now</p><ul><li>Shop</li></ul></div>"
        pages.append((i, f"http://h/{i}", f"<body><ul>{menu}</ul>{boxes}<p>Notice to all</p>{''.join(f'<p>{b}</p>' for b in body)}<p>All rights</p><table>{rows}</table><p>last {i}</p></body>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert [got[i] for i in range(40)] == want


@pytest.mark.parametrize("shipped", [None, 0])
def test_slots_decide_where_names_do_not(spark, monkeypatch, shipped):
    if shipped is not None:
        monkeypatch.setattr(html_extract, "SHIPPED", shipped)
    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice("red green blue cyan pink".split()) for _ in range(n))
    pages, want = [], []
    for i in range(30):
        menu = "".join(f"<li><a href='/{k}'>{words(1)} {i} {k}</a>" for k in range(6))  # other links on every page
        told = f"<div class='ad {i}'>{words(8)} {i}</div><footer>&copy; {words(5)} {i}</footer>"
        body = [f"story {i}", f"{words(30)} {i}", f"{words(12)} {i}"]
        text = f"<h1>{body[0]}</h1><p>{body[1]}</p><p>Sponsored by no one</p><p>{body[2]} <a href=x>see</a></p>"
        pages.append((i, f"http://slots/{i}", f"<html><head><title>t {i}</title></head><body><div><ul>{menu}</ul></div><div class='page has-sidebar'>{text}</div><section>Read on</section>{told}</body></html>"))
        want.append("\n".join([*body[:2], f"{body[2]} see"]))
    pages.append((90, "http://few/", "<nav>menu</nav><p>main</p><div class='has-sidebar'>left out by name</div>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extract.main_text(df).collect()}
    assert [got[i] for i in range(30)] == want and got[90] == "main"
    found = html_extract.templates(df.withColumn(html_extract.HOSTED, F.lit("slots")), []).collect()
    assert {r.path.split("/")[-1] for r in found if r.text == ""} >= {"ul.", "footer.", "div.ad 0"}


def test_every_host_of_the_test_table_has_a_template(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn(html_extract.HOSTED, F.regexp_extract("url", html_extract.HOST, 1))
    hosts = {r[0] for r in df.groupBy(html_extract.HOSTED).count().filter("count >= 8").collect()}
    found = html_extract.templates(df, []).collect()
    assert {r[0] for r in found if r.path} == hosts and len(hosts) > 3
    assert all({"nav.", "div.ad", "footer."} <= {r.path.split("/")[-1] for r in found if r[0] == h and r.path} for h in hosts)
    for r in html_extract.extract(df.drop(html_extract.HOSTED)).collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert r.text == html_extract.text_of(inner)


def test_alignment_is_the_largest(spark):
    rng = random.Random(5)

    def tree(depth, path=""):
        f = html_extract.Fold(f"{path}/{rng.choice('ab')}", 0)
        f.children = [tree(depth - 1, f.path) for _ in range(rng.randint(0, 3))] if depth else []
        return f

    def slot(f):
        s = html_extract.Slot(f.path, 0)
        s.children = [slot(c) for c in f.children]
        return s

    def best(a, b):  # over all choices that keep order
        if a.path != b.path:
            return 0

        def rest(x, y):
            if not x or not y:
                return 0
            return max(rest(x[1:], y), rest(x, y[1:]), (w := best(x[0], y[0])) and w + rest(x[1:], y[1:]))

        return 1 + rest(a.children, b.children)

    for _ in range(200):
        a, b = tree(3), tree(3)
        assert html_extract.matching(slot(a), b) == best(a, b)


def test_copies_of_an_article_are_no_template(spark):
    pages = [(i, "http://h/", f"<nav>{i}</nav><article><h1>Same</h1><p>Same text</p></article>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.text for r in html_extract.main_text(df).collect()} == {"Same\nSame text"}


def brute(rows, least=0.98):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
        if i is not None and label is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[k] = (len(x), label, x / np.linalg.norm(x))
    n, part = [0] * len(rows), list(range(len(rows)))

    def find(a):
        while part[a] != a:
            a = part[a]
        return a

    for a in ok:
        for b in ok:
            if a < b and ok[a][:2] == ok[b][:2] and ok[a][2] @ ok[b][2] >= least:
                n[a] += 1
                n[b] += 1
                part[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(rows[a][0])
    return sorted(((rows[a][0], n[a], min((x for x in groups[find(a)] if x is not None), default=None)) for a in range(len(rows))), key=repr)


@pytest.mark.parametrize("setting", [{}, {"leaf_rows": 16, "block_rows": 20}])
def test_embeddings(spark, setting):
    rng, rows = np.random.default_rng(3), []
    for _ in range(60):
        c = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (c + 0.06 * rng.standard_normal(16)).tolist(), int(rng.integers(0, 2))))
    rows += [(900 + i, rows[0][1], rows[0][2]) for i in range(30)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [1.0, None] + [0.0] * 14, 1), (2004, [float("nan")] * 16, 1), (2005, rows[5][1], None), (None, rows[5][1], rows[5][2]), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (900, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = embedding_dedup.near_duplicates(df, **setting).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept is None if r.vec_id is None else r.kept == (r.vec_id == r.component_id) for r in got)


def test_large_leaves_are_split_until_they_are_small(spark, monkeypatch):
    rng, rows = np.random.default_rng(5), []
    for k in range(500):  # more vectors than the sample of 64 can place in small leaves
        c = rng.standard_normal(24)
        rows += [(3 * k + i, (c + 0.02 * rng.standard_normal(24)).tolist(), 1) for i in range(3)]
    rows += [(5000 + i, (np.ones(24) + 0.001 * rng.standard_normal(24)).tolist(), 1) for i in range(150)]  # no threshold splits these
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    seen, old = [], embedding_dedup.split_large

    def split(placed, leaf_rows, *args, **more):
        out = old(placed, leaf_rows, *args, **more)
        sizes = out.groupBy("leaf").agg(F.count("*").alias("n"), F.max("rep").alias("most")).collect()
        seen.append((placed.groupBy("leaf").count().agg(F.max("count")).first()[0], max(r.n for r in sizes if r.most < 5000)))
        return out

    monkeypatch.setattr(embedding_dedup, "split_large", split)
    got = embedding_dedup.near_duplicates(df, leaf_rows=20, sample=64, block_rows=64).collect()
    want = brute(rows)
    assert sum(r.n_links for r in got) >= 0.9 * sum(n for _, n, _ in want) and all(r.n_links <= n for r, (_, n, _) in zip(sorted(got, key=lambda r: repr((r.vec_id,))), want, strict=True))
    assert {r.vec_id: r.n_links for r in got if r.vec_id >= 5000} == dict.fromkeys(range(5000, 5150), 149)
    assert seen[0][0] > 300 and seen[0][1] <= 80


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    found = sum(r.n_links for r in embedding_dedup.near_duplicates(df).collect())
    assert found >= 0.9 * sum(r[1] for r in brute(rows)) and embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, x) for x in range(1001, 1200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    part = {x: x for e in edges for x in e}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        part[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in part if any(x in e and e[0] != e[1] for e in edges)}


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    assert 0 < len(rows) <= docs.count() and len(ids) == len(rows) and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(r.lossless for r in rows) and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0


def test_stages_keep_columns_and_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.limit(1).collect()[0].asDict()
    odd = [{**first, "doc_id": None}, {**first, "doc_id": None}, {**first, "doc_id": 10_001, "text": None}, {**first, "doc_id": 10_002, "text": ""}, {**first, "doc_id": 10_003, "lang": None}, {**first, "doc_id": 10_004, "text": first["text"] * 300}]
    docs = docs.unionByName(docs.filter("doc_id < 3")).unionByName(spark.createDataFrame(odd, docs.schema))
    for n in ("line_runs", "rejected", "score", "ids", "the row", "key"):
        docs = docs.withColumn(n, F.lit(f"my {n}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert out.columns == docs.columns and 0 < len(rows) <= docs.count(), name
        assert all(r[n] == f"my {n}" for r in rows for n in ("line_runs", "rejected", "score", "ids", "the row", "key")), name
        if name == "jaccard_join":
            ids = [r.doc_id for r in rows if r.doc_id is not None]
            assert len(ids) == len({*ids}) and sum(r.doc_id is None for r in rows) == 2 and {10_001, 10_002} <= {*ids}
        if name == "decontamination":
            assert len(rows) == docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == docs.count() and all(r.lossless for r in last)
