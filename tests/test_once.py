"""What several parts of a plan read is computed once, and workers hold few texts at a time."""

import pytest

from seawake import queries
from seawake.plans import dispatch, retrieval

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["carbon_diagnostics", "carbon_bands", "port_emission_answers"])
def test_segments_are_computed_once(spark, name):
    assert "Window" not in plan(queries.QUERIES[name](spark, SF))


def test_questions_read_arrivals_and_index_computed_once(spark, monkeypatch):
    seen = []

    class Seen(Exception):
        pass

    def stop(asked, daily, index, *rest):
        seen.extend((daily, index))
        raise Seen

    monkeypatch.setattr(dispatch, "from_comparison", stop)
    with pytest.raises(Seen):
        queries.QUERIES["answered_questions"](spark, SF)
    assert not any("parquet" in plan(df) for df in seen)


def test_pages_go_through_workers_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAGES", 3, raising=False)
    pages = [(i, None if i == 4 else f"<header>h</header><p>{i} &amp; {'x ' * 700 * (i % 3)}</p>") for i in range(20)]
    out = retrieval.web_chunks(spark.createDataFrame(pages, "page_id long, html string").coalesce(2))
    assert "MapInArrow" in plan(out) and "Python UDF" not in plan(out) and "visible(html" not in plan(out)
    want = {(i, k, t[1000 * k : 1000 * k + 1200]) for i, page in pages for t in [retrieval.visible_text(page)] for k in range(-(-len(t) // 1000))}
    assert {(r.page_id, r.chunk_index, r.chunk) for r in out.collect()} == want
