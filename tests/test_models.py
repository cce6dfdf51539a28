"""Rows that models are fitted on are computed once."""

import pytest

from seawake import queries
from seawake.plans import learning


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["destination_predictions", "destination_metrics", "eta_predictions", "eta_metrics"])
def test_models_do_not_read_the_source_at_each_pass(spark, monkeypatch, name):
    def stop(rows, *a, **b):
        raise Seen(rows._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(learning, "train_eta", stop)
    monkeypatch.setattr(learning, "train_destination", stop)
    with pytest.raises(Seen) as seen:
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "parquet" not in str(seen.value)
