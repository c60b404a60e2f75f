"""Queries that cover their whole tables and train as long as surveyed."""

import pytest

from quillon import catalog
from quillon.operators import boosting, cpd, projector
from quillon.plans import graph

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["enclosing_subgraph_sizes", "drnl_labels"])
def test_every_edge_is_a_pair(spark, name):
    rows = catalog.QUERIES[name](spark, SF).select("pair").distinct().count()
    assert rows == graph.coded_edges(spark, SF).count() > 1000


class Seen(Exception):
    pass


def seen(spark, monkeypatch, module, function, name) -> tuple[tuple, dict]:
    """What the query gives the function."""

    def stop(*args, **kwargs):
        raise Seen(args, kwargs)

    monkeypatch.setattr(module, function, stop)
    with pytest.raises(Seen) as got:
        catalog.QUERIES[name](spark, SF)
    return got.value.args


def test_the_grid_trains_fifty_rounds(spark, monkeypatch):
    assert seen(spark, monkeypatch, cpd, "fit_configs", "cpd_grid_search")[1]["rounds"] == 50


@pytest.mark.parametrize("how", ["concat", "subtract"])
def test_boosting_stops_by_validation_loss(spark, monkeypatch, how):
    (_, _, settings), _ = seen(spark, monkeypatch, boosting, "fit", f"gbt_{how}_metrics")
    assert (settings.rounds, settings.patience) == (300, 10)


def test_the_projector_trains_as_surveyed(spark, monkeypatch):
    got = seen(spark, monkeypatch, projector, "fit", "mlp_projector_training")[1]
    assert {k: got[k] for k in ("out", "hidden", "epochs", "batch", "dropout")} == {"out": 512, "hidden": 512, "epochs": 20, "batch": 4096, "dropout": 0.3}
