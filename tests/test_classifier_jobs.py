import pytest

from quillon import catalog
from quillon.operators import boosting, classifiers


class Seen(Exception):
    pass


@pytest.mark.parametrize(("name", "want"), [("lr_concat", {"maxIter": 1000}), ("rf_subtract", {"numTrees": 20, "maxDepth": 15})])
def test_registered_classifiers_train_on_all_classes(spark, monkeypatch, name, want):
    def fit(data, estimator, classes):
        inner = estimator.getClassifier() if estimator.hasParam("classifier") else estimator
        raise Seen(classes, {k: inner.getOrDefault(k) for k in want})

    monkeypatch.setattr(classifiers, "fit_scores", fit)
    with pytest.raises(Seen) as seen:
        catalog.QUERIES[f"{name}_metrics"](spark, "/root/testdata/sf0.001")
    assert seen.value.args == (catalog.CLASSES, want)


@pytest.mark.parametrize("how", ["concat", "subtract"])
def test_registered_boosting_trains_on_all_classes(spark, monkeypatch, how):
    def fit(pairs, classes, settings):
        raise Seen(classes, settings, pairs.count())

    monkeypatch.setattr(boosting, "fit", fit)
    with pytest.raises(Seen) as seen:
        catalog.QUERIES[f"gbt_{how}_metrics"](spark, "/root/testdata/sf0.001")
    assert seen.value.args == (catalog.CLASSES, boosting.Settings(rounds=15), catalog.QUERIES["split_sizes"](spark, "/root/testdata/sf0.001").agg({"n": "sum"}).first()[0])
