"""Forests over coded blocks: cuts and leaves against a direct search, upper levels cut in passes, and the whole against plain numbers."""

import numpy as np
import pytest

from quillon.operators import classifiers, coded, forest


def test_best_cut_is_the_purest():
    rng = np.random.default_rng(0)
    bins, y, w = rng.integers(0, 6, (3, 80)).astype(np.uint8), rng.integers(0, 4, 80), rng.integers(1, 4, 80).astype(float)
    k, c, a, b = forest.best_cut(forest.histogram(bins, y, w, 6, 4), 5)

    def gini(on):
        n = np.bincount(y[on], w[on], 4)
        return n.sum() - n @ n / n.sum() if n.sum() else 0.0

    cuts = {(i, j): gini(bins[i] <= j) + gini(bins[i] > j) for i in range(3) for j in range(5) if min(w[bins[i] <= j].sum(), w[bins[i] > j].sum()) >= 5}
    assert (k, c) == min(cuts, key=cuts.get) and (a, b) == (w[bins[k] <= c].sum(), w[bins[k] > c].sum())
    assert forest.best_cut(forest.histogram(bins, np.zeros(80, dtype=int), w, 6, 4), 1) is None


def test_bootstrap_weights_are_poisson_draws():
    k = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 40_000)
    w = [forest.weights(k, forest.Settings(), t) for t in (0, 1)]
    assert all(abs(x.mean() - 1) < 0.03 and abs(x.var() - 1) < 0.05 for x in w) and abs(np.corrcoef(*w)[0, 1]) < 0.03
    same = forest.weights(np.zeros(40_000, dtype=np.int64), forest.Settings(), 0)  # copies of a row are drawn each for itself
    assert abs(same.mean() - 1) < 0.03 and abs(same.var() - 1) < 0.05


@pytest.mark.parametrize("how", ["concat", "subtract"])
def test_forest_learns_and_passes_change_nothing(spark, monkeypatch, how):
    rng = np.random.default_rng(2)
    e = [(i, rng.standard_normal(4).tolist()) for i in range(120)]
    at = rng.integers(0, 120, (1500, 2))
    label = lambda h, t: int(e[h][1][0] > e[t][1][0]) + 2 * int(e[h][1][1] > e[t][1][1])
    t = [(int(h), int(q), label(h, q), ["train", "train", "train", "valid", "test"][i % 5]) for i, (h, q) in enumerate(at)]
    features = spark.createDataFrame(e, "entity long, features array<double>")
    triples = spark.createDataFrame(t, "head long, tail long, label int, split string")
    make = lambda n: classifiers.forest(seed=3, trees=8, depth=8)

    def run():
        rows = classifiers.trained(triples, features, how, make, 6).collect()
        return sorted((r["split"], r["label"], tuple(np.round(r["probs"], 6))) for r in rows)

    blocks = coded.coded(triples, features)
    monkeypatch.setattr(classifiers, "coded", lambda *_: blocks)  # the same blocks, so the same draws
    got = run()
    assert [(s, sum(x[0] == s for x in got)) for s in ("test", "valid")] == [("test", 300), ("valid", 300)]
    p = np.array([x[2] for x in got])
    assert np.allclose(p.sum(axis=1), 1) and not p[:, 4:].any()
    assert np.mean(p.argmax(axis=1) == [x[1] for x in got]) > (0.75 if how == "concat" else 0.85)
    monkeypatch.setattr(forest, "LOCAL", 150)
    monkeypatch.setattr(forest, "NODES", 5)
    assert run() == got


def test_no_training_rows(spark):
    features = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "entity long, features array<double>")
    triples = spark.createDataFrame([(0, 1, 0, "test")], "head long, tail long, label int, split string")
    assert classifiers.trained(triples, features, "concat", lambda n: classifiers.forest(trees=2), 3).collect() == []
