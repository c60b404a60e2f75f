import numpy as np
import pytest

from quillon.operators import classifiers, coded, cpd, features, kge, optim


def _graph(spark, n=30, m=400, d=5):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, d))
    rows = [(int(a), int(b), int(v[a, 0] > 0) + 2 * int(v[b, 1] > 0), ("train", "train", "train", "valid", "test")[k % 5]) for k, (a, b) in enumerate(rng.integers(0, n, (m, 2)))]
    f = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "entity long, features array<double>")
    return v, rows, f, spark.createDataFrame(rows, "head long, tail long, label int, split string")


def _plain(f, t):
    return cpd.blocked(features.with_ends(t, f).where("split = 'train'"))


@pytest.mark.parametrize("limit", [1 << 20, 100])
def test_coded_blocks_hold_the_same_pairs_in_few_bytes(spark, monkeypatch, limit):
    v, rows, f, t = _graph(spark)
    monkeypatch.setattr(features, "BROADCAST", limit)
    b = coded.coded(t.union(t.limit(1).selectExpr("-1L", "tail", "label", "split")), f)  # an end without a vector
    assert (b.vectors is None) == (limit == 100) and b.d == 5
    each = b.frame.selectExpr("sum(n) n", "sum(length(x)) x").first()
    assert each["n"] == len(rows) and each["x"] == len(rows) * (4 if limit > 100 else 40)
    kernel = lambda x, y, r: np.array([len(r), (x * (r + 1)[:, None]).sum(), (x * y).sum()])
    assert np.allclose(cpd.block_sum(b.of("train"), kernel), cpd.block_sum(_plain(f, t), kernel))
    key = lambda frame: sorted(k for r in frame.collect() for k in np.frombuffer(r["k"], dtype=np.int64))
    assert key(b.of("train").frame) == key(_plain(f, t))


def test_mini_batches_of_coded_blocks_are_those_of_plain_ones(spark, monkeypatch):
    _, _, f, t = _graph(spark)
    monkeypatch.setattr(optim, "TOGETHER", 2)
    fit = lambda b: kge.fit(b, "complex", 5, 4, dim=6, epochs=2, batch=50, seed=3)
    (p, a), (q, b) = fit(coded.coded(t, f).of("train").persist()), fit(_plain(f, t).persist())
    assert np.allclose(a, b, atol=1e-9) and all(np.allclose(p[k], q[k], atol=1e-9) for k in p)


def test_a_step_does_not_pick_its_rows_out_of_all_blocks(spark, monkeypatch):
    _, _, f, t = _graph(spark)
    drawn, plain = spark.sparkContext.accumulator(0), optim.uniform

    def counted(key, width, seed):
        if width == 1:
            drawn.add(len(key))
        return plain(key, width, seed)

    monkeypatch.setattr(optim, "uniform", counted)
    g = lambda q, x, y, r, noise: kge.gradient("distmult", q, x, y, r, noise)
    optim.epoch(_plain(f, t).persist(), kge.initial("distmult", 5, 4, 6, 1), g, optim.Adam(1e-2), 24, 0)
    assert 0 < drawn.value <= 240  # once a pair for ten steps


@pytest.mark.parametrize("how", ["concat", "subtract"])
def test_logistic_over_blocks_is_the_regression_of_mllib(spark, how):
    _, rows, f, t = _graph(spark)
    n = sum(r[3] == "train" for r in rows)
    make = lambda m: classifiers.logistic(m, 1.0, 200).setTol(1e-9)
    got = classifiers.trained(t, f, how, make, 6).where("split = 'test'")
    want = classifiers.fit_scores(classifiers.prepared(t, f, how), make(n), 6).where("split = 'test'")
    table = lambda df: np.array(sorted([r["label"], *r["probs"]] for r in df.collect()))
    a, b = table(got), table(want)
    assert a.shape == b.shape and a.shape[1] == 7 and np.allclose(a, b, atol=1e-4)


def test_no_wide_row_of_the_regression_is_kept(spark, monkeypatch):
    _, _, f, t = _graph(spark)
    monkeypatch.setattr(classifiers, "prepared", None)  # the pairs' dense vectors
    out = classifiers.trained(t, f, "concat", lambda n: classifiers.logistic(n, 1.0, 5), 6)
    assert out.where("split = 'test'").count() == 80


def test_lbfgs_finds_a_minimum():
    w, values = optim.lbfgs(lambda w: (float(100 * (w[1] - w[0] ** 2) ** 2 + (1 - w[0]) ** 2), np.array([-400 * w[0] * (w[1] - w[0] ** 2) - 2 * (1 - w[0]), 200 * (w[1] - w[0] ** 2)])), np.array([-1.2, 1.0]), 200, 1e-12)
    assert np.allclose(w, 1, atol=1e-4) and all(b < a for a, b in zip(values, values[1:]))
