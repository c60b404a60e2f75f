"""Gradients by finite differences, training by falling losses, streams against the batch result."""

import numpy as np
import pytest

from quillon.operators import cpd, features, kge, optim, projector


def _data(n=200, d=6, classes=4):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(n, d)), rng.normal(size=(n, d))
    return x, y, (x[:, 0] * y[:, 0] > 0).astype(int) + 2 * (x[:, 1] * y[:, 1] > 0)


def _blocks(spark, x, y, r):
    rows = [(a.tolist(), b.tolist(), int(c)) for a, b, c in zip(x, y, r, strict=True)]
    return cpd.blocked(spark.createDataFrame(rows, "fh array<double>, ft array<double>, label int").repartition(2)).persist()


def _check(value, g, p, rtol=1e-4):
    rng = np.random.default_rng(2)
    for k, m in p.items():
        for _ in range(6):
            at = tuple(int(rng.integers(s)) for s in m.shape)
            up, down = {**p, k: m.copy()}, {**p, k: m.copy()}
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert np.isclose((value(up) - value(down)) / 2e-5, g[k][at], rtol=rtol, atol=1e-4), (k, at)


@pytest.mark.parametrize("name", ["distmult", "complex", "rotate"])
def test_embedding_gradients(name):
    x, y, r = _data(40)
    p = kge.initial(name, 6, 4, 8, 3)
    _, g = kge.gradient(name, p, x, y, r, None)
    _check(lambda q: kge.gradient(name, q, x, y, r, None)[0], g, p)


def test_projector_gradients():
    x, y, r = _data(40)
    p = projector.initial(6, 7, 5, 4, 3)
    p["rel"] *= 0.2  # small scores: the 1e-10 inside the logarithm must not matter
    _, g = projector.gradient(p, x, y, r, None)
    _check(lambda q: projector.gradient(q, x, y, r, None)[0], g, p)


def test_factor_gradients_and_hessian_products():
    x, y, r = _data(60)
    f = cpd.initial(6, 3, 4, 5)
    p = {b: getattr(f, b) for b in "whc"}
    value = lambda q: float(np.ravel(cpd.block_loss(x, y, r, cpd.Factors(**q)))[0])
    _check(value, {b: cpd.block_gradient(x, y, r, f, b) for b in "whc"}, p)
    rng = np.random.default_rng(3)
    for b in "whc":
        v = rng.normal(size=p[b].shape)
        up, down = (cpd.block_gradient(x, y, r, f.replaced(b, p[b] + s * 1e-5 * v), b) for s in (1, -1))
        got = cpd.block_hessian(x, y, r, f, b, v)
        # the product leaves out terms of the curvature only where the survey says so: same direction, same size
        want = (up - down) / 2e-5
        assert np.allclose(got, want, rtol=1e-2, atol=1e-2 * np.abs(want).max())


@pytest.mark.parametrize("name", ["distmult", "complex", "rotate"])
def test_embedding_training_lowers_the_loss(spark, name):
    x, y, r = _data(400)
    b = _blocks(spark, x, y, r)
    p, curve = kge.fit(b, name, 6, 4, dim=16, epochs=25, batch=32, dropout=0.0, valid=b)
    assert curve[-1] < 0.9 * curve[0]
    assert kge.block_metrics(b, name, p)["mrr"] > 0.55
    b.unpersist()


def test_projector_training_and_projection(spark):
    x, y, r = _data(400)
    b = _blocks(spark, x, y, r)
    p, curve = projector.fit(b, 6, 4, out=8, hidden=12, epochs=20, batch=32, dropout=0.1, rate=3e-3)
    assert curve[-1] < 0.8 * curve[0]
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:20])], "entity long, features array<double>")
    got = {q["entity"]: q["features"] for q in projector.projected(f, p).collect()}
    assert np.allclose([got[i] for i in range(20)], projector.forward(x[:20], p)[0])
    b.unpersist()


def test_one_batch_is_plain_adam(spark):
    x, y, r = _data(50)
    b = _blocks(spark, x, y, r)
    p = kge.initial("distmult", 6, 4, 8, 3)
    g = lambda q, x, y, r, rng: kge.gradient("distmult", q, x, y, r, rng)
    got, loss = optim.epoch(b, p, g, optim.Adam(1e-2), 50, 0)
    first, grads = kge.gradient("distmult", p, x, y, r, None)
    want = optim.Adam(1e-2).update(p, {k: v / 50 for k, v in grads.items()})
    assert np.isclose(loss, first / 50) and all(np.allclose(got[k], want[k]) for k in p)
    assert optim.epoch(b.limit(0), p, g, optim.Adam(1e-2), 50, 0) == (p, 0.0)
    b.unpersist()


@pytest.mark.parametrize("name", ["distmult", "projector"])
def test_one_and_eight_blocks_train_alike(spark, name):
    x, y, r = _data(300)
    rows = [(a.tolist(), b.tolist(), int(c)) for a, b, c in zip(x, y, r, strict=True)]
    ends = []
    for n in (1, 8):
        b = cpd.blocked(spark.createDataFrame(rows, "fh array<double>, ft array<double>, label int").repartition(n)).persist()
        assert b.count() == n
        if name == "projector":
            ends.append(projector.fit(b, 6, 4, out=5, hidden=7, epochs=3, batch=100, dropout=0.2))
        else:
            ends.append(kge.fit(b, name, 6, 4, dim=8, epochs=3, batch=100, dropout=0.3))
        b.unpersist()
    (p, a), (q, b) = ends
    assert np.allclose(a, b, atol=1e-9) and all(np.allclose(p[k], q[k], atol=1e-9) for k in p)


def test_training_stops_after_stalled_evaluations(spark, monkeypatch):
    x, y, r = _data(60)
    b = _blocks(spark, x, y, r)
    seen, rates = iter([0.5, 0.7, *[0.6] * 20]), []
    monkeypatch.setattr(kge, "block_metrics", lambda *_: {"mrr": next(seen)})
    own = kge.epoch
    monkeypatch.setattr(kge, "epoch", lambda blocks, p, g, adam, *rest: (rates.append(adam.rate), own(blocks, p, g, adam, *rest))[1])
    _, curve = kge.fit(b, "distmult", 6, 4, dim=8, epochs=50, batch=100, valid=b, every=1, patience=7)
    assert len(curve) == 2 + 7 and rates[:7] == [kge.RATE] * 7 and rates[7:] == [kge.RATE / 2] * 2
    b.unpersist()


def test_random_fill_is_a_fixed_normal_draw(spark):
    e = spark.range(300).withColumnRenamed("id", "entity")
    none = spark.createDataFrame([], "entity long, features array<double>")
    draw = lambda seed: {r["entity"]: r["features"] for r in features.with_features(e.repartition(3), none, 32, "random", seed).collect()}
    a, b = draw(1), draw(1)
    v = np.array(list(a.values()))
    assert a == b and a != draw(2) and abs(v.mean()) < 0.005 and abs(v.std() - 0.1) < 0.005


def test_streamed_scores_equal_batch_scores(spark, tmp_path):
    from quillon.operators import ranking
    from quillon.streaming import scoring

    rng = np.random.default_rng(4)
    f = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(12)], "entity long, features array<double>")
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2))], "head long, tail long")
    classes = ranking.class_table(spark.createDataFrame([(r, rng.normal(size=4).tolist()) for r in range(3)], "relation int, vector array<double>"))
    pairs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
    q = scoring.translation_scores(stream, f, classes).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.table("scored")) == rows(scoring.translation_scores(pairs, f, classes)) and spark.table("scored").count() == 30


def test_windowed_means_drop_late_rows(spark, tmp_path):
    from datetime import datetime

    from quillon.streaming import scoring

    schema = "ts timestamp, event_type string, value double"
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = None
    for k, (hour, value) in enumerate([(1, 1.0), (6, 3.0), (1, 100.0), (12, 5.0)]):  # the third is far behind the watermark
        spark.createDataFrame([(datetime(2024, 1, 1, hour, 5), "view", value)], schema).coalesce(1).write.mode("append").parquet(str(src))
        if q is None:
            q = scoring.windowed_means(stream).writeStream.format("memory").queryName("means").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    q.stop()
    got = {r["start"].hour: (r["n"], r["mean"]) for r in spark.table("means").collect()}
    assert got[1] == (1, 1.0) and got[6] == (1, 3.0)


def test_seven_baselines_in_one_table(spark):
    from quillon.operators import boosting, classifiers

    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 4))
    f = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "entity long, features array<double>")
    rows = [(int(a), int(b), int(v[a, 0] > v[b, 0]) + 2 * int(v[a, 1] > 0), "train" if k % 5 else "test") for k, (a, b) in enumerate(rng.integers(0, 40, (300, 2))) if a != b]
    t = spark.createDataFrame(rows, "head long, tail long, relation int, split string")
    small = {}
    for how in ("concat", "subtract"):
        small[f"lr_{how}"] = lambda t, f, n, how=how: classifiers.trained(t, f, how, lambda m: classifiers.logistic(m, 1.0, 30), n)
        small[f"rf_{how}"] = lambda t, f, n, how=how: classifiers.trained(t, f, how, lambda m: classifiers.forest(trees=5, depth=5), n)
        small[f"gbt_{how}"] = lambda t, f, n, how=how: classifiers.boosted(t, f, how, boosting.Settings(rounds=3, depth=3), n)
    assert set(small) == set(classifiers.METHODS)
    got = {r["method"]: r for r in classifiers.baselines(t, f, 5, small).collect()}
    assert set(got) == {"feature_translation", *small}
    n = sum(r[3] == "test" for r in rows)
    assert all(r["n"] == n and 0 < r["mrr"] <= 1 and r["hits_1"] <= r["hits_3"] <= r["hits_10"] for r in got.values())
    assert got["rf_concat"]["mrr"] > 0.6
