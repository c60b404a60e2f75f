import numpy as np

from quillon.operators import cpd


def _pairs(spark, n=300, d=5, classes=4):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(n, d)), rng.normal(size=(n, d))
    r = (x[:, 0] * y[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0)
    split = ["train" if i % 5 else "valid" if i % 2 else "test" for i in range(n)]
    rows = [(a.tolist(), b.tolist(), int(c), s) for a, b, c, s in zip(x, y, r, split, strict=True)]
    return x, y, r, np.array(split), spark.createDataFrame(rows, "fh array<double>, ft array<double>, label int, split string").repartition(4)


def test_training_in_passes_equals_training_in_one_process(spark):
    x, y, r, split, pairs = _pairs(spark)
    configs = spark.createDataFrame([(0, 2, 1.0, 1, 7), (1, 3, 0.1, 0, 8), (2, 0, 1.0, 0, 9)], "config int, k int, penalty double, bias int, seed int")
    got = cpd.fit_configs(pairs, configs.where("config < 1"), 4, 1).collect()
    ones = np.ones((len(r), 1))
    x1, y1, at = np.hstack([x, ones]), np.hstack([y, ones]), {s: split == s for s in ("train", "valid", "test")}
    f, curve = cpd.fit_arrays(x1[at["train"]], y1[at["train"]], r[at["train"]], 4, 2, 1.0, 1, 7, tuple(v[at["valid"]] for v in (x1, y1, r)))
    z = cpd.logits(x1[at["test"]], y1[at["test"]], f)
    mrr = float((1 / (z >= z[np.arange(len(z)), r[at["test"]]][:, None]).sum(axis=1)).mean())
    assert [g["error"] for g in got] == [None]
    assert np.allclose([got[0]["loss_first"], got[0]["loss_last"], got[0]["test_mrr"]], [curve[0], curve[-1], mrr], rtol=1e-6)
    assert cpd.fit_configs(pairs.limit(0), configs, 4, 1).count() == 0


def test_no_task_of_the_training_takes_the_whole_table(spark):
    *_, pairs = _pairs(spark)
    blocks = cpd.blocked(pairs.where("split = 'train'"))
    assert [r["n"] for r in blocks.select("n").collect()] and max(r["n"] for r in blocks.collect()) < 240
    assert np.isclose(cpd.block_sum(blocks, lambda x, y, r: np.array([len(r), x.sum()]), bias=2)[0], 240)


def test_conjugate_gradients_solve_and_stop_at_the_edge():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(6, 6))
    h, g = a @ a.T + np.eye(6), rng.normal(size=6)
    inside = cpd.answered(cpd.conjugate(g, 100.0, 20), lambda d: h @ d)
    assert np.allclose(inside, -np.linalg.solve(h, g))
    edge = cpd.answered(cpd.conjugate(g, 1e-3, 20), lambda d: h @ d)
    # the first step along -g would leave the region: it is shortened by radius over its length
    assert np.isclose(np.linalg.norm(edge), 1e-3) and np.allclose(edge / 1e-3, -g / np.linalg.norm(g))
    flat = cpd.answered(cpd.conjugate(g, 1.0, 3), lambda d: 0 * d)
    assert np.allclose(flat, 0)


def test_radius_rules():
    assert cpd.next_radius(0.1, 0.5, 2.0) == (0.25 * 0.5 + 0.5 * 2.0) / 2 and cpd.next_radius(-1, 9.0, 0.0) == 1e-6
    assert cpd.next_radius(0.5, 1.0, 2.0) == 2.125 * 2.0
    assert cpd.next_radius(0.9, 1.0, 2.0) == 8.0 and cpd.next_radius(0.75, 1.0, 4.0) == 10.0


def test_newton_finds_a_minimum():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(5, 5))
    h, c = a @ a.T + np.eye(5), rng.normal(size=5)

    def answer(want):
        kind, w, *d = want
        return {"loss": lambda: 0.5 * w @ h @ w - c @ w, "gradient": lambda: h @ w - c, "hessian": lambda: h @ d[0]}[kind]()

    assert np.allclose(cpd.answered(cpd.newton(np.zeros(5), steps=50, inner=20), answer), np.linalg.solve(h, c), atol=1e-3)


def test_answers_of_a_pass_equal_single_ones(spark):
    x, y, r, _, pairs = _pairs(spark)
    blocks = cpd.blocked(pairs).persist()
    rng = np.random.default_rng(5)
    wanted = []
    for k, bias in ((2, 0), (3, 2), (1, 1)):
        f = cpd.initial(5 + bias, k, 4, k)
        wanted += [(("loss", f, "", None), bias), (("mrr", f, "", None), bias)]
        wanted += [(("gradient", f, b, None), bias) for b in "whc"] + [(("hessian", f, b, rng.normal(size=getattr(f, b).shape)), bias) for b in "whc"]
    for ((kind, f, block, v), bias), got in zip(wanted, cpd.pass_over(blocks, wanted), strict=True):
        xs, ys = (np.hstack([m, np.ones((len(m), bias))]) for m in (x, y))
        if kind == "mrr":
            z = cpd.logits(xs, ys, f)
            want = (1 / (z >= z[np.arange(len(z)), r][:, None]).sum(axis=1)).mean()
        else:
            want = cpd.block_loss(xs, ys, r, f) if kind == "loss" else cpd.block_gradient(xs, ys, r, f, block) if kind == "gradient" else cpd.block_hessian(xs, ys, r, f, block, v)
        assert np.allclose(got, want), (kind, block, bias)
    blocks.unpersist()


def test_a_grid_takes_the_passes_of_its_slowest_member(spark, tmp_path, monkeypatch):
    *_, pairs = _pairs(spark)
    rows = [(i, k, p, b, s) for i, (k, p, b, s) in enumerate([(2, 1.0, 1, 7), (3, 0.1, 0, 8), (0, 1.0, 0, 9), (2, float("nan"), 1, 3), (1, 5.0, 2, 4)])]
    grid = spark.createDataFrame(rows, "config int, k int, penalty double, bias int, seed int")
    passes = []
    own = cpd.pass_over
    monkeypatch.setattr(cpd, "pass_over", lambda blocks, wanted: (passes.append(len(wanted)), own(blocks, wanted))[1])
    got = {r["config"]: r for r in cpd.fit_configs(pairs, grid, 4, 1, str(tmp_path / "tuning")).collect()}
    together, alone = len(passes), []
    for i in (1, 4):
        passes.clear()
        (one,) = cpd.fit_configs(pairs, grid.where(f"config = {i}"), 4, 1).collect()
        assert np.allclose([one[c] for c in ("loss_first", "loss_last", "valid_mrr", "test_mrr")], [got[i][c] for c in ("loss_first", "loss_last", "valid_mrr", "test_mrr")], rtol=1e-8)
        alone.append(len(passes))
    assert together < sum(alone) and together <= max(alone) + 2 * len(rows) + 2
    assert "k is at least 1" in got[2]["error"] and got[3]["error"] and got[3]["valid_mrr"] is None
    assert sorted(r["config"] for r in spark.read.parquet(str(tmp_path / "tuning")).collect()) == [0, 1, 2, 3, 4]


def test_nan_guard_and_predicted_names(spark):
    f = cpd.closed_form(5, 2, 4)
    assert cpd.guarded({"mrr": 0.5}, f) == {"mrr": 0.5} and cpd.guarded({"mrr": 0.5}, f.replaced("c", f.c * np.nan)) == {"mrr": None}
    x, y, r, _, pairs = _pairs(spark, 20)
    names = spark.createDataFrame([(i, f"rel{i}") for i in range(4)], "idx int, relation string")
    got = sorted(r["predicted"] for r in cpd.predict(pairs.select("fh", "ft", "label"), f, names).collect())
    assert got == sorted(f"rel{i}" for i in cpd.logits(x, y, f).argmax(axis=1))
