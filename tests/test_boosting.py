"""Boosted trees against a plain version in one process, blocks against one block, early stopping, and predictions."""

import numpy as np
import pytest

from quillon.operators import boosting as B

EDGES = np.array([[-0.6, 0.0, 0.5], [-0.4, 0.1, 0.6], [-1.0, 0.0, 1.0]])


def sample(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, 3)), 2)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] + 0.4 * rng.standard_normal(n) > 0.3)
    split = np.array(["train", "train", "train", "valid", "test"])[np.arange(n) % 5]
    return x, y, split


def frame(spark, x, y, split):
    return spark.createDataFrame([(v.tolist(), int(c), s) for v, c, s in zip(x, y, split, strict=True)], "x array<double>, label int, split string")


def plain(x, y, split, classes, s):
    """Direct boosting: every node tries every cut on its own rows. Returns scores of all rows, loss by round."""
    bins = np.stack([[sum(v > e for e in EDGES[j]) for v in x[:, j]] for j in range(x.shape[1])], axis=1)
    train = split == "train"
    z = np.tile([np.log((y[train] == c).mean()) for c in range(classes)], (len(y), 1))
    losses, states = [], []
    for _ in range(s.rounds):
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        step = np.zeros_like(z)
        for c in range(classes):
            g, h = p[:, c] - (y == c), classes / (classes - 1) * p[:, c] * (1 - p[:, c])

            def leaf(rows, c=c, g=g, h=h):
                a, b = g[rows & train].sum(), h[rows & train].sum()
                step[rows, c] = -np.sign(a) * max(abs(a) - s.l1, 0) / (b + s.l2) * s.rate

            def grow(rows, depth, g=g, h=h, leaf=leaf):
                own = rows & train
                score = lambda m: max(abs(g[m].sum()) - s.l1, 0) ** 2 / (h[m].sum() + s.l2)
                least = max(s.least_hessian, (s.least_rows - 0.5) * h[own].sum() / max(own.sum(), 1))
                best = (1e-9, None)
                for j in range(bins.shape[1]):
                    for b in range(s.bins - 1):
                        left, right = own & (bins[:, j] <= b), own & (bins[:, j] > b)
                        if h[left].sum() >= least and h[right].sum() >= least and (gain := score(left) + score(right) - score(own)) > best[0] + 1e-12:
                            best = (gain, (j, b))
                if depth == s.depth or best[1] is None:
                    return leaf(rows)
                j, b = best[1]
                grow(rows & (bins[:, j] <= b), depth + 1)
                grow(rows & (bins[:, j] > b), depth + 1)

            grow(np.ones(len(y), dtype=bool), 0)
        z = z + step
        q = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        losses.append(-np.log(q[np.arange(len(y)), y])[split == "valid"].mean())
        states.append(q)
    return losses, states


@pytest.mark.parametrize("size", [10_000, 90])
def test_against_one_process(spark, size):
    x, y, split = sample(400, 1)
    s = B.Settings(rounds=4, depth=2, bins=4, features=1.0, rows=1.0, least_rows=5)
    model, probs = B.fit(frame(spark, x, y, split), 3, s, EDGES, size)
    losses, states = plain(x, y, split, 3, s)
    assert np.allclose(model.losses, losses, atol=1e-5) and losses[-1] < losses[0]
    got = sorted((r["split"], r["label"], tuple(np.round(r["probs"], 4))) for r in probs.collect())
    want = sorted((str(split[i]), int(y[i]), tuple(np.round(states[model.best - 1][i], 4))) for i in range(len(y)) if split[i] != "train")
    assert len(got) == len(want) and all(a[:2] == b[:2] and np.allclose(a[2], b[2], atol=2e-4) for a, b in zip(got, want, strict=True))
    again = sorted((r["split"], r["label"], tuple(np.round(r["probs"], 4))) for r in B.predict(frame(spark, x, y, split), model).where("split <> 'train'").collect())
    assert all(a[:2] == b[:2] and np.allclose(a[2], b[2], atol=2e-4) for a, b in zip(again, want, strict=True))


def test_stops_early_and_keeps_the_best_round(spark):
    x, _, split = sample(200, 2)
    y = np.random.default_rng(3).integers(0, 3, 200)  # nothing to learn: the loss soon rises
    s = B.Settings(rounds=30, depth=3, bins=4, rate=0.8, patience=2, least_rows=1)
    model, _ = B.fit(frame(spark, x, y, split), 4, s, EDGES)
    assert len(model.rounds) == model.best + 2 < 30 and model.losses[model.best - 1] == min(model.losses)


def test_sampled_features_rows_and_edges(spark):
    x, y, split = sample(600, 4)
    data = frame(spark, x, y, split)
    e = B.quantile_edges(data, 8)
    assert e.shape == (3, 7) and (np.diff(e, axis=1) >= 0).all() and abs(np.mean(x[:, 0] <= e[0, 3]) - 0.5) < 0.05
    assert [len(B.chosen(B.Settings(), 1, c, 10)) for c in range(3)] == [8, 8, 8]
    model, probs = B.fit(data, 3, B.Settings(rounds=12, depth=3, bins=8, least_rows=5))
    right = [int(np.argmax(r["probs"])) == r["label"] for r in probs.where("split = 'test'").collect()]
    assert np.mean(right) > 0.7 and model.losses[-1] < model.losses[0]


def test_no_training_rows(spark):
    x, y, split = sample(20, 5)
    assert B.fit(frame(spark, x, y, split).where("split <> 'train'"), 3)[1] is None


def test_lighter_children_give_the_sums_of_both():
    rng = np.random.default_rng(6)
    bins, node, g, h = rng.integers(0, 4, (3, 200)).astype(np.uint8), rng.integers(3, 7, 200), rng.standard_normal(200), rng.random(200)
    own = np.arange(3)
    n, hist = B.histogram(bins, g, h, node, np.array([3, 6]), own, 4)
    up, top = B.histogram(bins, g, h, (node - 1) // 2, np.array([1, 2]), own, 4)
    m, other = B.histogram(bins, g, h, node, np.array([4, 5]), own, 4)
    assert (up - n == m).all() and np.allclose(top - hist, other)
    assert not B.histogram(bins, g, h, node, np.array([40]), own, 4)[0].any()
