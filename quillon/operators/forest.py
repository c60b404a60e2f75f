"""Random forests for many classes over coded blocks (see `coded`), without a pair's vector in any table.

A row's bootstrap weight in a tree is a Poisson draw that its key and place give. Nodes of more than
LOCAL rows are cut by histograms: a pass adds up class weights by chosen feature and bin for at most
NODES nodes. Below, the row numbers of a node's training rows meet in one task, which grows the subtree.
The trees are small beside the rows (at most 2^depth leaves with a share of each class, whatever the
number of rows), so they go out one by one, and each block to score is routed and averaged where it is;
no row to score is shuffled, and no leaf is sent for a row.

Rules: features are cut into quantile bins of a sample of the training rows; each node tries the square
root of the features, rounded up; Gini impurity; both sides of a cut weigh `least` at least.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import Scratch, cut
from .boosting import binned, route
from .coded import Blocks, opened

#: Weight of a node up to which one task grows it, nodes of a pass, training rows that bins are told from, scored rows that leave together.
LOCAL, NODES, SAMPLE, ROWS = 1 << 20, 256, 10_000, 4096
#: P(X <= i) of a Poisson variable of mean 1.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)]))


@dataclass(frozen=True)
class Settings:
    trees: int = 20
    depth: int = 15
    least: int = 2
    bins: int = 32
    seed: int = 0


def _uniform(k: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each key in its place, by splitmix64."""
    with np.errstate(over="ignore"):
        z = k.view(np.uint64) + (np.arange(len(k), dtype=np.uint64) * np.uint64(2 * seed + 3) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def weights(k: np.ndarray, s: Settings, tree: int) -> np.ndarray:
    return np.searchsorted(POISSON, _uniform(k, s.seed * 1009 + tree), side="right")


def chosen(s: Settings, tree: int, node: int, features: int) -> np.ndarray:
    return np.random.default_rng([s.seed, tree, node]).permutation(features)[: int(np.ceil(np.sqrt(features)))]


def histogram(bins: np.ndarray, y: np.ndarray, w: np.ndarray, width: int, classes: int) -> np.ndarray:
    """features x bins x classes: weights of the rows of bins (features x rows)."""
    at = (np.arange(len(bins))[:, None] * width + bins) * classes + y
    return np.bincount(at.ravel(), np.tile(w, len(bins)), len(bins) * width * classes).reshape(len(bins), width, classes)


def best_cut(hist: np.ndarray, least: int) -> tuple[int, int, float, float] | None:
    """(row of hist, last bin that goes left, weights of both sides) of the purest cut; None where none gains."""
    left = hist.cumsum(axis=1)
    whole = left[0, -1]
    left, n = left[:, :-1], whole.sum()
    right = whole - left
    a, b = left.sum(axis=2), right.sum(axis=2)
    score = np.where((a >= least) & (b >= least), np.einsum("fbc,fbc->fb", left, left) / np.maximum(a, 1) + np.einsum("fbc,fbc->fb", right, right) / np.maximum(b, 1), -1.0)
    k, c = np.unravel_index(np.argmax(score), score.shape)
    return (int(k), int(c), float(a[k, c]), float(b[k, c])) if score[k, c] > (whole @ whole) / n * (1 + 1e-12) else None


def edges_of(train: Blocks, joined: Callable, rows: int, bins: int) -> np.ndarray:
    """features x (bins - 1): quantiles of about SAMPLE training rows, as in MLlib."""
    frame, read = opened(train)
    share = SAMPLE / max(rows, 1)

    def some(frames):
        for f in frames:
            for b in f.itertuples():
                on = np.flatnonzero(_uniform(np.frombuffer(b.k, dtype=np.int64), 7) < share)
                yield pd.DataFrame({"v": list(joined(*read(b, on)))})

    got = np.array([r["v"] for r in frame.mapInPandas(some, "v array<double>").collect()])  # SAMPLE rows
    return np.quantile(got, np.arange(1, bins) / bins, axis=0).T


def grown(bins: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, root: int, s: Settings):
    """(node, feature, cut, None, None) of each inner node below the node root, (node, -1, 0, classes, shares) of each leaf."""
    stack = [(root, np.arange(len(y)))]
    while stack:
        node, on = stack.pop()
        here, own = np.unique(y[on], return_inverse=True)
        found = None
        if len(here) > 1 and (node + 1).bit_length() <= s.depth:
            f = chosen(s, tree, node, len(bins))
            found = best_cut(histogram(bins[f[:, None], on], own, w[on], s.bins, len(here)), s.least)
        if found is None:
            n = np.bincount(own, w[on], len(here))
            yield node, -1, 0, here, n / max(n.sum(), 1)
            continue
        yield node, int(f[found[0]]), found[1], None, None
        right = bins[f[found[0]], on] > found[1]
        stack += [(2 * node + 1, on[~right]), (2 * node + 2, on[right])]


@dataclass
class Tree:
    """Nodes in heap order: feature (-1 where a row stays) and cut, the row of `shares` of each leaf (-1 for none)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    shares: np.ndarray  # leaves x classes

    @classmethod
    def of(cls, top: tuple[np.ndarray, np.ndarray], parts: list, depth: int, classes: int) -> Tree:
        """The upper nodes and the subtrees below them."""
        size = (1 << (depth + 1)) - 1
        feature, cut_, leaf = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        feature[: len(top[0])], cut_[: len(top[1])] = top
        read = lambda c, kind: np.concatenate([np.zeros(0, dtype=kind), *[np.frombuffer(r[c], dtype=kind) for r in parts]])
        inner, ends = read("inner", np.int32).reshape(-1, 3), read("ends", np.int32).reshape(-1, 2)
        feature[inner[:, 0]], cut_[inner[:, 0]] = inner[:, 1], inner[:, 2]
        leaf[ends[:, 0]] = np.arange(len(ends))
        shares = np.zeros((len(ends), classes), dtype=np.float32)
        shares[np.repeat(np.arange(len(ends)), ends[:, 1]), read("cls", np.int32)] = read("share", np.float32)
        return cls(feature, cut_, leaf, shares)


def fit(data: Blocks, joined: Callable, classes: int, settings: Settings | None = None) -> DataFrame | None:
    """label, split, probs of validation and test rows; None without training rows. joined(x, y) gives a pair's vector."""
    s = settings or Settings()
    frame = cut(data.frame.withColumn("b", F.monotonically_increasing_id()))
    data = Blocks(frame, data.vectors, data.d, data.how)
    train = data.of("train")
    rows = train.frame.agg(F.sum("n")).first()[0] or 0
    if not rows:
        return None
    edges = edges_of(train, joined, rows, s.bins)
    wide = len(edges)
    _, read = opened(data)
    tops = [(np.full(1, -1), np.zeros(1, dtype=np.int64)) for _ in range(s.trees)]  # feature and cut of the upper nodes, in heap order
    open_ = [(t, 0) for t in range(s.trees)] if rows > LOCAL else []
    tasks = frame.sparkSession.sparkContext.defaultParallelism

    def placed(b, levels, trees):
        """bins of the block's rows, and for these trees the upper node that each reaches."""
        v = binned(joined(*read(b)), edges)
        return v, {t: route(v, *tops[t], levels) for t in trees}

    for level in range(s.depth):
        if not open_:
            break
        cuts = []
        for a in range(0, len(open_), NODES):
            few = open_[a : a + NODES]

            def sums(frames, few=few, level=level):
                held = {}
                for f in frames:
                    for b in f.itertuples():
                        v, nodes = placed(b, level, sorted({t for t, _ in few}))
                        y, k = np.frombuffer(b.r, dtype=np.int64), np.frombuffer(b.k, dtype=np.int64)
                        for t in nodes:
                            w = weights(k, s, t)
                            order = np.argsort(nodes[t], kind="stable")
                            order = order[w[order] > 0]
                            for n in (n for x, n in few if x == t):
                                i, j = np.searchsorted(nodes[t][order], [n, n + 1])
                                on = order[i:j]
                                h = histogram(v[chosen(s, t, n, wide)[:, None], on], y[on], w[on], s.bins, classes)
                                held[t, n] = held.get((t, n), 0) + h.astype(np.int32)
                for (t, n), h in held.items():
                    yield pd.DataFrame({"t": [t], "node": [n], "hist": [h.tobytes()]})

            def pick(p):
                t, n = int(p["t"].iloc[0]), int(p["node"].iloc[0])
                h = sum(np.frombuffer(x, dtype=np.int32).astype(float) for x in p["hist"])
                got = best_cut(h.reshape(-1, s.bins, classes), s.least)
                f, c, a, b = got if got else (-1, 0, 0.0, 0.0)
                return pd.DataFrame({"t": [t], "node": [n], "f": [int(chosen(s, t, n, wide)[f]) if got else -1], "c": [c], "left": [a], "right": [b]})

            part = train.frame.select("n", "x", "y", "r", "k").coalesce(tasks).mapInPandas(sums, "t int, node int, hist binary")
            cuts += part.groupBy("t", "node").applyInPandas(pick, "t int, node int, f int, c int, left double, right double").collect()  # NODES rows
        size = (2 << (level + 1)) - 1
        tops = [tuple(np.concatenate([x, np.full(size - len(x), fill)]) for x, fill in zip(top, (-1, 0), strict=True)) for top in tops]
        open_ = []
        for r in cuts:
            if r["f"] >= 0:
                tops[r["t"]][0][r["node"]], tops[r["t"]][1][r["node"]] = r["f"], r["c"]
                open_ += [(r["t"], 2 * r["node"] + 1 + i) for i, x in enumerate((r["left"], r["right"])) if x > LOCAL and level + 1 < s.depth]
    levels = (len(tops[0][0]) + 1).bit_length() - 1
    leaves = sum(int((f >= 0).sum()) + 1 for f, _ in tops)

    def dealt(frames):
        for f in frames:
            for b in f.itertuples():
                _, nodes = placed(b, levels, range(s.trees))
                k, y = np.frombuffer(b.k, dtype=np.int64), np.frombuffer(b.r, dtype=np.int64).astype(np.int32)
                ends = [np.frombuffer(v, dtype=np.uint8).reshape(b.n, -1) for v in (b.x, b.y)]
                for t in range(s.trees):
                    w = weights(k, s, t)
                    for n in np.unique(nodes[t]):
                        on = np.flatnonzero((nodes[t] == n) & (w > 0))
                        if len(on):
                            yield pd.DataFrame({"t": [t], "node": [int(n)], "n": [len(on)], "x": [ends[0][on].tobytes()], "y": [ends[1][on].tobytes()], "r": [y[on].tobytes()], "w": [w[on].astype(np.uint8).tobytes()]})

    def subtree(p: pd.DataFrame) -> pd.DataFrame:
        t, n = int(p["t"].iloc[0]), int(p["node"].iloc[0])
        bins, at = np.empty((wide, int(p["n"].sum())), dtype=np.uint8), 0
        for r in p.itertuples():
            bins[:, at : at + r.n] = binned(joined(*read(SimpleNamespace(n=r.n, x=r.x, y=r.y))), edges)
            at += r.n
        y, w = (np.concatenate([np.frombuffer(x, dtype=kind) for x in p[c]]) for c, kind in (("r", np.int32), ("w", np.uint8)))
        found = list(grown(bins, y, w.astype(float), t, n, s))
        inner = np.array([x[:3] for x in found if x[3] is None], dtype=np.int32)
        leaves = [x for x in found if x[3] is not None]
        ends = np.array([(x[0], len(x[3])) for x in leaves], dtype=np.int32)
        cls, share = (np.concatenate([x[i] for x in leaves]).astype(kind) for i, kind in ((3, np.int32), (4, np.float32)))
        return pd.DataFrame({"t": [t], "inner": [inner.tobytes()], "ends": [ends.tobytes()], "cls": [cls.tobytes()], "share": [share.tobytes()]})

    with Scratch() as scratch:
        spread = train.frame.mapInPandas(dealt, "t int, node int, n int, x binary, y binary, r binary, w binary")
        parts = scratch.keep("parts", spread.repartition(leaves, "t", "node").groupBy("t", "node").applyInPandas(subtree, "t int, inner binary, ends binary, cls binary, share binary"))
        context = frame.sparkSession.sparkContext
        trees = [context.broadcast(Tree.of(top, parts.where(F.col("t") == t).collect(), s.depth, classes)) for t, top in enumerate(tops)]  # 2^depth leaves each at most

    def scored(frames):
        for f in frames:
            for b in f.itertuples():
                v = binned(joined(*read(b)), edges)
                q = np.zeros((b.n, classes))
                for shared in trees:
                    tree = shared.value
                    at = tree.leaf[route(v, tree.feature, tree.cut, s.depth)]
                    on = np.flatnonzero(at >= 0)
                    q[on] += tree.shares[at[on]]
                label = np.frombuffer(b.r, dtype=np.int64).astype(np.int32)
                for k in range(0, b.n, ROWS):
                    yield pd.DataFrame({"label": label[k : k + ROWS], "split": b.split, "probs": list(q[k : k + ROWS] / s.trees)})

    return frame.where("split <> 'train'").mapInPandas(scored, "label int, split string, probs array<double>")
