"""Adam over named arrays, and mini-batch training by one gradient aggregate a step."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coded import Blocks, chunks, opened

Params = dict[str, np.ndarray]


class Adam:
    def __init__(self, rate: float, decay: float = 0.0, clip: float | None = None):
        self.rate, self.decay, self.clip = rate, decay, clip
        self._m: Params = {}
        self._v: Params = {}
        self._step = 0

    def update(self, p: Params, g: Params) -> Params:
        """The parameters after one step along the mean gradients g, which are clipped by their joint norm."""
        self._step += 1
        scale = 1.0
        if self.clip is not None:
            scale = min(1.0, self.clip / (np.sqrt(sum(float((x**2).sum()) for x in g.values())) + 1e-6))
        out = {}
        for k, x in p.items():
            d = g[k] * scale + self.decay * x
            m = self._m[k] = 0.9 * self._m.get(k, 0.0) + 0.1 * d
            v = self._v[k] = 0.999 * self._v.get(k, 0.0) + 0.001 * d * d
            out[k] = x - self.rate * (m / (1 - 0.9**self._step)) / (np.sqrt(v / (1 - 0.999**self._step)) + 1e-8)
        return out


def uniform(key: np.ndarray, width: int, seed: int) -> np.ndarray:
    """keys x width draws from [0, 1) that depend on key, column and seed only, wherever the row stands."""
    u = np.uint64
    x = key.astype(np.int64).view(u)[:, None] * u(0x9E3779B97F4A7C15) + np.arange(1, width + 1, dtype=u) * u(0xD1B54A32D192ED03) + u(seed * 0x8CB92BA72F3D8DD7 % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> u(shift))) * u(by)
    return (x >> u(11)).astype(float) / (1 << 53)


#: Numbers that all tasks together may send to the driver, which adds them up; more are summed in a shuffle first.
FEW = 1 << 22


def total(rows: DataFrame, kernel: Callable, size: int | None) -> np.ndarray:
    """Sum over all tasks of kernel(frames), a vector (of so many numbers, if size is known) or None; empty if all gave None."""
    few = size is not None and rows.rdd.getNumPartitions() * size <= FEW

    def whole(frames):
        got = kernel(frames)
        if got is not None:
            yield pd.DataFrame({"v": [got.tobytes()]})

    def cells(frames):
        got = kernel(frames)
        if got is not None:
            yield pd.DataFrame({"pos": np.arange(len(got), dtype=np.int32), "v": got})

    if few:
        parts = sorted(bytes(r["v"]) for r in rows.mapInPandas(whole, "v binary").collect())  # in an order of their own
        return np.sum([np.frombuffer(p) for p in parts], axis=0) if parts else np.zeros(0)
    sums = rows.mapInPandas(cells, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()  # as many rows as the vector has cells
    out = np.zeros(len(sums))
    for c in sums:
        out[c["pos"]] = c["v"]
    return out


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(v: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


class Noise:
    """Draws for the rows of a mini-batch that depend on the row and the seed only; it stands in for a generator."""

    def __init__(self, key: np.ndarray, seed: int):
        self._key, self._seed, self._calls = key, seed, 0

    def random(self, shape: tuple[int, int]) -> np.ndarray:
        self._calls += 1
        return uniform(self._key, shape[1], self._seed * 64 + self._calls)


def lbfgs(answer: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, iterations: int = 100, tol: float = 1e-6, memory: int = 10) -> tuple[np.ndarray, list[float]]:
    """The minimum of a smooth function from w on, and its value after each iteration; answer gives value and gradient.

    Steps follow the strong Wolfe conditions by bisection. It stops where the last 20 values differ by tol of the
    first at most, where the gradient is tol of the value, or after so many iterations.
    """
    value, g = answer(w)
    values, moves = [value], []
    for _ in range(iterations):
        if np.linalg.norm(g) <= max(tol * abs(value), 1e-8):
            break
        way, used = -g, []
        for s, y in reversed(moves):
            a = float(s @ way) / float(s @ y)
            used.append(a)
            way = way - a * y
        if moves:
            way = way * float(moves[-1][0] @ moves[-1][1]) / float(moves[-1][1] @ moves[-1][1])
        for (s, y), a in zip(moves, reversed(used), strict=True):
            way = way + (a - float(y @ way) / float(s @ y)) * s
        slope = float(g @ way)
        if slope >= 0:
            moves, way, slope = [], -g, -float(g @ g)
        t, low, high = (1.0 if moves else min(1.0, 1 / np.linalg.norm(g))), 0.0, np.inf
        for _ in range(30):
            after, ahead = answer(w + t * way)
            if not after <= value + 1e-4 * t * slope:
                high = t
            elif float(ahead @ way) < 0.9 * slope:
                low = t
            elif float(ahead @ way) > -0.9 * slope:
                high = t
            else:
                break
            t = (low + high) / 2 if np.isfinite(high) else 2 * t
        if not after < value:
            break
        s, y = t * way, ahead - g
        if float(s @ y) > 0:
            moves = [*moves, (s, y)][-memory:]
        w, value, g = w + t * way, after, ahead
        values.append(value)
        if max(values[-20:]) - value <= tol * abs(values[0]):
            break
    return w, values


#: Steps whose rows are picked out of the blocks together.
TOGETHER = 64


def epoch(blocks: DataFrame | Blocks, p: Params, gradient: Callable, adam: Adam, batch: int, seed: int) -> tuple[Params, float]:
    """The parameters after one pass of mini-batch steps over blocked pairs, and the mean loss.

    gradient(p, x, y, labels, noise) gives (sum of losses, sums of gradients). A hash deals the rows to as
    many steps as there are batches; a step is one aggregate of the size of the parameters, and one Adam
    goes on from step to step: the result is the same for any number of blocks. The rows of TOGETHER
    steps are picked in one pass over the blocks, in place, and kept, so that a step reads its own rows only.
    """
    frame, read = opened(blocks)
    rows = frame.agg(F.sum("n")).first()[0] or 0
    steps = -(-rows // batch)
    lost = seen = 0.0
    spark = frame.sparkSession
    for first in range(0, steps, TOGETHER):
        last = min(first + TOGETHER, steps)

        def pick(frames, first=first, last=last):
            for f in frames:
                for b in f.itertuples():
                    k = np.frombuffer(b.k, dtype=np.int64)
                    at = (uniform(k, 1, seed)[:, 0] * steps).astype(int) if steps > 1 else np.zeros(b.n, dtype=int)
                    order = np.argsort(at, kind="stable")
                    ends = np.searchsorted(at[order], np.arange(first, last + 1))
                    cols = {c: np.frombuffer(getattr(b, c), dtype=np.uint8).reshape(b.n, -1) for c in "xyrk"}
                    got = [(s, order[a:e]) for s, a, e in zip(range(first, last), ends[:-1], ends[1:], strict=True) if e > a]
                    if got:
                        yield pd.DataFrame({"step": [s for s, _ in got], "n": [len(on) for _, on in got]} | {c: [v[on].tobytes() for _, on in got] for c, v in cols.items()})

        def merged(rows):  # a task's rows of a step become one
            held: dict[int, list] = {}
            for r in rows:
                held.setdefault(r["step"], []).append(r)
            for s, rs in sorted(held.items()):
                yield s, SimpleNamespace(n=sum(r["n"] for r in rs), **{c: b"".join(bytes(r[c]) for r in rs) for c in "xyrk"})

        picked = frame.select("n", "x", "y", "r", "k").mapInPandas(pick, "step int, n int, x binary, y binary, r binary, k binary")
        kept = picked.coalesce(spark.sparkContext.defaultParallelism).rdd.mapPartitions(merged).persist()
        try:
            for step in range(first, last):

                def kernel(rows, p=p, step=step):
                    acc = None
                    for s, b in rows:
                        for on in chunks(b.n) if s == step else ():
                            key = np.frombuffer(b.k, dtype=np.int64)[on]
                            part, g = gradient(p, *read(b, on), np.frombuffer(b.r, dtype=np.int64)[on], Noise(key, seed * 1009 + step))
                            got = np.concatenate([flat(g), [part, len(key)]])
                            acc = got if acc is None else acc + got
                    return [] if acc is None else [acc.tobytes()]

                parts = sorted(kept.mapPartitions(kernel).collect())  # one vector of the parameters' size a task, in an order of their own
                if parts:
                    got = np.sum([np.frombuffer(v) for v in parts], axis=0)
                    lost, seen = lost + got[-2], seen + got[-1]
                    p = adam.update(p, unflat(got[:-2] / got[-1], p))
        finally:
            kept.unpersist()
    return p, float(lost / seen) if seen else 0.0
