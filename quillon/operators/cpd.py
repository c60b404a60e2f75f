"""Low-rank tensor softmax model of the relation between two entities.

The logit of class r for head x and tail y is sum_l (x W)_l (H y)_l C_lr. Kernels are numpy
over blocks of pairs; sums over blocks are Spark aggregates, so a pass sends the factors out
and gets a matrix of their size back. Training takes one distributed pass for each loss,
gradient and Hessian product (`fit_distributed`, and `fit_configs` for a grid); `fit_arrays` is
the same in one process.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coded import Blocks, by_split, chunks, opened
from .optim import total

EPS = 1e-10


@dataclass
class Factors:
    w: np.ndarray  # d x k
    h: np.ndarray  # k x d
    c: np.ndarray  # k x R

    def replaced(self, block: str, value: np.ndarray) -> Factors:
        return Factors(**{**self.__dict__, block: value})

    def square(self) -> float:
        return float((self.w**2).sum() + (self.h**2).sum() + (self.c**2).sum())


def initial(d: int, k: int, classes: int, seed: int) -> Factors:
    """N(0, 0.1) draws with one seed a factor."""
    draw = [np.random.default_rng(seed + i).standard_normal(shape) * 0.1 for i, shape in enumerate([(d, k), (k, d), (k, classes)])]
    return Factors(*draw)


def closed_form(d: int, k: int, classes: int) -> Factors:
    """Factors without a random generator, for checks against other engines."""
    i, j, r, lo = np.arange(d), np.arange(d), np.arange(classes), np.arange(k)
    return Factors(np.sin(31 * i[:, None] + lo) / 8, np.cos(17 * lo[:, None] + j) / 8, np.sin(7 * lo[:, None] + 13 * r) / 8)


def logits(x: np.ndarray, y: np.ndarray, f: Factors) -> np.ndarray:
    return ((x @ f.w) * (y @ f.h.T)) @ f.c


def probabilities(z: np.ndarray, eps: float = 0.0) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / (e.sum(axis=1, keepdims=True) + eps)


def block_loss(x, y, r, f: Factors) -> float:
    p = probabilities(logits(x, y, f), EPS)
    return float(-np.log(p[np.arange(len(r)), r] + EPS).sum())


def _residual(x, y, r, f: Factors) -> np.ndarray:
    p = probabilities(logits(x, y, f), EPS)
    p[np.arange(len(r)), r] -= 1
    return p


def block_gradient(x, y, r, f: Factors, block: str) -> np.ndarray:
    """Of the loss without its penalty."""
    d = _residual(x, y, r, f)
    if block == "c":
        return ((x @ f.w) * (y @ f.h.T)).T @ d
    back = d @ f.c.T
    return x.T @ (back * (y @ f.h.T)) if block == "w" else (back * (x @ f.w)).T @ y


def block_hessian(x, y, r, f: Factors, block: str, v: np.ndarray) -> np.ndarray:
    """Hessian times v for one factor, the others fixed, without the penalty."""
    p = probabilities(logits(x, y, f), EPS)
    left, right = x @ f.w, y @ f.h.T
    moved = {"w": lambda: ((x @ v) * right) @ f.c, "h": lambda: (left * (y @ v.T)) @ f.c, "c": lambda: (left * right) @ v}[block]()
    pm = p * moved
    q = pm - p * pm.sum(axis=1, keepdims=True)
    if block == "c":
        return (left * right).T @ q
    back = q @ f.c.T
    return x.T @ (back * right) if block == "w" else (back * left).T @ y


#: Fixed values of the trust region: ratios of actual and predicted decrease, radius factors, largest radius.
ACCEPTED, POOR, GOOD = 1e-3, 0.25, 0.75
SHRINK, HALVE, GROW = 0.25, 0.5, 4.0
LARGEST = 10.0

#: What a solver asks for: (kind, factors, block, vector); the answer is a sum over the data.
Request = tuple[str, Factors, str, np.ndarray | None]
Solver = Generator[Request, np.ndarray | float, tuple[Factors, list[float]]]


def conjugate(g: np.ndarray, radius: float, inner: int) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """The step of conjugate gradients against the gradient g; asks for Hessian products, stops at the edge of the region.

    A step that would leave the region is shortened by radius over its length along the last direction.
    """
    step, rest = np.zeros_like(g), -g
    way, square = rest, float(rest @ rest)
    for _ in range(inner):
        product = yield way
        curve = float(way @ product)
        far = square / curve if curve >= 1e-14 else 0.0
        length = np.linalg.norm(step + far * way)
        if length > radius:
            return step + radius / length * far * way
        step, rest = step + far * way, rest - far * product
        if np.linalg.norm(rest) < 1e-12:
            return step
        before, square = square, float(rest @ rest)
        way = rest + square / before * way
    return step


def next_radius(ratio: float, length: float, radius: float) -> float:
    """The region's radius after a step of this length and ratio of actual to predicted decrease."""
    if ratio <= POOR:
        return max((SHRINK * min(length, radius) + HALVE * radius) / 2, 1e-6)
    if ratio < GOOD:
        return (SHRINK + GROW) / 2 * radius
    return min(GROW * radius, LARGEST)


def newton(w: np.ndarray, radius: float = 1.0, steps: int = 5, inner: int = 10) -> Generator[tuple, np.ndarray | float, np.ndarray]:
    """Trust-region Newton on a flat vector; asks for ("gradient", w), ("loss", w) and ("hessian", w, direction).

    It stops at a gradient 1e-4 of the first or a step under 1e-6, and at once where the loss is no number.
    """
    g = yield "gradient", w
    value = yield "loss", w
    least = 1e-4 * np.linalg.norm(g)
    if not (np.isfinite(value) and np.isfinite(g).all()):
        return w
    for _ in range(steps):
        search = conjugate(g, radius, inner)
        try:
            way = next(search)
            while True:
                way = search.send((yield "hessian", w, way))
        except StopIteration as end:
            step = end.value
        predicted = -float(g @ step) - 0.5 * float(step @ (yield "hessian", w, step))
        after = yield "loss", w + step
        ratio = (value - after) / (predicted if abs(predicted) >= 1e-10 else 1e-10)
        length = np.linalg.norm(step)
        if ratio > ACCEPTED:
            w, value = w + step, after
            g = yield "gradient", w
        radius = next_radius(ratio, length, radius)
        if np.linalg.norm(g) < least or length < 1e-6:
            break
    return w


def solve(f: Factors, penalty: float, rounds: int, monitored: bool) -> Solver:
    """Rounds over w, h, c, each by newton: asks for sums over the data, adds the penalty, keeps the best monitored round."""

    def penalised(f: Factors) -> Generator:
        return (yield "loss", f, "", None) + penalty / 2 * f.square()

    curve = [(yield from penalised(f))]
    best, best_at = ((yield "mrr", f, "", None) if monitored else 0.0), f
    for _ in range(rounds):
        for block in "whc":
            shape = getattr(f, block).shape
            search = newton(getattr(f, block).ravel())
            try:
                want = next(search)
                while True:
                    at = f.replaced(block, want[1].reshape(shape))
                    if want[0] == "loss":
                        got = yield from penalised(at)
                    elif want[0] == "gradient":
                        got = (yield "gradient", at, block, None).ravel() + penalty * want[1]
                    else:
                        got = (yield "hessian", at, block, want[2].reshape(shape)).ravel() + penalty * want[2]
                    want = search.send(got)
            except StopIteration as end:
                f = f.replaced(block, end.value.reshape(shape))
        curve.append((yield from penalised(f)))
        if monitored and (m := (yield "mrr", f, "", None)) > best:
            best, best_at = m, f
    return (best_at if monitored and best > 0 else f), curve


def answered(solver: Solver, answer: Callable[[Request], np.ndarray | float]) -> tuple[Factors, list[float]]:
    """The result of a solver whose requests are answered one by one."""
    try:
        want = next(solver)
        while True:
            want = solver.send(answer(want))
    except StopIteration as end:
        return end.value


def block_answers(x: np.ndarray, y: np.ndarray, r: np.ndarray, requests: list[tuple[Request, int]]) -> list[np.ndarray]:
    """What this block adds to each of the requests(request, bias): one product a side serves the factors of all.

    The bias columns of a vector are ones, so their rows of a factor act as one row, the sum.
    """
    d = x.shape[1]
    fold = lambda m: np.vstack([m[:d], m[d:].sum(axis=0)])
    sides, places = ([], []), []
    for (kind, f, block, v), _ in requests:
        mine = []
        for side, m, on in ((0, f.w, "w"), (1, f.h.T, "h")):
            for part in [m, *([v if on == "w" else v.T] if kind == "hessian" and block == on else [])]:
                start = sum(p.shape[1] for p in sides[side])
                sides[side].append(fold(part))
                mine.append((side, start, start + part.shape[1]))
        places.append(mine)
    products = [np.hstack([m, np.ones((len(m), 1))]) @ np.hstack(s) for m, s in zip((x, y), sides, strict=True)]
    out = []
    for ((kind, f, block, v), bias), mine in zip(requests, places, strict=True):
        got = [products[s][:, a:b] for s, a, b in mine]
        turned = got.pop(1 if block == "w" else 2) if kind == "hessian" and block in "wh" else None
        left, right = got
        p = probabilities((left * right) @ f.c, EPS)
        if kind == "mrr":
            z = (left * right) @ f.c
            out.append(np.array([(1 / (z >= z[np.arange(len(r)), r][:, None]).sum(axis=1)).sum(), len(r)]))
            continue
        if kind == "loss":
            out.append(np.array([-np.log(p[np.arange(len(r)), r] + EPS).sum()]))
            continue
        if kind == "gradient":
            q = p.copy()
            q[np.arange(len(r)), r] -= 1
        else:
            moved = (turned * right if block == "w" else left * turned) @ f.c if turned is not None else (left * right) @ v
            q = p * moved
            q = q - p * q.sum(axis=1, keepdims=True)
        if block == "c":
            out.append((left * right).T @ q)
            continue
        back = (q @ f.c.T) * (right if block == "w" else left)
        m = x if block == "w" else y
        g = np.vstack([m.T @ back, np.repeat(back.sum(axis=0)[None], bias, axis=0)])
        out.append(g if block == "w" else g.T)
    return out


def pass_over(blocks: DataFrame, requests: list[tuple[Request, int]]) -> list[np.ndarray | float]:
    """The answers to all requests(request, bias) by one pass over blocked pairs; zeros if there are no pairs."""
    shapes = [getattr(f, block).shape if block else (2 if kind == "mrr" else 1,) for (kind, f, block, _), _ in requests]
    sums = block_sum(blocks, lambda x, y, r: np.concatenate([a.ravel() for a in block_answers(x, y, r, requests)]), size=sum(int(np.prod(s)) for s in shapes))
    out, at = [], 0
    for ((kind, _, block, _), _), shape in zip(requests, shapes, strict=True):
        size = int(np.prod(shape))
        got = sums[at : at + size].reshape(shape) if len(sums) else np.zeros(shape)
        out.append(float(got[0] / got[1]) if kind == "mrr" and got[1] else float(got[0]) if not block else got)
        at += size
    return out


def fit_arrays(x, y, r, classes: int, k: int, penalty: float, rounds: int, seed: int, valid=None) -> tuple[Factors, list[float]]:
    """In one process, for problems of up to about a million pairs."""

    def answer(want: Request):
        kind, f, block, v = want
        if kind == "mrr":
            z = logits(valid[0], valid[1], f)
            return float((1 / (z >= z[np.arange(len(z)), valid[2]][:, None]).sum(axis=1)).mean())
        if kind == "loss":
            return block_loss(x, y, r, f)
        return block_gradient(x, y, r, f, block) if kind == "gradient" else block_hessian(x, y, r, f, block, v)

    return answered(solve(initial(x.shape[1], k, classes, seed), penalty, rounds, valid is not None and len(valid[2]) > 0), answer)


def _arrays(p: pd.DataFrame):
    return np.array(p["fh"].tolist(), dtype=float), np.array(p["ft"].tolist(), dtype=float), p["label"].to_numpy().astype(int)


def matrix_sum(pairs: DataFrame, kernel: Callable, size: int | None = None) -> np.ndarray:
    """Sum over all blocks of kernel(x, y, labels), an array that comes back flat; pairs(fh, ft, label). size (its numbers) lets few be summed on the driver."""

    def run(batches):
        acc = None
        for p in batches:
            if len(p):
                m = np.atleast_1d(np.asarray(kernel(*_arrays(p)), dtype=float)).ravel()
                acc = m if acc is None else acc + m
        return acc

    return total(pairs.select("fh", "ft", "label"), run, size)


def blocked(pairs: DataFrame) -> DataFrame:
    """pairs(fh, ft, label) in blocks of rows with their numbers as bytes, which many passes read faster; k holds a hash of each row."""

    def run(batches):
        for p in batches:
            if len(p):
                x, y, r = _arrays(p)
                yield pd.DataFrame({"n": [len(p)], "x": [x.tobytes()], "y": [y.tobytes()], "r": [r.astype(np.int64).tobytes()], "k": [p["key"].to_numpy(dtype=np.int64).tobytes()]})

    return pairs.select("fh", "ft", "label", F.xxhash64("fh", "ft", "label").alias("key")).mapInPandas(run, "n int, x binary, y binary, r binary, k binary")


def block_sum(blocks: DataFrame | Blocks, kernel: Callable, bias: int = 0, size: int | None = None) -> np.ndarray:
    """matrix_sum over blocked pairs, whose vectors get `bias` ones more; no blocks give an empty array. The kernel gets coded.CHUNK pairs at once."""
    frame, read = opened(blocks)

    def run(batches):
        acc = None
        for p in batches:
            for b in p.itertuples():
                for on in chunks(b.n):
                    x, y = (np.hstack([v, np.ones((len(v), bias))]) if bias else v for v in read(b, on))
                    m = np.atleast_1d(np.asarray(kernel(x, y, np.frombuffer(b.r, dtype=np.int64)[on]), dtype=float)).ravel()
                    acc = m if acc is None else acc + m
        return acc

    return total(frame.select("n", "x", "y", "r"), run, size)


def fit_distributed(blocks: DataFrame, d: int, classes: int, k: int, penalty: float, rounds: int, seed: int, bias: int = 0, valid: DataFrame | None = None) -> tuple[Factors, list[float]]:
    """One distributed pass over blocked pairs for each loss, gradient and Hessian product; both tables should be persisted."""
    monitored = valid is not None and not valid.isEmpty()
    return answered(solve(initial(d + bias, k, classes, seed), penalty, rounds, monitored), lambda want: pass_over(valid if want[0] == "mrr" else blocks, [(want, bias)])[0])


def scores(pairs: DataFrame, f: Factors, eps: float = 0.0) -> DataFrame:
    """pairs with probs: class probabilities of each pair(fh, ft, ...); vectors are dropped."""
    keep = [c for c in pairs.columns if c not in ("fh", "ft")]

    def run(batches):
        for p in batches:
            z = logits(np.array(p["fh"].tolist(), dtype=float).reshape(len(p), -1), np.array(p["ft"].tolist(), dtype=float).reshape(len(p), -1), f) if len(p) else np.zeros((0, 1))
            yield p[keep].assign(probs=list(probabilities(z, eps)))

    return pairs.mapInPandas(run, pairs.select(*keep)._jdf.schema().toDDL() + ", probs array<double>")


def predict(pairs: DataFrame, f: Factors, relations: DataFrame) -> DataFrame:
    """pairs with the predicted relation: the first class of the largest probability, named by relations(relation, idx)."""
    from ..functions import vectors as V

    return scores(pairs, f).withColumn("idx", V.argmax("probs")).join(F.broadcast(relations.select("idx", F.col("relation").alias("predicted"))), "idx").drop("idx", "probs")


def guarded(metrics: dict[str, float | None], f: Factors) -> dict[str, float | None]:
    """metrics, or nulls for all of them if a factor holds a NaN."""
    return {k: None for k in metrics} if any(np.isnan(m).any() for m in (f.w, f.h, f.c)) else metrics


def fit_configs(pairs: DataFrame | Blocks, configs: DataFrame, classes: int, rounds: int, path: str | None = None) -> DataFrame:
    """Every configuration(config, k, penalty, bias, seed) trained on pairs(fh, ft, label, split) or on coded blocks of them, failures as rows.

    All configurations advance together: each pass over the data answers the next request of every
    one that still runs, so a grid takes as many passes as its slowest member. One that ends, or fails,
    drops out of the passes. With a path, its row is added to the table there as it ends.
    """
    from .ledger import append_result

    spark = configs.sparkSession
    schema = "config int, valid_mrr double, test_mrr double, loss_first double, loss_last double, error string"
    parts, width = by_split(pairs, blocked)
    done: dict[int, tuple] = {}
    running: dict[int, tuple[Solver, Request, int]] = {}

    def end(config: int, row: tuple) -> None:
        done[config] = (config, *row)
        if path:
            append_result(spark.createDataFrame([done[config]], schema), path)

    def advance(config: int, solver: Solver, bias: int, got) -> None:
        try:
            running[config] = solver, solver.send(got), bias
        except StopIteration as e:
            running.pop(config, None)
            f, curve = e.value
            with np.errstate(all="ignore"):
                ends = {s: pass_over(parts[s], [(("mrr", f, "", None), bias)])[0] for s in ("valid", "test")}
            ends = guarded(ends, f)
            if not np.isfinite(curve).all() or None in ends.values():
                end(config, (None, None, None, None, "a factor or loss is no number"))
            else:
                end(config, (ends["valid"], ends["test"], curve[0], curve[-1], None))
        except Exception as e:  # one failed configuration must not end the others
            running.pop(config, None)
            end(config, (None, None, None, None, f"{type(e).__name__}: {e}"))

    try:
        monitored = not parts["valid"].isEmpty()
        for c in configs.orderBy("config").collect() if width else []:  # the grid, not the data
            bias = int(c["bias"])
            try:
                if int(c["k"]) < 1:
                    raise ValueError("k is at least 1")
                advance(int(c["config"]), solve(initial(width + bias, int(c["k"]), classes, int(c["seed"])), float(c["penalty"]), rounds, monitored), bias, None)
            except Exception as e:
                end(int(c["config"]), (None, None, None, None, f"{type(e).__name__}: {e}"))
        while running:
            for table, mine in (("valid", lambda k: k == "mrr"), ("train", lambda k: k != "mrr")):
                now = {c: x for c, x in running.items() if mine(x[1][0])}
                got = pass_over(parts[table], [(want, bias) for _, want, bias in now.values()]) if now else []
                for (config, (solver, _, bias)), answer in zip(now.items(), got, strict=True):
                    advance(config, solver, bias, answer)
    finally:
        for p in parts.values():
            p.unpersist()
    return spark.createDataFrame([done[c] for c in sorted(done)], schema)
