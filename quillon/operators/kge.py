"""Bilinear knowledge-graph embedding scores and their trainer."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coded import Blocks, by_split
from .cpd import block_sum, blocked
from .optim import Adam, Params, epoch
from .ranking import conformal_by

#: Adam settings of the trainer: learning rate, weight decay, gradient clip.
RATE, DECAY, CLIP = 1e-3, 1e-5, 1.0


def closed_form(name: str, classes: int, dim: int) -> dict[str, np.ndarray]:
    """Relation parameters without a random generator."""
    r, half = np.arange(classes)[:, None], dim // 2
    if name == "distmult":
        return {"rel": np.sin(5 * r + 3 * np.arange(dim))}
    if name == "complex":
        return {"re": np.sin(5 * r + 3 * np.arange(half)), "im": np.cos(2 * r + 7 * np.arange(half))}
    return {"phase": np.sin(5 * r + 3 * np.arange(half)) * np.pi}


def features(name: str, h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The pair's vector that a linear layer over classes scores.

    complex and rotate split vectors into real and imaginary halves (an odd last dimension is
    left out) and use Re(h t r*), which is symmetric in h and t.
    """
    if name == "distmult":
        return h * t
    half = h.shape[1] // 2
    hr, hi, tr, ti = h[:, :half], h[:, half : 2 * half], t[:, :half], t[:, half : 2 * half]
    return np.hstack([hr * tr - hi * ti, hr * ti + hi * tr])


def layer(name: str, p: dict[str, np.ndarray]) -> np.ndarray:
    if name == "distmult":
        return p["rel"]
    if name == "complex":
        return np.hstack([p["re"], p["im"]])
    return np.hstack([np.cos(p["phase"]), np.sin(p["phase"])])


def score(name: str, h: np.ndarray, t: np.ndarray, p: dict[str, np.ndarray], variant: str = "reference") -> np.ndarray:
    """Scores of all classes; variant "canonical" uses Re(h r t*) and, for rotate, -|h r - t|."""
    if variant == "reference" or name == "distmult":
        return features(name, h, t) @ layer(name, p).T
    half = h.shape[1] // 2
    hc, tc = h[:, :half] + 1j * h[:, half : 2 * half], t[:, :half] + 1j * t[:, half : 2 * half]
    if name == "complex":
        return ((hc * tc.conj()) @ (p["re"] + 1j * p["im"]).T).real
    turn = np.exp(1j * p["phase"])
    return -np.stack([np.abs(hc * q - tc).sum(axis=1) for q in turn], axis=1)


def ranks(pairs: DataFrame, name: str, params: dict[str, np.ndarray], variant: str = "reference") -> DataFrame:
    """label, rank (pessimistic) of each pair(fh, ft, label)."""

    def run(batches):
        for p in batches:
            if len(p):
                z = score(name, np.array(p["fh"].tolist()), np.array(p["ft"].tolist()), params, variant)
                r = p["label"].to_numpy().astype(int)
                yield pd.DataFrame({"label": r, "rank": (z >= z[np.arange(len(r)), r][:, None]).sum(axis=1)})

    return pairs.select("fh", "ft", "label").mapInPandas(run, "label int, rank int")


def initial(name: str, d: int, classes: int, dim: int, seed: int) -> Params:
    """The shared linear layer and the relation parameters before training."""
    rng = np.random.default_rng(seed)
    p = {"lin": rng.uniform(-1, 1, (d, dim)) / np.sqrt(d), "bias": np.zeros(dim)}
    if name == "rotate":
        return p | {"phase": rng.uniform(-np.pi, np.pi, (classes, dim // 2))}
    if name == "complex":
        return p | {k: rng.standard_normal((classes, dim // 2)) * np.sqrt(2 / (classes + dim // 2)) for k in ("re", "im")}
    return p | {"rel": rng.standard_normal((classes, dim)) * np.sqrt(2 / (classes + dim))}


def gradient(name: str, p: Params, h: np.ndarray, t: np.ndarray, r: np.ndarray, rng, dropout: float = 0.0) -> tuple[float, Params]:
    """Sums over the pairs of the cross-entropy and of its gradients; the inputs are dropped, inverted."""
    n, d = h.shape
    keep = [(rng.random((n, d)) >= dropout) / (1 - dropout) if dropout else 1.0 for _ in "ht"]
    xh, xt = h * keep[0], t * keep[1]
    a, b = xh @ p["lin"] + p["bias"], xt @ p["lin"] + p["bias"]
    u, w = features(name, a, b), layer(name, p)
    z = u @ w.T
    e = np.exp(z - z.max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    loss = -np.log(e[np.arange(n), r] + 1e-300).sum()
    e[np.arange(n), r] -= 1
    gu, gw = e @ w, e.T @ u
    g: Params = {}
    if name == "distmult":
        ga, gb = gu * b, gu * a
        g["rel"] = gw
    else:
        f = a.shape[1] // 2
        re, im = gu[:, :f], gu[:, f:]
        ga, gb = np.zeros_like(a), np.zeros_like(b)
        for own, other in ((ga, b), (gb, a)):
            own[:, :f] = re * other[:, :f] + im * other[:, f : 2 * f]
            own[:, f : 2 * f] = -re * other[:, f : 2 * f] + im * other[:, :f]
        if name == "complex":
            g["re"], g["im"] = gw[:, :f], gw[:, f:]
        else:
            g["phase"] = -np.sin(p["phase"]) * gw[:, :f] + np.cos(p["phase"]) * gw[:, f:]
    g["lin"], g["bias"] = xh.T @ ga + xt.T @ gb, ga.sum(axis=0) + gb.sum(axis=0)
    return float(loss), g


def block_metrics(blocks: DataFrame | Blocks, name: str, p: Params) -> dict[str, float]:
    """mrr and hits_1 by pessimistic ranks over blocked pairs; zeros if there are none."""

    def kernel(x, y, r):
        z = score(name, x @ p["lin"] + p["bias"], y @ p["lin"] + p["bias"], p)
        rank = (z >= z[np.arange(len(z)), r][:, None]).sum(axis=1)
        return np.array([(1 / rank).sum(), (rank <= 1).sum(), len(rank)])

    total = block_sum(blocks, kernel, size=3)
    return {"mrr": float(total[0] / total[2]), "hits_1": float(total[1] / total[2])} if len(total) else {"mrr": 0.0, "hits_1": 0.0}


def fit(blocks: DataFrame | Blocks, name: str, d: int, classes: int, dim: int = 512, epochs: int = 30, batch: int = 1024, seed: int = 0, dropout: float = 0.3, valid: DataFrame | Blocks | None = None, every: int = 5, patience: int = 20, rate: float = RATE) -> tuple[Params, list[float]]:
    """A shared linear layer on frozen features and relation parameters, by Adam on cross-entropy; and the loss of each epoch.

    Every mini-batch step is one distributed gradient over blocked pairs (cpd.blocked); the moments of Adam
    stay from step to step. The parameters of the best validation MRR are restored; the rate halves when
    it stalls five evaluations, and `patience` evaluations without a better one end the training.
    """
    p, curve, stall, adam = initial(name, d, classes, dim, seed), [], 0, Adam(rate, DECAY, CLIP)
    best, kept = -1.0, p
    for at in range(epochs):
        p, loss = epoch(blocks, p, lambda q, x, y, r, noise: gradient(name, q, x, y, r, noise, dropout), adam, batch, seed + at)
        curve.append(loss)
        if valid is not None and ((at + 1) % every == 0 or at == epochs - 1):
            mrr = block_metrics(valid, name, p)["mrr"]
            if mrr > best:
                best, kept, stall = mrr, p, 0
            else:
                stall += 1
                adam.rate *= 0.5 if stall % 5 == 0 else 1
                if stall >= patience:
                    break
    return (kept if best >= 0 else p), curve


def fit_methods(pairs: DataFrame | Blocks, methods: list[str], classes: int, dim: int, epochs: int, batch: int = 1024, rate: float = RATE) -> DataFrame:
    """method, loss_first, loss_last, test_mrr, test_hits_1 of each method trained on pairs(fh, ft, label, split) or coded blocks of them.

    The methods are trained beside each other: a mini-batch step is a small job, so their jobs run together.
    """
    parts, width = by_split(pairs, blocked)
    spark = parts["train"].frame.sparkSession

    def one(name: str) -> tuple:
        p, curve = fit(parts["train"], name, width, classes, dim, epochs, batch, valid=parts["valid"], rate=rate)
        m = block_metrics(parts["test"], name, p)
        return name, curve[0], curve[-1], m["mrr"], m["hits_1"]

    try:
        with ThreadPoolExecutor(max(1, len(methods))) as pool:
            out = list(pool.map(one, methods if width else []))
    finally:
        for x in parts.values():
            x.unpersist()
    return spark.createDataFrame(out, "method string, loss_first double, loss_last double, test_mrr double, test_hits_1 double")


def probabilities(pairs: DataFrame, name: str, params: Params) -> DataFrame:
    """pairs with probs, the softmax of the scores of pairs(fh, ft, ...); vectors are dropped."""
    keep = [c for c in pairs.columns if c not in ("fh", "ft")]

    def run(batches):
        for p in batches:
            if len(p):
                z = score(name, np.array(p["fh"].tolist()), np.array(p["ft"].tolist()), params)
                e = np.exp(z - z.max(axis=1, keepdims=True))
                yield p[keep].assign(probs=list(e / e.sum(axis=1, keepdims=True)))

    return pairs.mapInPandas(run, pairs.select(*keep)._jdf.schema().toDDL() + ", probs array<double>")


def conformal(calibration: DataFrame, test: DataFrame, name: str, params: Params, alphas: list[float]) -> DataFrame:
    """alpha, coverage, mean_size of the conformal sets of test pairs(fh, ft, label); no rows if either side is empty."""

    def probs(f: pd.DataFrame) -> np.ndarray:
        z = score(name, np.array(f["fh"].tolist()), np.array(f["ft"].tolist()), params)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return conformal_by(probs, calibration.select("fh", "ft", "label"), test.select("fh", "ft", "label"), alphas)
