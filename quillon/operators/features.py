"""Entity features: assembly, imputation, standardisation, pair features, pooling of prompt states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.lineage import cut


def with_features(entities: DataFrame, features: DataFrame, dim: int, fill: str = "zero", seed: int = 0) -> DataFrame:
    """entity, features: missing vectors become zeros, or draws of N(0, 0.1) that depend on entity and seed only."""
    out = entities.join(features.select("entity", "features"), "entity", "left")
    if fill == "zero":
        value = F.array_repeat(F.lit(0.0), dim)
    else:
        u = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64("entity", F.lit(seed), i), F.lit(1 << 40)) + 1) / float((1 << 40) + 1))
        v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pmod(F.xxhash64("entity", F.lit(seed + 1), i), F.lit(1 << 40)) / float(1 << 40))
        value = F.zip_with(u, v, lambda a, b: 0.1 * F.sqrt(-2 * F.log(a)) * F.cos(6.283185307179586 * b))
    return out.withColumn("features", F.coalesce("features", value))


def scaler(features: DataFrame) -> DataFrame:
    """pos, mean, std: population deviation of each dimension; a constant dimension has scale 1."""
    out = features.select(F.posexplode("features").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def standardised(features: DataFrame, bias: int = 0) -> DataFrame:
    """features scaled over all entities, followed by `bias` ones."""
    s = scaler(features).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("s"))  # one row: as many items as dimensions
    out = features.crossJoin(F.broadcast(s))
    scaled = F.zip_with("features", "s", lambda x, p: (x - p["mean"]) / p["std"])
    if bias:
        scaled = F.concat(scaled, F.array_repeat(F.lit(1.0), bias))
    return out.withColumn("features", scaled).drop("s")


#: Bytes of vectors in one broadcast, and of all that are broadcast; a larger table of vectors is shuffled.
AT_ONCE, BROADCAST = 32 << 20, 512 << 20


def with_ends(triples: DataFrame, features: DataFrame) -> DataFrame:
    """triples with fh and ft, the features of head and tail; triples without either are left out.

    A vector is much wider than a triple, so the triples stay where they are as long as the vectors take
    at most BROADCAST bytes: the table goes out in parts of AT_ONCE bytes. Then no wide row is shuffled,
    however many triples there are. Beyond that both are joined by shuffles. features is written once.
    """
    kind = features.schema["features"].dataType
    f = cut(features.select("entity", "features"))
    size = f.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d"), (F.count("*") == F.count_distinct("entity")).alias("once")).first()  # one row
    each = 4 if kind.elementType.simpleString() == "float" else 8
    total = size["n"] * (each * (size["d"] or 0) + 64)
    if total > BROADCAST or not size["once"]:
        return triples.join(f.toDF("head", "fh"), "head").join(f.toDF("tail", "ft"), "tail")
    parts = -(-total // AT_ONCE) or 1
    out = triples
    for end, name in (("head", "fh"), ("tail", "ft")):
        if parts == 1:
            out = out.join(F.broadcast(f.toDF(end, name)), end)
            continue
        found = []
        for i in range(parts):
            part = f.where(F.pmod(F.xxhash64("entity"), F.lit(parts)) == i).toDF(f"__e{i}", f"__f{i}")
            out = out.join(F.broadcast(part), F.col(end) == F.col(f"__e{i}"), "left").drop(f"__e{i}")
            found.append(f"__f{i}")
        out = out.withColumn(name, F.coalesce(*found)).drop(*found).where(F.col(name).isNotNull())
    return out


def pairs(triples: DataFrame, features: DataFrame, how: str) -> DataFrame:
    """triples with x: both vectors (concat), head - tail (subtract) or their product (hadamard)."""
    out = with_ends(triples, features)
    make = {"concat": F.concat, "subtract": V.subtract, "hadamard": V.hadamard}[how]
    return out.withColumn("x", make("fh", "ft")).drop("fh", "ft")


def prompts(entities: DataFrame, templates: list[str], masked: bool, mask: str = "<mask>") -> DataFrame:
    """entity, template, text: every template filled in for every entity(entity, label).

    [1] is the label, or the id with blanks for underscores. Masked models get the mask token
    for [2]; causal models get the text before [2] and a colon.
    """
    t = entities.sparkSession.createDataFrame(list(enumerate(templates)), "template int, pattern string")
    name = F.coalesce("label", F.regexp_replace("entity", "_", " "))
    filled = F.replace("pattern", F.lit("[1]"), name)
    text = F.replace(filled, F.lit("[2]"), F.lit(mask)) if masked else F.concat(F.trim(F.substring_index(filled, "[2]", 1)), F.lit(":"))
    return entities.crossJoin(F.broadcast(t)).select("entity", "template", text.alias("text"))


def pooled(states: DataFrame, how: str) -> DataFrame:
    """states(entity, states array of vectors) with `pooled`: sum, mean, concat or attention.

    Attention takes the first state as the query and the others as keys and values, with an
    unscaled softmax, and adds the query to the result.
    """
    if how == "concat":
        return states.withColumn("pooled", F.flatten("states"))
    if how in ("sum", "mean"):
        first = F.element_at("states", 1)
        s = F.aggregate(F.slice("states", 2, F.size("states")), first, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
        return states.withColumn("pooled", F.transform(s, lambda x: x / F.size("states")) if how == "mean" else s)
    query, keys = F.element_at("states", 1), F.slice("states", 2, F.size("states"))
    out = states.withColumn("__q", query).withColumn("__k", keys).withColumn("__w", V.softmax(F.transform("__k", lambda k: V.dot("__q", k))))
    mixed = F.aggregate(F.zip_with("__k", "__w", lambda k, w: F.transform(k, lambda x: x * w)), F.transform("__q", lambda x: x), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    return out.withColumn("pooled", mixed).drop("__q", "__k", "__w")


def pool_weights(dim: int, templates: int, inner: int, out: int, how: str, seed: int = 28) -> dict[str, np.ndarray]:
    """Untrained weights of an encoder a template and of the output layer, uniform in +-1 / sqrt(inputs)."""
    rng = np.random.RandomState(seed)
    wide = inner * templates if how == "concat" else inner
    draw = lambda n, *shape: rng.uniform(-1, 1, shape) / np.sqrt(n)
    return {"w": draw(dim, templates, dim, inner), "b": draw(dim, templates, inner), "out": draw(wide, wide, out), "bias": draw(wide, out)}


def closed_form_pool(dim: int, templates: int, inner: int, out: int, how: str) -> dict[str, np.ndarray]:
    """The same without a random generator."""
    wide = inner * templates if how == "concat" else inner
    t, i, o, k = np.arange(templates)[:, None, None], np.arange(dim)[:, None], np.arange(inner), np.arange(out)
    return {"w": np.sin(3 * t + 5 * i + 7 * o) / 4, "b": np.cos(t[:, 0] + o) / 4, "out": np.cos(2 * np.arange(wide)[:, None] + 3 * k) / 2, "bias": np.sin(k)}


def layer_normed(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Zero mean and unit population variance along the last axis."""
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + eps)


def _encoded(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    return np.einsum("ntd,tdo->nto", layer_normed(x), w["w"]) + w["b"]


def _by_batch(states: DataFrame, name: str, kind: str, f) -> DataFrame:
    entity = states.schema["entity"].dataType.simpleString()

    def run(batches):
        for p in batches:
            if len(p):
                x = np.array([[list(v) for v in row] for row in p["states"]], dtype=float)
                yield pd.DataFrame({"entity": p["entity"], name: f(x)})

    return states.select("entity", "states").mapInPandas(run, f"entity {entity}, {name} {kind}")


def prompt_encoded(states: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """entity, encoded: each template's state normalised and put through its own linear layer; dropout is off outside training."""
    return _by_batch(states, "encoded", "array<array<double>>", lambda x: [[v.tolist() for v in row] for row in _encoded(x, weights)])


def pool_applied(states: DataFrame, weights: dict[str, np.ndarray], how: str) -> DataFrame:
    """entity, features: states encoded a template, pooled (see pooled), rectified, put through the output layer and a sigmoid."""

    def f(x):
        e = _encoded(x, weights)
        if how == "concat":
            c = e.reshape(len(e), -1)
        elif how in ("sum", "mean"):
            c = e.sum(axis=1) if how == "sum" else e.mean(axis=1)
        else:
            q, k = e[:, 0], e[:, 1:]
            s = np.einsum("nd,ntd->nt", q, k)
            a = np.exp(s - s.max(axis=1, keepdims=True))
            c = q + np.einsum("nt,ntd->nd", a / a.sum(axis=1, keepdims=True), k)
        return list(1 / (1 + np.exp(-(np.maximum(c, 0) @ weights["out"] + weights["bias"]))))

    return _by_batch(states, "features", "array<double>", f)
