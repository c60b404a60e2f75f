"""Blocks of pairs that many passes read: row numbers in one table of vectors instead of the vectors.

A pair of entities takes two row numbers, its label and a key here, and not two vectors; the table of
vectors goes out to the executors once, in so far as it takes at most `features.BROADCAST` bytes.
Beyond that, or where an entity has several vectors, the blocks hold the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.ordering import with_position
from . import features as entity_features

#: Pairs of a block, pairs that a kernel gets at once (their class scores stay in the cache), pairs of a task.
BLOCK, CHUNK, TASK = 1 << 16, 1 << 10, 1 << 18


@dataclass(frozen=True)
class Blocks:
    """frame(n, x, y, r, k, maybe split) with vectors in x and y, or row numbers of the table `vectors`; d is the vectors' length, how says how a pair's vector is made of both, where that matters."""

    frame: DataFrame
    vectors: Broadcast | None = None
    d: int | None = None
    how: str | None = None

    def of(self, split: str) -> Blocks:
        return Blocks(self.frame.where(F.col("split") == split), self.vectors, self.d, self.how)

    def persist(self) -> Blocks:
        self.frame.persist()
        return self

    def unpersist(self) -> None:
        self.frame.unpersist()

    def isEmpty(self) -> bool:
        return self.frame.isEmpty()


def opened(blocks: DataFrame | Blocks) -> tuple[DataFrame, Callable]:
    """The frame of the blocks, and a function (block, rows) -> x, y that tasks call."""
    if isinstance(blocks, DataFrame):
        blocks = Blocks(blocks)
    vectors = blocks.vectors

    def read(b, rows=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        if vectors is None:
            return tuple(np.frombuffer(v).reshape(b.n, -1)[rows] for v in (b.x, b.y))
        return tuple(vectors.value[np.frombuffer(v, dtype=np.int32)[rows]] for v in (b.x, b.y))

    return blocks.frame, read


def chunks(n: int) -> Iterator[slice]:
    return (slice(a, min(a + CHUNK, n)) for a in range(0, n, CHUNK))


def table(features: DataFrame) -> tuple[DataFrame, np.ndarray] | None:
    """(entity, id; vectors by id) of features(entity, features); None if they take too much room or an entity has several."""
    f = cut(features.select("entity", F.col("features").cast("array<double>").alias("features")))
    size = f.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d"), F.min(F.size("features")).alias("least"), (F.count("*") == F.count_distinct("entity")).alias("once")).first()  # one row
    n, d = size["n"], size["d"] or 0
    if not n or n * (8 * d + 64) > entity_features.BROADCAST or not size["once"] or size["least"] != d:
        return None
    f = cut(with_position(f, ["entity"], "id"))
    out = np.empty((n, d))
    step = max(1, entity_features.AT_ONCE // (8 * d + 64))
    for a in range(0, n, step):  # bounded by BROADCAST in all
        part = f.where(F.col("id").between(a, a + step - 1)).select("id", "features").toArrow()
        out[part["id"].to_numpy()] = part["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return f.select("entity", F.col("id").cast("int").alias("id")), out


def coded(triples: DataFrame, features: DataFrame) -> Blocks:
    """Blocks of triples(head, tail, label, split), a folder for each split; triples without a vector at either end are left out.

    k is a hash of both vectors and the label, as in `cpd.blocked`. The pairs are dealt to tasks as narrow rows.
    """
    spark = triples.sparkSession
    t = cut(triples.select("head", "tail", "label", "split"))
    t = t.repartition(max(3 * spark.sparkContext.defaultParallelism, -(-t.count() // TASK)), "head", "tail")
    found = table(features)
    pairs = entity_features.with_ends(t, features)
    key = F.xxhash64("fh", "ft", "label").alias("k")
    if found is None:
        width = features.select(F.size("features").alias("d")).first()
        pairs = pairs.select("split", F.col("label").cast("long").alias("r"), F.col("fh").alias("x"), F.col("ft").alias("y"), key)
        block, vectors, d = 1 << 13, None, width["d"] if width else None
    else:
        ids, m = found
        for end in ("head", "tail"):
            pairs = pairs.join(F.broadcast(ids.toDF(end, f"__{end}")), end)
        pairs = pairs.select("split", F.col("label").cast("long").alias("r"), F.col("__head").alias("x"), F.col("__tail").alias("y"), key)
        block, vectors, d = BLOCK, spark.sparkContext.broadcast(m), m.shape[1]
    wide = vectors is None

    def raw(part: pd.DataFrame, c: str) -> bytes:
        return (np.array(part[c].tolist(), dtype=float) if wide else part[c].to_numpy(dtype=np.int32)).tobytes()

    def run(batches):
        held: dict[str, list] = {}

        def made(s, rows):
            p = pd.concat(rows)
            for a in range(0, len(p), block):
                q = p[a : a + block]
                yield pd.DataFrame({"split": [s], "n": [len(q)], "x": [raw(q, "x")], "y": [raw(q, "y")], "r": [q["r"].to_numpy(dtype=np.int64).tobytes()], "k": [q["k"].to_numpy(dtype=np.int64).tobytes()]})

        for p in batches:
            for s, part in p.groupby("split"):
                rows = held.setdefault(s, [])
                rows.append(part)
                if sum(map(len, rows)) >= block:
                    yield from made(s, held.pop(s))
        for s, rows in held.items():
            yield from made(s, rows)

    return Blocks(cut(pairs.mapInPandas(run, "split string, n int, x binary, y binary, r binary, k binary"), by="split"), vectors, d)


def by_split(pairs: DataFrame | Blocks, blocked: Callable) -> tuple[dict[str, Blocks], int | None]:
    """The blocks of each split, persisted, and the length of the vectors; pairs(fh, ft, label, split) that are no blocks yet are made so by blocked."""
    names = ("train", "valid", "test")
    if isinstance(pairs, Blocks):
        return {s: pairs.of(s).persist() for s in names}, pairs.d
    width = pairs.select(F.size("fh").alias("d")).first()
    return {s: Blocks(blocked(pairs.where(F.col("split") == s))).persist() for s in names}, width["d"] if width else None
