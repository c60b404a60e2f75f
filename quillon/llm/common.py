"""Shared helpers: table access, tables in the shared folder (stash), connected components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut as stash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small: texts may be long and executors have little memory for Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def forest(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Union-find over one batch of edges: (vertex, root) for every vertex that is not its own root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in zip(left, right, strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return [(x, find(x)) for x in parent if find(x) != x]


def _contract(batches):
    for pdf in batches:
        yield pd.DataFrame(forest(pdf["a"].tolist(), pdf["b"].tolist()), columns=["a", "b"]).astype("int64")


#: Contracted edges up to so many rows (16 bytes each) are finished by union-find in one task; beyond, by distributed rounds.
ONE_TASK = 200_000


def _finish(batches):
    left, right = [], []
    for pdf in batches:
        left += pdf["a"].tolist()
        right += pdf["b"].tolist()
    yield pd.DataFrame(forest(left, right), columns=["vertex", "component"]).astype("int64")


def components(edges: DataFrame, max_rounds: int = 60, one_task: int | None = None) -> DataFrame:
    """(vertex, component) for the vertices of edges(a, b) that are not the smallest of theirs; component is the smallest vertex reachable.

    Each batch of edges is first contracted by union-find. What is left is counted: up to
    one_task rows go to one task, more to large-star and small-star rounds, which run as joins
    and aggregates until no edge changes. Both give the same rows. Hubs are split by the join.
    Self loops and nulls are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    e = e.mapInPandas(_contract, "a long, b long")  # a > b
    e = stash(e.distinct())
    if e.count() <= (ONE_TASK if one_task is None else one_task):
        return e.coalesce(1).mapInPandas(_finish, "vertex long, component long")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = stash(e.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point within max_rounds")
    return e.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
