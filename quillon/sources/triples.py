"""Readers and writers of triples, labels, features and ledgers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut
from ..functions.ordering import with_position
from ..operators.splits import version_seed

SPLITS = ("train", "valid", "test")


def lines(spark: SparkSession, path: str, fields: int = 3, strict: bool = True) -> DataFrame:
    """a (array of fields) and file of the tab-separated lines of text files.

    strict takes lines of exactly so many fields, else lines of at least so many (extra
    fields are left out); both trim the line first and skip blank ones.
    """
    parts = F.split(F.trim(F.regexp_replace("value", r"[\r\n]+$", "")), "\t")
    out = spark.read.text(path).select(parts.alias("a"), F.col("_metadata.file_path").alias("file"))
    return out.where(F.size("a") == fields if strict else F.size("a") >= fields)


def read_triples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """head, relation, tail, file; path may be a glob."""
    return lines(spark, path, 3, strict).select(F.col("a")[0].alias("head"), F.col("a")[1].alias("relation"), F.col("a")[2].alias("tail"), "file")


def read_splits(spark: SparkSession, directory: str, strict: bool = True) -> DataFrame:
    """head, relation, tail, split of train.txt, valid.txt and test.txt; a missing file raises when it is read."""
    parts = [read_triples(spark, f"{directory}/{s}.txt", strict).drop("file").withColumn("split", F.lit(s)) for s in SPLITS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file and line (from 0 in each file) of text files, which Spark reads by ranges of their bytes.

    Lines are numbered within the range that they begin in; the ranges before it, one row each, are added up.
    """
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = cut(spark.read.text(path).select("value", at.alias("range"), F.monotonically_increasing_id().alias("id")))
    ranges = rows.groupBy("range").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("range.file").orderBy("range.start").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranges.select("range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(shift, "range").select("value", "range.file", (F.col("id") + F.col("shift")).alias("line"))


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """Triples of one file with pos, their order in the file."""
    a = F.split(F.trim("value"), "\t")
    rows = numbered_lines(spark, path).select("line", a.alias("a")).where(F.size("a") == 3).select("line", F.col("a")[0].alias("head"), F.col("a")[1].alias("relation"), F.col("a")[2].alias("tail"))
    return with_position(rows, ["line"], "pos").drop("line")


def indexed_with_skips(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, Observation]:
    """(h, t, r of the triples whose elements are known, an observation of `total` and `skipped`).

    entities(entity, idx) and relations(relation, idx) are joined once; the counts come with whatever
    action reads the rows, and are there once it has ended.
    """
    e = entities.select("entity", "idx")
    out = triples.join(e.toDF("head", "h"), "head", "left").join(e.toDF("tail", "t"), "tail", "left").join(relations.select("relation", F.col("idx").alias("r")), "relation", "left")
    lost = F.col("h").isNull() | F.col("t").isNull() | F.col("r").isNull()
    seen = Observation()
    out = out.withColumn("__lost", lost).observe(seen, F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("__lost").cast("long")), F.lit(0)).alias("skipped"))
    return out.where(~F.col("__lost")).select("h", "t", "r"), seen


def write_splits(triples: DataFrame, directory: str, by: list[str] | None = None) -> None:
    """Tab-separated files in directories by version or seed, and split; pos, if there, orders each file.

    Directories that the triples have no rows for, such as other seeds', stay as they are.
    """
    keys = [*(by or []), "split"]
    out = triples.repartition(*[F.col(k) for k in keys])
    order = keys + (["pos"] if "pos" in triples.columns else [])
    out.sortWithinPartitions(*order).select(*keys, "head", "relation", "tail").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).option("sep", "\t").csv(directory)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """entity, label of two-field lines; of several rows of an entity the last in the file counts."""
    a = F.split(F.trim("value"), "\t")
    rows = numbered_lines(spark, path).select("line", a.alias("a")).where(F.size("a") >= 2).select(F.col("a")[0].alias("entity"), F.col("a")[1].alias("label"), "line")
    return rows.groupBy("entity").agg(F.max_by("label", "line").alias("label"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """entity, features from Parquet."""
    return spark.read.parquet(path).select("entity", F.col("features").cast("array<double>").alias("features"))


def write_features(features: DataFrame, path: str) -> None:
    features.select("entity", "features").write.mode("overwrite").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A ledger exported as CSV with a header; numbers that are missing are null."""
    return spark.read.csv(path, header=True, inferSchema=True)


def write_report(table: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], **key: object) -> DataFrame:
    """The table at path, built and written first where there is none; a write that broke off is built again.

    key (plain values, such as a model's name and its parameters) tells tables of the same path apart.
    """
    if key:
        path = f"{path}/{hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:24]}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_factors(spark: SparkSession, factors: dict[str, np.ndarray], path: str) -> None:
    """Model parameters as rows (name, row, values)."""
    rows = [(name, i, [float(x) for x in v]) for name, m in factors.items() for i, v in enumerate(np.atleast_2d(m))]
    spark.createDataFrame(rows, "name string, row int, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def read_factors(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The parameters that write_factors wrote, as matrices; as large as the model."""
    out: dict[str, list] = {}
    for r in spark.read.parquet(path).orderBy("name", "row").collect():
        out.setdefault(r["name"], []).append(r["values"])
    return {k: np.array(v) for k, v in out.items()}


def read_versions(spark: SparkSession, glob: str) -> DataFrame:
    """head, relation, tail, split, version, seed of split files under directories such as v1_ind_seed7001."""
    version, seed = version_seed("file")
    t = read_triples(spark, glob)
    return t.withColumn("version", version).withColumn("seed", seed).withColumn("split", F.regexp_extract("file", r"(train|valid|test)\.txt$", 1)).where("split <> ''").drop("file")
