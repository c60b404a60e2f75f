"""Vocabularies: dense and first-seen indexes, and triples mapped to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import with_position


def dense_index(keys: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Distinct values of key with their 0-based place in sorted order."""
    return with_position(keys.select(key).distinct(), [key], name)


def first_seen_index(triples: DataFrame, pos: str = "pos") -> DataFrame:
    """entity, idx in order of first occurrence, head before tail."""
    seen = triples.select(F.explode(F.array(F.struct(F.col("head").alias("entity"), (2 * F.col(pos)).alias("at")), F.struct(F.col("tail").alias("entity"), (2 * F.col(pos) + 1).alias("at")))).alias("x")).select("x.*")
    first = seen.groupBy("entity").agg(F.min("at").alias("at"))
    index = dense_index(first, "at")
    return first.join(index, "at").select("entity", "idx")


def entity_set(triples: DataFrame) -> DataFrame:
    return triples.select(F.explode(F.array("head", "tail")).alias("entity")).distinct()


def indexed(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """h, t, r for triples whose three elements are known."""
    e = entities.select("entity", "idx")
    out = triples.join(e.toDF("head", "h"), "head").join(e.toDF("tail", "t"), "tail").join(relations.toDF("relation", "r"), "relation")
    return out.select("h", "t", "r")


def unknown(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples with an endpoint outside the vocabulary."""
    e = entities.select("entity", F.lit(True).alias("known"))
    out = triples.join(e.toDF("head", "kh"), "head", "left").join(e.toDF("tail", "kt"), "tail", "left")
    return out.where("kh is null or kt is null").drop("kh", "kt")


def encoded(triples: DataFrame, column: str, domain: DataFrame | list | None = None, offset: int = 1) -> DataFrame:
    """triples with `<column>_id`: the place of the label in the sorted domain, plus offset.

    The domain is the labels of the triples themselves (None), an explicit list, or another
    frame's labels, such as the training split's. A label outside the domain raises when the
    row is read; a null label gets a null id.
    """
    spark = triples.sparkSession
    if domain is None:
        domain = triples
    elif isinstance(domain, list):
        domain = spark.createDataFrame([(x,) for x in domain], triples.select(column).schema)
    index = dense_index(domain.where(F.col(column).isNotNull()), column, "__id").withColumnRenamed(column, "__label")
    out = triples.join(index, F.col(column) == F.col("__label"), "left")
    strange = F.raise_error(F.concat(F.lit(f"{column} outside the domain: "), F.col(column).cast("string")))
    place = F.when(F.col(column).isNull(), F.lit(None)).when(F.col("__id").isNull(), strange.cast("long")).otherwise(F.col("__id") + offset)
    return out.withColumn(f"{column}_id", place).drop("__id", "__label")


def one_hot(ids: DataFrame, column: str, classes: int, offset: int = 1, name: str = "one_hot") -> DataFrame:
    """ids with an array of 0 and 1: 1 at the place of column - offset, none for a null."""
    return ids.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda x: (F.coalesce(x == F.col(column) - offset, F.lit(False))).cast("int")))


def density(triples: DataFrame, n: int) -> DataFrame:
    """Share of filled cells of the n x n matrix."""
    return triples.agg((F.count("*") / F.lit(float(n) * n)).alias("density"))
