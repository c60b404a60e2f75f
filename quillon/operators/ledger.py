"""The experiment ledger: upsert, pending work, summaries, grids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.versioned import Versioned
from .splits import base_version

KEYS = ["method", "model", "aggregation", "version"]
HOUSEKEEPING = {*KEYS, "base_version", "train_time_s"}
#: The order of methods in reports, unless a caller gives its own; others come last.
METHOD_ORDER = {"feature_translation": 0, "lr_concat": 1, "lr_subtract": 2, "rf_concat": 3, "rf_subtract": 4, "gbt_concat": 5, "gbt_subtract": 6, "distmult": 7, "complex": 8, "rotate": 9, "tensor_softmax": 10, "subgraph_network": 11}


def upsert(old: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """old without the keys of new, then new; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_upsert(new: DataFrame, path: str, keys: list[str] = KEYS) -> None:
    """Upsert into the ledger at path, a versioned table: the merged rows become its next version, all or nothing."""
    table = Versioned(new.sparkSession, path)
    table.write(upsert(table.read(), new, keys) if table.exists() else new)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """The ledger that write_upsert keeps at path."""
    return Versioned(spark, path).read()


def completed(ledger: DataFrame) -> DataFrame:
    return ledger.select(*KEYS).distinct()


def pending(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """Experiments that the ledger lacks."""
    return wanted.join(completed(ledger), KEYS, "left_anti")


def pending_families(wanted: DataFrame, ledger: DataFrame, methods: list[str]) -> DataFrame:
    """wanted(model, aggregation, version) whose family of methods isn't complete in the ledger."""
    by = ["model", "aggregation", "version"]
    done = ledger.where(F.col("method").isin(methods)).groupBy(*by).agg(F.count_distinct("method").alias("n")).where(F.col("n") == len(set(methods)))
    return wanted.join(done, by, "left_anti")


def metric_columns(ledger: DataFrame) -> list[str]:
    return [f.name for f in ledger.schema if isinstance(f.dataType, T.NumericType) and f.name not in HOUSEKEEPING]


def spread(column: str) -> list[Column]:
    """Mean and sample deviation, rounded half to even at 6 digits: 0 for one value, null for none."""
    c = F.col(column)
    std = F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))
    return [F.bround(F.avg(c), 6).alias(f"{column}_mean"), F.bround(std, 6).alias(f"{column}_std")]


def summary(ledger: DataFrame, bases: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """One row for each method, model, aggregation and base version: seeds, and mean and deviation of each metric."""
    by = ["method", "model", "aggregation", "base_version"]
    out = ledger.withColumn("base_version", base_version("version")).dropna(subset=by)
    if bases is not None:
        out = out.where(F.col("base_version").isin(bases))
    metrics = metrics or metric_columns(ledger)
    return out.groupBy(*by).agg(F.count_distinct("version").alias("n_seeds"), *[x for m in metrics for x in spread(m)])


def method_place(column: str = "method", order: dict[str, int] | None = None) -> Column:
    order = order or METHOD_ORDER
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col(column)), F.lit(99))


def report(summarised: DataFrame, metrics: list[str], digits: int = 4, order: dict[str, int] | None = None) -> DataFrame:
    """Text cells "mean+/-std", N/A for nulls, with a column place for sorting by base version, model and method."""
    cell = [F.when(F.col(f"{m}_mean").isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f+/-%.{digits}f", f"{m}_mean", f"{m}_std")).alias(m) for m in metrics]
    return summarised.select("base_version", "model", "method", method_place(order=order).alias("place"), "n_seeds", *cell)


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of the values of the axes, numbered in order."""
    names = list(axes)
    rows = [(i, *v) for i, v in enumerate(product(*axes.values()))]
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    return spark.createDataFrame(rows, "config long, " + ", ".join(f"{n} {kinds[type(axes[n][0])]}" for n in names))


def best(results: DataFrame, by: list[str], metric: str, k: int = 1) -> DataFrame:
    """Configurations by the mean of a metric over their successful runs, best first; failures (nulls) are left out."""
    mean = results.groupBy(*by).agg(F.avg(metric).alias(f"{metric}_mean"), F.count(metric).alias("runs")).where("runs > 0")
    return mean.orderBy(F.desc(f"{metric}_mean"), *by).limit(k)


def with_prefix(ledger: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text in column starts with prefix; nulls do not."""
    return ledger.where(F.col(column).startswith(prefix))


def present(table: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the list that the table has, in the order of the list."""
    return table.select(*[c for c in columns if c in table.columns])


def config_summary(results: DataFrame, by: list[str], metrics: list[str], seed: str = "seed") -> DataFrame:
    """by, n_seeds, and mean and deviation of each metric over the seeds of a configuration; failed runs (nulls) are left out of both."""
    return results.groupBy(*by).agg(F.count_distinct(F.when(F.col(metrics[0]).isNotNull(), F.col(seed))).alias("n_seeds"), *[x for m in metrics for x in spread(m)])


def append_result(row: DataFrame, path: str) -> None:
    """A finished configuration's row added to the tuning table: what is done survives a stop."""
    row.write.mode("append").parquet(path)


def running_best(results: DataFrame, by: list[str], order: str, metric: str, strict: bool = True) -> DataFrame:
    """Rows with `improved`: whether the metric beat (or, not strict, reached) the best of all rows before."""
    before = F.max(metric).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    better = F.col(metric) > before if strict else F.col(metric) >= before
    return results.withColumn("improved", F.coalesce(better, F.lit(True)))
