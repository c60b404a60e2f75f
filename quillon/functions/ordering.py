"""Global positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


#: Rows of a sorted range.
RANGE = 1 << 20


def with_position(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their 0-based place in the order of the given columns.

    Rows are range-partitioned and sorted; places within a partition are shifted by the sizes
    of the partitions before it (one row for each partition, broadcast). The rows are written
    before they are sorted, as the ranges are sampled from them, and after, as both steps must see
    the same partitions even after executors are lost. There are so many ranges that one holds about
    RANGE rows at most, so that a task's memory does not grow with the table.
    """
    written = cut(rows)
    spark = rows.sparkSession
    ranges = -(-written.count() // RANGE)  # the files' own counts
    few = ranges <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = written.orderBy(*order) if few else written.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ordered = cut(ordered.withColumn("__place", F.monotonically_increasing_id()))
    part, place = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    out = ordered.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.withColumn(name, place + F.col("__base")).drop("__part", "__place", "__base")
