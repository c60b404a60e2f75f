"""Streams: triples scored as they arrive, late-data aggregates over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def translation_scores(stream: DataFrame, features: DataFrame, classes: DataFrame) -> DataFrame:
    """head, tail, predicted for a stream(head, tail): static features are joined, the nearest translation wins.

    classes is the single row of ranking.class_table.
    """
    f = features.select("entity", "features")
    out = stream.join(f.toDF("head", "fh"), "head").join(f.toDF("tail", "ft"), "tail").crossJoin(F.broadcast(classes))
    move = V.subtract("ft", "fh")
    out = out.withColumn("__m", move).withColumn("__s", F.transform("class_vectors", lambda v: -V.distance("__m", v)))
    return out.select("head", "tail", F.element_at("classes", (V.argmax("__s") + 1).cast("int")).alias("predicted"))


def windowed_means(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, mean of events(ts, event_type, value) in tumbling windows; later rows are dropped by the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "mean")
