"""Tables in the folder that all executors share: they cut the lineage of iterative queries and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where the session is local and names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(p, True)
    _written.pop(path, None)


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """The frame written as a Parquet table into the shared folder and read back; with by, a folder for each value of that column.

    The table goes when the program ends, or with the `Scratch` that wrote it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillon-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of a loop: `keep` writes one and drops the one of the same name before it; all go at the end of the block."""

    def __init__(self):
        self._paths: dict[str, tuple[SparkSession, str]] = {}

    def keep(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        known = set(_written)
        out = cut(df, by)
        path = next(p for p in reversed(_written) if p not in known)
        if name in self._paths:
            _delete(*self._paths[name])
        self._paths[name] = (df.sparkSession, path)
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for spark, path in self._paths.values():
            _delete(spark, path)
        self._paths.clear()


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:
            return  # the session has ended; the folder is scratch space
