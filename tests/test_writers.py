"""Writers that are stopped, and writers that must leave others' rows alone."""

import os

import pytest
from pyspark.sql import functions as F

from quillon.functions.versioned import Versioned
from quillon.operators import ledger
from quillon.sources import triples as S

LEDGER = "method string, model string, aggregation string, version string, mrr double"


def rows(spark, path):
    return sorted((r["method"], r["mrr"]) for r in ledger.read_all(spark, path).collect())


def run(spark, *some):
    return spark.createDataFrame([(m, "x", "sum", "v1", v) for m, v in some], LEDGER)


def test_a_writer_that_fails_in_the_middle_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.write_upsert(run(spark, ("a", 0.1), ("b", 0.2)), path)
    broken = run(spark, ("a", 0.9), ("c", 0.3)).repartition(2).withColumn("mrr", F.when(F.col("method") == "c", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("mrr")))
    with pytest.raises(Exception, match="lost"):
        ledger.write_upsert(broken, path)
    assert rows(spark, path) == [("a", 0.1), ("b", 0.2)]
    ledger.write_upsert(run(spark, ("c", 0.3)), path)
    assert rows(spark, path) == [("a", 0.1), ("b", 0.2), ("c", 0.3)]


def test_files_of_a_stopped_writer_are_not_read(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.write_upsert(run(spark, ("a", 0.1)), path)
    ledger.write_upsert(run(spark, ("b", 0.2)), path)
    run(spark, ("z", 9.0)).write.parquet(f"{path}/version-00000003")
    os.remove(f"{path}/version-00000003/_SUCCESS")  # stopped before the end
    assert rows(spark, path) == [("a", 0.1), ("b", 0.2)]
    ledger.write_upsert(run(spark, ("c", 0.3)), path)
    assert rows(spark, path) == [("a", 0.1), ("b", 0.2), ("c", 0.3)]
    assert Versioned(spark, path).versions() == [2, 3]


def test_a_plain_table_becomes_version_0(spark, tmp_path):
    path = str(tmp_path / "ledger")
    run(spark, ("a", 0.1), ("b", 0.2)).write.parquet(path)
    assert rows(spark, path) == [("a", 0.1), ("b", 0.2)]
    ledger.write_upsert(run(spark, ("b", 0.7)), path)
    assert rows(spark, path) == [("a", 0.1), ("b", 0.7)]
    with pytest.raises(FileNotFoundError):
        ledger.read_all(spark, str(tmp_path / "none"))


def test_writing_one_seed_leaves_the_others(spark, tmp_path):
    def seed(n, k):
        return spark.createDataFrame([(f"h{i}", "r", f"t{n}", "train" if i else "valid", n, i) for i in range(k)], "head string, relation string, tail string, split string, seed int, pos long")

    out = str(tmp_path / "splits")
    S.write_splits(seed(7001, 4), out, by=["seed"])
    S.write_splits(seed(7002, 3), out, by=["seed"])
    S.write_splits(seed(7001, 2), out, by=["seed"])
    got = spark.read.option("sep", "\t").csv(out).groupBy("seed", "split").count().collect()
    assert sorted((r["seed"], r["split"], r["count"]) for r in got) == [(7001, "train", 1), (7001, "valid", 1), (7002, "train", 2), (7002, "valid", 1)]


def test_cached_tables_of_one_path_are_told_apart(spark, tmp_path):
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    for n in (2, 3, 2):
        assert S.cached(spark, str(tmp_path / "cache"), lambda n=n: build(n), model="m", n=n).count() == n
    assert built == [2, 3]
