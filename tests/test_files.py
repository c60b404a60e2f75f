"""Triple files by ranges: every line once, in order, whatever the ranges; writers that fail leave nothing."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import vocab
from quillon.sources import files
from quillon.sources import triples as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    files.register(spark)
    d = tmp_path_factory.mktemp("triples")
    rnd = random.Random(2)
    for name, n in (("train", 300), ("valid", 40), ("test", 0)):
        lines = [rnd.choice([f"h{i}\tr{i % 3}\tté{i}", f"h{i}\tr\tt\textra", "", "two\tfields", f"  a{i}\tr\tb  ", f"x{i}\tr\ty\r"]) for i in range(n)]
        (d / f"{name}.txt").write_bytes("\n".join(lines).encode() + (b"\n" if name == "train" else b""))
    (d / "_hidden.txt").write_text("no\tdata\there\n")
    return d


def expected(path, strict=True):
    out, at = [], 0
    for line in path.read_bytes().split(b"\n"):
        parts = line.decode().strip().split("\t")
        if (len(parts) == 3) if strict else len(parts) >= 3:
            out.append((at, *parts[:3]))
        at += len(line) + 1
    return out


@pytest.mark.parametrize("size", [61, 400, 10**6])
def test_every_line_is_read_once(spark, folder, size):
    for strict in (True, False):
        df = spark.read.format("triples").option("range", size).option("strict", str(strict)).load(str(folder))
        got = {}
        for r in df.collect():
            got.setdefault(r["file"].rpartition("/")[2], []).append((r["offset"], r["head"], r["relation"], r["tail"]))
        assert {k: sorted(v) for k, v in got.items()} == {f"{n}.txt": expected(folder / f"{n}.txt", strict) for n in ("train", "valid")}


def test_globs_and_missing_files(spark, folder):
    assert spark.read.format("triples").load(f"{folder}/tr*.txt").count() == len(expected(folder / "train.txt"))
    with pytest.raises(Exception, match="none.txt"):
        spark.read.format("triples").load(f"{folder}/none.txt").count()


def test_written_rows_come_back_and_failed_ones_do_not(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(f"h{i}", "r", f"t{i}", "train" if i % 3 else "test") for i in range(50)], "head string, relation string, tail string, split string").repartition(4)
    df.write.format("triples").mode("append").save(out)
    rows = lambda path: sorted((r["head"], r["tail"]) for r in spark.read.format("triples").load(path).collect())
    assert rows(out) == sorted((f"h{i}", f"t{i}") for i in range(50)) and len(rows(f"{out}/test/*")) == 17
    broken = df.withColumn("tail", F.when(F.col("head") == "h7", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("tail")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("triples").mode("overwrite").save(out)
    assert rows(out) == sorted((f"h{i}", f"t{i}") for i in range(50)) and not any("_staging" in p for p, _ in files._files(out))
    df.where("split = 'test'").write.format("triples").mode("overwrite").save(out)
    assert len(rows(out)) == 17


def test_lines_are_numbered_over_ranges(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = S.numbered_lines(spark, f"{folder}/*.txt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by = {}
    for r in got:
        by.setdefault(r["file"].rpartition("/")[2], []).append((r["line"], r["value"]))
    for name in ("train.txt", "valid.txt"):
        lines = (folder / name).read_text().replace("\r", "").split("\n")
        assert [x for _, x in sorted(by[name])] == (lines[:-1] if lines[-1] == "" else lines) and [i for i, _ in sorted(by[name])] == list(range(len(by[name])))


def test_skips_are_counted_while_rows_are_read(spark):
    t = spark.createDataFrame([("a", "r", "b"), ("a", "r", "x"), ("y", "s", "b"), ("b", "r", "a"), ("a", "q", "b")], "head string, relation string, tail string")
    known = t.where("relation <> 'q' and head <> 'y' and tail <> 'x'")
    e, r = vocab.dense_index(vocab.entity_set(known), "entity"), vocab.dense_index(known, "relation")
    rows, seen = S.indexed_with_skips(t, e, r)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, vocab.indexed(t, e, r).collect())) == [(0, 1, 0), (1, 0, 0)]
    assert seen.get == {"total": 5, "skipped": 3}
