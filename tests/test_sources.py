"""Every reader and writer on files of its own, read back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import ledger, splits
from quillon.sources import triples as S


@pytest.fixture
def split_dir(tmp_path):
    d = tmp_path / "v1_ind_seed7001"
    d.mkdir()
    (d / "train.txt").write_text("a\tr\tb\n b\tr\tc \n\nbroken line\nx\ty\tz\tmore\nc\ts\ta\n")
    (d / "valid.txt").write_text("a\ts\tc\n")
    (d / "test.txt").write_text("b\ts\ta\r\n")
    return d


def test_strict_and_loose_triples(spark, split_dir):
    rows = lambda strict: sorted((r["head"], r["relation"], r["tail"]) for r in S.read_triples(spark, str(split_dir / "train.txt"), strict).collect())
    want = [("a", "r", "b"), ("b", "r", "c"), ("c", "s", "a")]
    assert rows(True) == want and rows(False) == sorted([*want, ("x", "y", "z")])


def test_splits_and_versions(spark, split_dir):
    got = {(r["head"], r["relation"], r["tail"], r["split"]) for r in S.read_splits(spark, str(split_dir)).collect()}
    assert got == {("a", "r", "b", "train"), ("b", "r", "c", "train"), ("c", "s", "a", "train"), ("a", "s", "c", "valid"), ("b", "s", "a", "test")}
    rows = S.read_versions(spark, str(split_dir.parent / "*" / "*.txt")).collect()
    assert len(rows) == 5 and {(r["version"], r["seed"]) for r in rows} == {("v1", 7001)} and {r["split"] for r in rows} == {"train", "valid", "test"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        S.read_splits(spark, str(split_dir) + "x").count()


def test_order_of_a_file(spark, split_dir):
    got = sorted((r["pos"], r["head"]) for r in S.read_ordered(spark, str(split_dir / "train.txt")).collect())
    assert got == [(0, "a"), (1, "b"), (2, "c")]


def test_written_splits_read_back(spark, tmp_path):
    t = spark.createDataFrame([("a", "r", "b", "train", 1, 1), ("c", "r", "b", "train", 0, 1), ("a", "s", "b", "test", 2, 1), ("a", "s", "c", "valid", 3, 2)], "head string, relation string, tail string, split string, pos int, seed int")
    S.write_splits(t, str(tmp_path / "out"), by=["seed"])
    back = S.read_triples(spark, str(tmp_path / "out" / "seed=1" / "split=train" / "*.csv"))
    assert [(r["head"], r["tail"]) for r in back.collect()] == [("c", "b"), ("a", "b")]
    assert S.read_triples(spark, str(tmp_path / "out" / "*" / "*" / "*.csv")).count() == 4


def test_last_label_wins(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("a\told\nb\tB label\textra\n\nonly\na\tnew\n")
    assert {r["entity"]: r["label"] for r in S.read_labels(spark, str(tmp_path / "labels.txt")).collect()} == {"a": "new", "b": "B label"}


def test_features_ledger_and_report(spark, tmp_path):
    f = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "entity string, features array<double>")
    S.write_features(f, str(tmp_path / "f"))
    assert {r["entity"]: r["features"] for r in S.read_features(spark, str(tmp_path / "f")).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}
    (tmp_path / "l.csv").write_text("method,version,mrr\nm,v1,0.5\nn,v1,\n")
    got = {r["method"]: r["mrr"] for r in S.read_ledger(spark, str(tmp_path / "l.csv")).collect()}
    assert got == {"m": 0.5, "n": None}
    S.write_report(f.select("entity"), str(tmp_path / "report"))
    parts = list((tmp_path / "report").glob("*.csv"))
    assert len(parts) == 1 and parts[0].read_text() == "entity\na\nb\n"


def test_upsert_replaces_and_adds(spark, tmp_path):
    schema = "method string, model string, aggregation string, version string, mrr double"
    path = str(tmp_path / "ledger")
    ledger.write_upsert(spark.createDataFrame([("m", "x", "sum", "v1", 0.1), ("n", "x", "sum", "v1", 0.2)], schema), path)
    ledger.write_upsert(spark.createDataFrame([("m", "x", "sum", "v1", 0.9), ("o", "x", "sum", "v1", 0.3)], schema), path)
    assert {r["method"]: r["mrr"] for r in ledger.read_all(spark, path).collect()} == {"m": 0.9, "n": 0.2, "o": 0.3}


def test_tuning_rows_survive_one_by_one(spark, tmp_path):
    for i in range(3):
        ledger.append_result(spark.createDataFrame([(i, i / 10)], "config int, mrr double"), str(tmp_path / "tuning"))
    assert sorted(r["config"] for r in spark.read.parquet(str(tmp_path / "tuning")).collect()) == [0, 1, 2]


def test_cache_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert S.cached(spark, str(tmp_path / "c"), build).count() == 3
    assert len(calls) == 1
    (tmp_path / "c" / "_SUCCESS").unlink()
    S.cached(spark, str(tmp_path / "c"), build)
    assert len(calls) == 2


def test_factors_read_back(spark, tmp_path):
    f = {"w": np.arange(6.0).reshape(2, 3), "c": np.array([[1.5, -2.0]])}
    S.write_factors(spark, f, str(tmp_path / "m"))
    got = S.read_factors(spark, str(tmp_path / "m"))
    assert set(got) == {"w", "c"} and all((got[k] == v).all() for k, v in f.items())


def test_permutation_is_the_legacy_generator(spark):
    got = {r["pos"]: r["new_pos"] for r in splits.permutation(spark, 20, 7001).collect()}
    perm = np.random.RandomState(7001).permutation(20)
    assert all(got[int(p)] == i for i, p in enumerate(perm))
    assert splits.cut(100) == (80, 10, 10) and splits.cut(3) == (1, 1, 1) and splits.cut(101) == (79, 11, 11)


def test_hash_split_against_a_direct_count(spark):
    t = spark.range(2000).select(F.col("id").alias("head"), F.lit(1).alias("relation"), (F.col("id") * 7).alias("tail"))
    rows = splits.hash_split(t, [1, 2]).collect()
    assert len(rows) == 4000 and len({(r["head"], r["seed"]) for r in rows}) == 4000
    for seed in (1, 2):
        of = [r["split"] for r in rows if r["seed"] == seed]
        assert 0.75 < of.count("train") / 2000 < 0.85 and 0.07 < of.count("test") / 2000 < 0.13
    assert {(r["head"], r["split"]) for r in rows if r["seed"] == 1} != {(r["head"], r["split"]) for r in rows if r["seed"] == 2}


def test_labels_outside_the_domain_raise(spark):
    from quillon.operators import vocab

    t = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test"), (None, "test")], "label string, split string")
    got = {r["label"]: r["label_id"] for r in vocab.encoded(t, "label").collect()}
    assert got == {"a": 1, "b": 2, "c": 3, None: None}
    with pytest.raises(Exception, match="outside the domain: c"):
        vocab.encoded(t, "label", t.where("split = 'train'")).collect()
    rows = vocab.one_hot(vocab.encoded(t, "label", ["a", "b", "c"], offset=0), "label_id", 3, offset=0).collect()
    assert {r["label"]: r["one_hot"] for r in rows} == {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1], None: [0, 0, 0]}


def test_clean_up_against_the_sequential_rule(spark):
    import random

    rnd = random.Random(5)
    triples = sorted({(f"e{rnd.randrange(40)}", f"r{rnd.randrange(9)}", f"e{rnd.randrange(40)}") for _ in range(120)})
    got = splits.reshuffled(spark.createDataFrame(triples, "head string, relation string, tail string"), [3, 4]).collect()
    for seed in (3, 4):
        rows = sorted((r for r in got if r["seed"] == seed), key=lambda r: r["pos"])
        assert len(rows) == len(triples) and [r["pos"] for r in rows] == list(range(len(triples)))
        n, v, t = splits.cut(len(triples))
        entities, relations = set(), set()
        for i, r in enumerate(rows):
            new = r["head"] not in entities or r["tail"] not in entities or r["relation"] not in relations
            entities |= {r["head"], r["tail"]}
            relations.add(r["relation"])
            own = "train" if i < n else "valid" if i < n + v else "test"
            assert r["moved"] == (own != "train" and new) and r["split"] == ("train" if own == "train" or new else own)
