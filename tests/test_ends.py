import pytest

from quillon.operators import features


@pytest.mark.parametrize("at_once, limit", [(1 << 20, 1 << 20), (300, 1 << 20), (300, 200)])
def test_vectors_come_to_the_triples(spark, monkeypatch, at_once, limit):
    monkeypatch.setattr(features, "AT_ONCE", at_once)
    monkeypatch.setattr(features, "BROADCAST", limit)
    f = spark.createDataFrame([(i, [float(i), -i / 3]) for i in range(20)], "entity long, features array<double>")
    t = spark.createDataFrame([(i % 23, (i * 7) % 20, i) for i in range(50)] + [(None, 1, -1)], "head long, tail long, relation int")
    out = features.with_ends(t, f)
    want = sorted((i % 23, (i * 7) % 20, i) for i in range(50) if i % 23 < 20)
    rows = [tuple(r) for r in out.select("head", "tail", "relation", "fh", "ft").collect()]
    assert sorted(r[:3] for r in rows) == want and all(r[3] == [r[0], -r[0] / 3] and r[4] == [r[1], -r[1] / 3] for r in rows)


def test_no_wide_row_is_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = spark.createDataFrame([(i, [float(i)] * 64) for i in range(20)], "entity long, features array<double>")
        t = spark.createDataFrame([(i % 20, 3, i) for i in range(50)], "head long, tail long, relation int")
        plan = features.pairs(t, f, "concat")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 2
        doubled = features.pairs(t, f.union(f), "concat")
        assert doubled.count() == 200  # entities of two vectors give every combination, as a join does
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
