from quillon.functions import ordering


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE", 100, raising=False)
    written, plain = [], ordering.cut
    monkeypatch.setattr(ordering, "cut", lambda df: written.append(plain(df)) or written[-1])
    rows = spark.range(3000).selectExpr("(id * 7919) % 3001 as k", "cast(id as string) as v")
    got = ordering.with_position(rows, ["k"], "at").orderBy("k").collect()
    assert [r["at"] for r in got] == list(range(3000))
    per_file = [r["count"] for r in written[-1].groupBy(ordering.F.shiftright("__place", 33).alias("p")).count().collect()]
    assert len(per_file) > 15 and max(per_file) < 500  # 4 shuffle partitions would hold 750
