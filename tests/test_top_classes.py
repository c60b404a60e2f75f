import numpy as np
from pyspark.sql import functions as F

from quillon import catalog
from quillon.operators import ranking

SF = "/root/testdata/sf0.001"


def test_best_classes_are_picked_where_a_pair_is_scored(spark):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, [float(i // 2), 1.0]) for i in range(6)], "relation int, vector array<double>")  # every distance twice
    rows = [(i, i + 1, rng.integers(0, 3, 2).astype(float).tolist(), rng.integers(0, 3, 2).astype(float).tolist()) for i in range(30)] + [(99, 1, [float("nan"), 0.0], [0.0, 0.0])]
    pairs = spark.createDataFrame(rows, "head long, tail long, fh array<double>, ft array<double>").repartition(3)
    got = ranking.translation_top(pairs, vectors, 3)
    long = ranking.translation_scores(pairs, vectors).select("head", "tail", F.posexplode("scores").alias("relation", "score"))
    want = ranking.top_k(long, ["head", "tail"], 3).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 93
    assert ranking.translation_top(pairs.limit(0), vectors, 3).count() == 0


def test_top_classes_are_not_dealt_by_pair(spark):
    plan = catalog.QUERIES["feature_translation_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
