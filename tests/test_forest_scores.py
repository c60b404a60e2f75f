"""Rows to score meet the trees where they are."""

import numpy as np

from quillon.operators import classifiers

from .test_columns import shuffled


def test_rows_to_score_are_not_shuffled(spark):
    rng = np.random.default_rng(5)
    features = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(200)], "entity long, features array<double>")
    rows = [(int(h), int(t), int(h + t) % 40, "train" if i < 800 else "test") for i, (h, t) in enumerate(rng.integers(0, 200, (20_000, 2)))]
    triples = spark.createDataFrame(rows, "head long, tail long, label int, split string")
    sent = []
    for part in (triples.where("split = 'train'"), triples):
        before = shuffled(spark)
        got = classifiers.trained(part, features, "concat", lambda n: classifiers.forest(seed=1, trees=20, depth=6), 40).selectExpr("aggregate(probs, 0D, (a, x) -> a + x) as p").collect()
        sent.append(shuffled(spark) - before)
    assert len(got) == 19_200 and all(abs(r["p"] - 1) < 1e-5 for r in got)
    # the pairs themselves are dealt to blocks, in some twenty bytes; twenty trees would send some four hundred bytes a row
    assert sent[1] - sent[0] < 60 * 19_200, sent
