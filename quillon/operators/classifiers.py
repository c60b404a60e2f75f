"""Classifiers on pair features with MLlib, and their metrics in the full class space."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.vectors import rank_of
from . import boosting, cpd
from . import forest as forests
from .coded import Blocks, chunks, coded, opened
from .features import pairs, with_ends
from .optim import lbfgs
from .ranking import metrics, translation_scores, translation_vectors


def prepared(triples: DataFrame, features: DataFrame, how: str) -> DataFrame:
    """label, split, features: a dense vector of the pair (concat or subtract)."""
    return pairs(triples, features, how).select("label", "split", array_to_vector(F.col("x").cast("array<double>")).alias("features"))


def logistic(n: int, c: float = 0.1, iterations: int = 100) -> LogisticRegression:
    """Multinomial, L2 penalty 1 / (c n) on the unscaled features, free intercept."""
    return LogisticRegression(family="multinomial", regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=iterations)


def forest(seed: int = 0, trees: int = 20, depth: int = 15) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="sqrt", bootstrap=True, seed=seed)


#: A pair's vector of both vectors.
JOINED = {"concat": lambda x, y: np.hstack([x, y]), "subtract": np.subtract}


def fit_forest(data: Blocks, estimator: RandomForestClassifier, classes: int) -> DataFrame:
    """label, split, probs of validation and test rows by the forest that the estimator describes, over coded blocks."""
    get = estimator.getOrDefault
    s = forests.Settings(get("numTrees"), get("maxDepth"), get("minInstancesPerNode"), get("maxBins"), get("seed"))
    found = forests.fit(data, JOINED[data.how], classes, s) if data.d else None
    return found if found is not None else data.frame.sparkSession.createDataFrame([], "label int, split string, probs array<double>")


def fit_logistic(data: Blocks, estimator: LogisticRegression, classes: int) -> DataFrame:
    """label, split, probs of validation and test rows by the multinomial regression that the estimator describes.

    Its objective (mean log loss, L2 penalty on the coefficients and not on the intercepts) is minimised over coded
    blocks: an evaluation is one pass that gives loss and gradient, and no vector of a pair is kept. Classes without
    training rows get 0, no rows come without training rows.
    """
    train = data.of("train")
    seen = cpd.block_sum(train, lambda x, y, r: np.bincount(r, minlength=classes), size=classes)
    spark = data.frame.sparkSession
    if not len(seen) or not data.d:
        return spark.createDataFrame([], "label int, split string, probs array<double>")
    here, n = np.flatnonzero(seen), seen.sum()
    dense = np.searchsorted(here, np.arange(classes))
    width = data.d * (2 if data.how == "concat" else 1)
    penalty = estimator.getRegParam()
    joined = JOINED[data.how]

    def answer(w):
        c, b = w[:-len(here)].reshape(width, len(here)), w[-len(here) :]

        def kernel(x, y, r):
            v = joined(x, y)
            z = v @ c + b
            z -= z.max(axis=1, keepdims=True)
            own, at = dense[r], np.arange(len(r))
            of = z[at, own]
            q = np.exp(z, out=z)
            t = q.sum(axis=1)
            q /= t[:, None]
            q[at, own] -= 1
            return np.concatenate([(v.T @ q).ravel(), q.sum(axis=0), [(np.log(t) - of).sum()]])

        got = cpd.block_sum(train, kernel, size=len(w) + 1) / n
        got[: c.size] += penalty * w[: c.size]
        return float(got[-1] + penalty / 2 * (c**2).sum()), got[:-1]

    prior = np.log(seen[here] / n)
    train.persist()
    try:
        w, _ = lbfgs(answer, np.concatenate([np.zeros(width * len(here)), prior - prior.mean()]), estimator.getMaxIter(), estimator.getTol())
    finally:
        train.unpersist()
    frame, read = opened(data)

    def scored(frames):
        c, b = w[:-len(here)].reshape(width, len(here)), w[-len(here) :]
        for f in frames:
            for row in f.itertuples():
                for on in chunks(row.n):
                    z = joined(*read(row, on)) @ c + b
                    e = np.exp(z - z.max(axis=1, keepdims=True))
                    probs = np.zeros((len(z), classes))
                    probs[:, here] = e / e.sum(axis=1, keepdims=True)
                    yield pd.DataFrame({"label": np.frombuffer(row.r, dtype=np.int64)[on].astype(np.int32), "split": row.split, "probs": list(probs)})

    return frame.where("split <> 'train'").mapInPandas(scored, "label int, split string, probs array<double>")


def fit_scores(data: DataFrame | Blocks, estimator, classes: int) -> DataFrame:
    """label, split, probs over 0..classes-1: trained on the dense index of the classes seen in training, absent ones get 0.

    Coded blocks are for a logistic regression or a forest.
    """
    if isinstance(data, Blocks):
        return (fit_logistic if isinstance(estimator, LogisticRegression) else fit_forest)(data, estimator, classes)
    train = data.where("split = 'train'")
    seen = [r["label"] for r in train.select("label").distinct().orderBy("label").collect()]  # the class vocabulary
    to_dense = F.create_map(*[F.lit(x) for i, c in enumerate(seen) for x in (c, float(i))])
    model = estimator.fit(train.withColumn("label", F.element_at(to_dense, F.col("label"))))
    out = model.transform(data)
    raw = "probability" if "probability" in out.columns else "rawPrediction"
    at = F.array(*[F.lit(seen.index(c) + 1 if c in seen else 0) for c in range(classes)])
    probs = vector_to_array(raw)
    if raw == "rawPrediction":
        probs = F.transform(probs, lambda x: 1 / (1 + F.exp(-x)))
    return out.withColumn("__p", probs).withColumn("probs", F.transform(at, lambda i: F.when(i > 0, F.get("__p", i - 1)).otherwise(0.0))).select("label", "split", "probs")


def trained(triples: DataFrame, features: DataFrame, how: str, make, classes: int) -> DataFrame:
    """label, split, probs by an MLlib estimator, made for the number of training rows; a logistic regression and a forest are trained on coded blocks and score validation and test rows."""
    if isinstance(make(1), LogisticRegression | RandomForestClassifier):
        blocks = replace(coded(triples, features), how=how)
        n = blocks.of("train").frame.agg(F.sum("n")).first()[0] or 0
        return fit_scores(blocks, make(n), classes)
    data = prepared(triples, features, how).persist()
    try:
        return cut(fit_scores(data, make(data.where("split = 'train'").count()), classes))
    finally:
        data.unpersist()


def boosted(triples: DataFrame, features: DataFrame, how: str, settings: boosting.Settings, classes: int) -> DataFrame:
    """label, split, probs of validation and test rows by boosted trees; no rows without training rows."""
    spark = triples.sparkSession
    data = cut(pairs(triples, features, how).select("x", F.col("label").cast("int").alias("label"), "split"))
    found = boosting.fit(data, classes, settings)[1]
    return found if found is not None else spark.createDataFrame([], "label int, split string, probs array<double>")


#: name -> scorer of (triples(head, tail, label, split), features, classes): label, split, probs.
METHODS = {
    "lr_concat": lambda t, f, n: trained(t, f, "concat", logistic, n),
    "lr_subtract": lambda t, f, n: trained(t, f, "subtract", logistic, n),
    "rf_concat": lambda t, f, n: trained(t, f, "concat", lambda _: forest(), n),
    "rf_subtract": lambda t, f, n: trained(t, f, "subtract", lambda _: forest(), n),
    "gbt_concat": lambda t, f, n: boosted(t, f, "concat", boosting.Settings(), n),
    "gbt_subtract": lambda t, f, n: boosted(t, f, "subtract", boosting.Settings(), n),
}


def baselines(triples: DataFrame, features: DataFrame, classes: int, methods: dict | None = None) -> DataFrame:
    """method, n, mrr, hits_1, hits_3, hits_10 on the test split of triples(head, tail, relation, split): feature translation, then every method.

    methods (name -> scorer) are METHODS unless given.
    """
    ranked = lambda df, label, scores: metrics(df.select(rank_of(F.col(scores), F.col(label)).alias("rank")))
    spark = triples.sparkSession
    relations = spark.range(classes).select(F.col("id").cast("int").alias("relation"))
    vectors = translation_vectors(triples.where("split = 'train'"), features, relations)
    ends = with_ends(triples.where("split = 'test'").select("head", "tail", "relation"), features)
    out = ranked(translation_scores(ends, vectors), "relation", "scores").withColumn("method", F.lit("feature_translation"))
    for name, score in (methods or METHODS).items():
        scored = score(triples.withColumn("label", F.col("relation")), features, classes).where("split = 'test'")
        out = out.unionByName(cut(ranked(scored, "label", "probs")).withColumn("method", F.lit(name)))
    return out
