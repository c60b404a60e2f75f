"""Scores over classes, ranks of the true class, ranking metrics, conformal sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V


def translation_vectors(triples: DataFrame, features: DataFrame, relations: DataFrame) -> DataFrame:
    """relation, vector: mean of tail - head over the training triples; zeros for a relation without any.

    Sums are taken per relation and entity first, so the vectors are joined once an entity.
    """
    f = features.select("entity", F.posexplode("features").alias("pos", "x"))
    ends = triples.select("relation", F.explode(F.array(F.struct(F.col("tail").alias("entity"), F.lit(1).alias("w")), F.struct(F.col("head").alias("entity"), F.lit(-1).alias("w")))).alias("e")).groupBy("relation", "e.entity").agg(F.sum("e.w").alias("w"))
    sums = ends.join(f, "entity").groupBy("relation", "pos").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    n = triples.groupBy("relation").agg(F.count("*").alias("n"))
    vec = sums.join(F.broadcast(n), "relation").groupBy("relation").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("v")))).alias("a"))
    vec = vec.select("relation", F.transform("a", lambda s: s["v"]).alias("vector"))
    dim = features.agg(F.max(F.size("features")).alias("d"))
    return relations.select("relation").join(vec, "relation", "left").crossJoin(F.broadcast(dim)).select("relation", F.coalesce("vector", F.expr("array_repeat(cast(0 as double), d)")).alias("vector"))


def class_table(vectors: DataFrame) -> DataFrame:
    """One row: classes array, vectors array of arrays in order of class; as large as the class vocabulary."""
    a = vectors.agg(F.array_sort(F.collect_list(F.struct("relation", "vector"))).alias("a"))
    return a.select(F.transform("a", lambda s: s["relation"]).alias("classes"), F.transform("a", lambda s: s["vector"]).alias("class_vectors"))


def metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """n, mrr and hits_k over a column rank; zeros for no rows."""
    hits = [F.coalesce(F.avg((F.col("rank") <= k).cast("double")), F.lit(0.0)).alias(f"hits_{k}") for k in ks]
    return ranked.agg(F.count("*").alias("n"), F.coalesce(F.avg(1 / F.col("rank")), F.lit(0.0)).alias("mrr"), *hits)


def top_k(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best classes of long scores(keys..., relation, score); ties go to the higher class."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("relation"))
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def quantiles(calibration: DataFrame, alphas: list[float]) -> DataFrame:
    """alpha, n, q_hat from a column score (nonconformity).

    With k = ceil((n + 1)(1 - alpha)), the score at 0-based place min(k, n - 1) in ascending
    order. For k > n no finite quantile exists: q_hat is null, and sets hold all classes. No
    calibration rows give no rows. Equal scores are counted, not sorted row by row: places
    are running sums over distinct scores in range partitions.
    """
    from ..functions.ordering import with_position

    spark = calibration.sparkSession
    n = calibration.agg(F.count("*").alias("n")).where("n > 0")
    a = spark.createDataFrame([(x,) for x in alphas], "alpha double")
    want = n.crossJoin(F.broadcast(a)).withColumn("k", F.ceil(F.round((F.col("n") + 1) * (1 - F.col("alpha")), 9)))
    want = want.withColumn("place", F.least("k", F.col("n") - 1))
    placed = with_position(calibration.select("score"), ["score"], "place")
    return want.join(placed, "place", "left").select("alpha", "n", F.when(F.col("k") <= F.col("n"), F.col("score")).alias("q_hat"))


def prediction_set(probabilities: str, q_hat: str) -> Column:
    """Classes whose probability is at least 1 - q_hat; all classes where q_hat is null."""
    classes = F.sequence(F.lit(0), F.size(probabilities) - 1)
    return F.when(F.col(q_hat).isNull(), classes).otherwise(F.filter(classes, lambda i: F.element_at(F.col(probabilities), i + 1) >= 1 - F.col(q_hat)))


def coverage(scored: DataFrame, q: DataFrame) -> DataFrame:
    """alpha, coverage, mean_size of the sets over rows(probs, label); all alphas in one pass."""
    out = scored.crossJoin(F.broadcast(q)).withColumn("set", prediction_set("probs", "q_hat"))
    return out.groupBy("alpha").agg(F.avg(F.array_contains("set", F.col("label")).cast("double")).alias("coverage"), F.avg(F.size("set").cast("double")).alias("mean_size"))


def conformal_by(probabilities, calibration: DataFrame, test: DataFrame, alphas: list[float]) -> DataFrame:
    """alpha, coverage, mean_size of the conformal sets of test(label, ...), with probabilities(frame), a matrix, worked out in Arrow batches.

    Only the true class's score comes back from a calibration row, and only sums from the test rows. No
    rows if either side is empty.
    """
    import numpy as np
    import pandas as pd

    def own(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"score": 1 - probabilities(f)[np.arange(len(f)), f["label"].to_numpy(dtype=int)]})

    known = quantiles(calibration.mapInPandas(own, "score double"), alphas).select("alpha", "q_hat").collect()  # one row an alpha

    def sums(frames):
        for f in frames:
            if len(f):
                p = probabilities(f)
                true = p[np.arange(len(f)), f["label"].to_numpy(dtype=int)]
                for q in known:
                    least = -np.inf if q["q_hat"] is None else 1 - q["q_hat"]
                    yield pd.DataFrame([(q["alpha"], len(f), int((true >= least).sum()), int((p >= least).sum()))], columns=["alpha", "n", "hits", "size"])

    counts = test.mapInPandas(sums, "alpha double, n long, hits long, size long").groupBy("alpha").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "size")])
    return counts.select("alpha", (F.col("hits") / F.col("n")).alias("coverage"), (F.col("size") / F.col("n")).alias("mean_size"))


def accuracy(scored: DataFrame) -> DataFrame:
    return scored.agg(F.coalesce(F.avg((V.argmax("probs") == F.col("label")).cast("double")), F.lit(0.0)).alias("accuracy"))


def translation_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs(fh, ft, ...) with scores: minus the distance of tail - head to each class vector, in order of class; feature columns are dropped.

    Pairs are scored in Arrow batches.
    """
    keep = [c for c in pairs.columns if c not in ("fh", "ft")]
    score = translation_scorer(vectors)

    def run(batches):
        for p in batches:
            if len(p):
                yield p[keep].assign(scores=list(score(p)))

    return pairs.mapInPandas(run, pairs.select(*keep)._jdf.schema().toDDL() + ", scores array<double>")


def translation_top(pairs: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k best classes of each pair(fh, ft, ...) by translation_scores: relation, score and place; ties go to the higher class, feature columns are dropped.

    They are picked in the Arrow batch that scores the pair, so k rows a pair leave it and none is shuffled.
    """
    import numpy as np

    keep = [c for c in pairs.columns if c not in ("fh", "ft")]
    score = translation_scorer(vectors)
    count = vectors.count()  # the class vocabulary

    def run(batches):
        for p in batches:
            if len(p):
                s = score(p)
                best = count - 1 - np.argsort(-np.where(np.isnan(s), np.inf, s)[:, ::-1], axis=1, kind="stable")[:, :k]  # Spark sorts NaN above all numbers
                out = p[keep].loc[p.index.repeat(best.shape[1])].reset_index(drop=True)
                yield out.assign(relation=best.ravel(), score=np.take_along_axis(s, best, axis=1).ravel(), place=np.tile(np.arange(1, best.shape[1] + 1), len(p)))

    return pairs.mapInPandas(run, pairs.select(*keep)._jdf.schema().toDDL() + ", relation int, score double, place int")


def translation_scorer(vectors: DataFrame):
    """A function of a frame (fh, ft, ...): its matrix of scores. The class vectors, one row a relation, go to the tasks."""
    import numpy as np

    rows = vectors.orderBy("relation").collect()  # the class vocabulary
    v = np.array([r["vector"] for r in rows], dtype=float)
    shared = vectors.sparkSession.sparkContext.broadcast((v, (v**2).sum(axis=1)))

    def score(p):
        v, square = shared.value
        m = np.array(p["ft"].tolist(), dtype=float) - np.array(p["fh"].tolist(), dtype=float)
        return -np.sqrt(np.maximum((m**2).sum(axis=1)[:, None] - 2 * m @ v.T + square, 0))

    return score
