"""The registered queries of the library and the DuckDB SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .functions.lineage import cut
from .functions.ordering import with_position
from .operators import balls, boosting, classifiers, coded, cpd, features, kge, ledger, projector, ranking, splits, subgraph, vocab
from .plans import graph
from .plans.graph import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CLASSES = 100


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


# ---- vocabularies and triples


@query(sql("SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS idx FROM (SELECT src AS entity FROM kg_edges UNION SELECT dst FROM kg_edges)", "kg_edges"))
def kg_vocab_entities(spark, d):
    return vocab.dense_index(vocab.entity_set(graph.edges(spark, d).toDF("head", "relation", "tail")), "entity")


@query(sql("SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS idx FROM (SELECT DISTINCT relation FROM kg_edges)", "kg_edges"))
def kg_vocab_relations(spark, d):
    return vocab.dense_index(graph.edges(spark, d), "relation")


@query(
    sql(
        """, e AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS idx FROM (SELECT src AS entity FROM kg_edges UNION SELECT dst FROM kg_edges)),
        r AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS idx FROM (SELECT DISTINCT relation FROM kg_edges))
        SELECT r.idx AS r, count(*) AS n, CAST(sum(h.idx) AS BIGINT) AS sum_h, CAST(sum(t.idx) AS BIGINT) AS sum_t
        FROM kg_edges k JOIN e h ON h.entity = k.src JOIN e t ON t.entity = k.dst JOIN r ON r.relation = k.relation GROUP BY 1""",
        "kg_edges",
    )
)
def kg_triples_indexed(spark, d):
    t = cut(graph.edges(spark, d).toDF("head", "relation", "tail"))
    out = vocab.indexed(t, vocab.dense_index(vocab.entity_set(t), "entity"), vocab.dense_index(t, "relation"))
    return out.groupBy("r").agg(F.count("*").alias("n"), F.sum("h").alias("sum_h"), F.sum("t").alias("sum_t"))


_ORDERED = "kg_ordered AS (SELECT row_number() OVER (ORDER BY src, relation, dst) - 1 AS pos, src AS head, relation, dst AS tail FROM kg_edges)"


def _ordered(spark, d):
    return with_position(graph.edges(spark, d), ["src", "relation", "dst"], "pos").toDF("head", "relation", "tail", "pos")


@query(
    sql(
        f""", {_ORDERED}, s AS (SELECT entity, min(o) AS o FROM (SELECT head AS entity, 2 * pos AS o FROM kg_ordered UNION ALL SELECT tail, 2 * pos + 1 FROM kg_ordered) GROUP BY 1)
        SELECT entity, row_number() OVER (ORDER BY o) - 1 AS idx FROM s""",
        "kg_edges",
    )
)
def kg_first_seen_index(spark, d):
    return vocab.first_seen_index(_ordered(spark, d))


@query(
    sql(
        """, e AS (SELECT head AS entity FROM kg_triples WHERE split = 'train' UNION SELECT tail FROM kg_triples WHERE split = 'train')
        SELECT split, count(*) AS total, count(*) FILTER (head NOT IN (FROM e) OR tail NOT IN (FROM e)) AS skipped FROM kg_triples GROUP BY 1""",
        "kg_triples",
    )
)
def kg_unknown_endpoint_skips(spark, d):
    t = graph.triples(spark, d)
    known = vocab.entity_set(t.where("split = 'train'"))
    lost = vocab.unknown(t, known).groupBy("split").agg(F.count("*").alias("skipped"))
    return t.groupBy("split").agg(F.count("*").alias("total")).join(lost, "split", "left").select("split", "total", F.coalesce("skipped", F.lit(0)).alias("skipped"))


@query(sql("SELECT count(*) / (n * CAST(n AS DOUBLE)) AS density FROM kg_triples, (SELECT count(*) AS n FROM kg_entities) GROUP BY n", "kg_triples", "kg_entities"))
def matrix_density(spark, d):
    return vocab.density(graph.triples(spark, d), graph.entities(spark, d).count())


_NAMES = "nm AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT 'r' || r AS name FROM range(100) a(r)))"


def _named(spark, d):
    return graph.triples(spark, d).withColumn("name", F.concat(F.lit("r"), F.col("relation").cast("string")))


@query(sql(f", {_NAMES} SELECT name, id AS name_id, count(*) AS n FROM kg_triples JOIN nm ON name = 'r' || relation GROUP BY ALL", "kg_triples"))
def label_encode_domain(spark, d):
    """Ids from an explicit domain; a label outside it would raise."""
    return vocab.encoded(_named(spark, d), "name", [f"r{r}" for r in range(CLASSES)]).groupBy("name", "name_id").agg(F.count("*").alias("n"))


@query(sql(f", {_NAMES} SELECT split, id AS place, count(*) AS n, CAST(1 AS BIGINT) AS ones FROM kg_triples JOIN nm ON name = 'r' || relation GROUP BY ALL", "kg_triples"))
def label_one_hot(spark, d):
    rows = vocab.one_hot(vocab.encoded(_named(spark, d), "name", [f"r{r}" for r in range(CLASSES)]), "name_id", CLASSES)
    return rows.groupBy("split", F.array_position("one_hot", 1).alias("place")).agg(F.count("*").alias("n"), F.max(F.aggregate("one_hot", F.lit(0), lambda a, x: a + x).cast("long")).alias("ones"))


# ---- splits


@query(sql("SELECT split, count(*) AS n FROM kg_triples GROUP BY 1", "kg_triples"))
def split_sizes(spark, d):
    return graph.triples(spark, d).groupBy("split").agg(F.count("*").alias("n"))


@query(
    sql(
        f""", {_ORDERED}, t AS (SELECT *, CASE pos % 10 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM kg_ordered),
        o AS (SELECT *, (CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END) * 1000000000 + pos AS ord FROM t),
        f AS (SELECT kind, elem, min(ord) AS ord FROM (SELECT 'e' AS kind, head AS elem, ord FROM o UNION ALL SELECT 'e', tail, ord FROM o UNION ALL SELECT 'r', relation, ord FROM o) GROUP BY ALL),
        m AS (SELECT o.*, split <> 'train' AND ord IN (SELECT ord FROM f) AS moved FROM o)
        SELECT split, CASE WHEN moved THEN 'train' ELSE split END AS new_split, count(*) AS n FROM m GROUP BY ALL""",
        "kg_edges",
    )
)
def split_clean_moved(spark, d):
    pos = F.col("pos") % 10
    t = _ordered(spark, d).withColumn("split", F.when(pos == 0, "valid").when(pos == 1, "test").otherwise("train"))
    return splits.cleaned(t).groupBy("split", "new_split").agg(F.count("*").alias("n"))


_VERSIONED = "SELECT *, 'v' || (relation % 3) AS version, relation // 10 AS seed FROM kg_triples"


def _versioned(spark, d):
    return graph.triples(spark, d).withColumn("version", F.concat(F.lit("v"), (F.col("relation") % 3).cast("string"))).withColumn("seed", F.floor(F.col("relation") / 10).cast("int"))


_STATS = f""", t AS ({_VERSIONED}), e AS (SELECT version, seed, split, count(DISTINCT x) AS entities FROM (SELECT version, seed, split, head AS x FROM t UNION ALL SELECT version, seed, split, tail FROM t) GROUP BY ALL),
    s AS (SELECT version, seed, split, count(DISTINCT relation) AS relations, count(*) AS triples FROM t GROUP BY ALL), st AS (SELECT * FROM s JOIN e USING (version, seed, split)),
    ok AS (SELECT version, seed FROM st GROUP BY ALL HAVING count(DISTINCT split) = 3), full_st AS (SELECT st.* FROM st JOIN ok USING (version, seed))"""


@query(sql(f"{_STATS} SELECT version, CAST(seed AS INT) AS seed, split, relations, triples, entities FROM full_st", "kg_triples"))
def split_statistics(spark, d):
    return splits.complete(splits.statistics(_versioned(spark, d), ["version", "seed", "split"]), ["version", "seed"])


@query(
    sql(
        f"""{_STATS} SELECT version, split, count(DISTINCT seed) AS seeds, printf('%.0f', avg(triples)) || ' +/- ' || coalesce(printf('%.0f', stddev_samp(triples)), 'nan') AS triples,
        round(avg(entities), 6) AS entities_mean, round(stddev_samp(entities), 6) AS entities_std FROM full_st GROUP BY ALL""",
        "kg_triples",
    )
)
def split_statistics_summary(spark, d):
    st = splits.complete(splits.statistics(_versioned(spark, d), ["version", "seed", "split"]), ["version", "seed"])
    g = st.groupBy("version", "split").agg(F.count_distinct("seed").alias("seeds"), *splits.mean_std("triples"), *splits.mean_std("entities"))
    return g.select("version", "split", "seeds", splits.formatted("triples_mean", "triples_std").alias("triples"), F.round("entities_mean", 6).alias("entities_mean"), F.round("entities_std", 6).alias("entities_std"))


@query(
    sql(
        """, s AS (SELECT seed, head, relation, tail, row_number() OVER (PARTITION BY seed ORDER BY md5(concat_ws(':', seed, head, relation, tail))) - 1 AS pos, count(*) OVER (PARTITION BY seed) AS n
                   FROM kg_triples, (SELECT unnest([7001, 7002, 7003]) AS seed)),
        c AS (SELECT *, greatest(1, CAST(ceil(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS v FROM s),
        o AS (SELECT *, CASE WHEN pos < n - 2 * v THEN 'train' WHEN pos < n - v THEN 'valid' ELSE 'test' END AS split FROM c),
        f AS (SELECT seed, kind, elem, min(pos) AS pos FROM (SELECT seed, 'e' AS kind, head AS elem, pos FROM o UNION ALL SELECT seed, 'e', tail, pos FROM o UNION ALL SELECT seed, 'r', relation, pos FROM o) GROUP BY ALL),
        m AS (SELECT o.*, split <> 'train' AND (seed, pos) IN (SELECT (seed, pos) FROM f) AS moved FROM o)
        SELECT CAST(seed AS INT) AS seed, CASE WHEN moved THEN 'train' ELSE split END AS split, moved, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM m GROUP BY ALL""",
        "kg_triples",
    )
)
def split_reshuffle_seeds(spark, d):
    """Shuffle, cut by exact sizes and clean-up for three seeds in one job."""
    return splits.reshuffled(graph.triples(spark, d), [7001, 7002, 7003]).groupBy("seed", "split", "moved").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"))


@query(
    sql(
        """, s AS (SELECT seed, CAST('0x' || md5(concat_ws(':', seed, head, relation, tail))[1:8] AS BIGINT) % 10 AS u FROM kg_triples, (SELECT unnest([7001, 7002, 7003]) AS seed))
        SELECT CAST(seed AS INT) AS seed, CASE u WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM s GROUP BY ALL""",
        "kg_triples",
    )
)
def split_hash_seeds(spark, d):
    """80/10/10 sizes for three seeds in one job."""
    return splits.hash_split(graph.triples(spark, d).drop("split"), [7001, 7002, 7003]).groupBy("seed", "split").agg(F.count("*").alias("n"))


# ---- features

_SCALED = """, x AS (SELECT entity, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS pos FROM kg_entities),
    sc AS (SELECT pos, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS std FROM x GROUP BY 1),
    scaled AS (SELECT entity, list((x - mean) / std ORDER BY pos) AS f FROM x JOIN sc USING (pos) GROUP BY 1)"""


@query(sql(f"{_SCALED} SELECT CAST(pos AS INT) AS pos, round(mean, 9) AS mean, round(std, 9) AS std FROM sc", "kg_entities"))
def feature_scaler_stats(spark, d):
    return features.scaler(graph.entities(spark, d)).select("pos", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


def _norm(x: str) -> str:
    return f"sqrt(list_inner_product({x}, {x}))"


@query(sql(f"{_SCALED} SELECT entity, round({_norm('f')}, 6) AS norm FROM scaled", "kg_entities"))
def feature_standardized_norms(spark, d):
    return features.standardised(graph.entities(spark, d)).select("entity", F.round(V.norm("features"), 6).alias("norm"))


@query(sql(f"{_SCALED} SELECT entity, CAST(len(f) + 8 AS INT) AS width, round(sqrt(list_inner_product(f, f) + 8), 6) AS norm FROM scaled", "kg_entities"))
def feature_bias_columns(spark, d):
    return features.standardised(graph.entities(spark, d), bias=8).select("entity", F.size("features").alias("width"), F.round(V.norm("features"), 6).alias("norm"))


@query(
    sql(
        """SELECT vec_id AS entity, coalesce(len(features), 64) AS width, features IS NULL AS filled, round(coalesce(list_sum(features), 0), 6) AS total
        FROM embeddings LEFT JOIN (SELECT * FROM kg_entities WHERE label < 5) e ON e.entity = vec_id""",
        "kg_entities",
    )
)
def feature_imputation(spark, d):
    e = graph.entities(spark, d)
    have = e.where("label < 5")
    out = features.with_features(e.select("entity"), have, 64).join(have.select("entity", F.lit(False).alias("f")), "entity", "left")
    return out.select("entity", F.size("features").cast("long").alias("width"), F.coalesce("f", F.lit(True)).alias("filled"), F.round(V.total("features"), 6).alias("total"))


def _pair_query(how: str, expression: str):
    @query(sql(f"SELECT relation, count(*) AS n, round(avg({_norm(expression)}), 6) AS mean_norm FROM kg_triples JOIN kg_entities h ON h.entity = head JOIN kg_entities t ON t.entity = tail GROUP BY 1", "kg_triples", "kg_entities"))
    def run(spark, d):
        x = features.pairs(graph.triples(spark, d), graph.entities(spark, d), how)
        return x.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg(V.norm("x")), 6).alias("mean_norm"))

    name = f"pair_{how}_norms"
    QUERIES[name] = QUERIES.pop("run")
    ORACLE_SQL[name] = ORACLE_SQL.pop("run")


_pair_query("concat", "list_concat(h.features, t.features)")
_pair_query("subtract", "list_transform(list_zip(h.features, t.features), lambda p: p[1] - p[2])")
_pair_query("hadamard", "list_transform(list_zip(h.features, t.features), lambda p: p[1] * p[2])")

# The prompt patterns.
TEMPLATES = ["[1] is a type of [2].", "[1] is located in [2].", "[1] is member of [2].", "[1] is equivalent to [2].", "[1] is different from [2].", "[1] is similar to [2]."]
_TEMPLATES = "SELECT unnest(range(6)) AS template, unnest([" + ", ".join(f"'{t}'" for t in TEMPLATES) + "]) AS p"


_NAMED = {"r": "region", "n": "nation", "c": "customer", "s": "supplier", "p": "part"}
_NAMED_KEYS = {"r": "r_regionkey", "n": "n_nationkey", "c": "c_custkey", "s": "s_suppkey", "p": "p_partkey"}
_LABELLED = " UNION ALL ".join(f"SELECT '{k}' || {_NAMED_KEYS[k]} AS entity, {k}_name AS name FROM {t}" for k, t in _NAMED.items())


@query(f"WITH t AS ({_TEMPLATES}), e AS ({_LABELLED}) SELECT entity, CAST(template AS INT) AS template, replace(replace(p, '[1]', name), '[2]', '<mask>') AS masked, trim(split_part(replace(p, '[1]', name), '[2]', 1)) || ':' AS causal FROM e, t")
def prompt_texts(spark, d):
    parts = [graph.table(spark, d, t).select(F.concat(F.lit(k), F.col(_NAMED_KEYS[k]).cast("string")).alias("entity"), F.col(f"{k}_name").alias("label")) for k, t in _NAMED.items()]
    e = parts[0]
    for x in parts[1:]:
        e = e.unionByName(x)
    masked, causal = features.prompts(e, TEMPLATES, True), features.prompts(e, TEMPLATES, False)
    return masked.withColumnRenamed("text", "masked").join(causal.withColumnRenamed("text", "causal"), ["entity", "template"])


_STATES = "s AS (SELECT entity, features[1:16] AS a, features[17:32] AS b, features[33:48] AS c, features[49:64] AS d FROM kg_entities)"
_POOLS = {
    "sum": "list_transform(range(1, 17), lambda i: a[i] + b[i] + c[i] + d[i])",
    "mean": "list_transform(range(1, 17), lambda i: (a[i] + b[i] + c[i] + d[i]) / 4)",
    "concat": "list_concat(list_concat(a, b), list_concat(c, d))",
    "attn": "list_transform(range(1, 17), lambda i: a[i] + (wb * b[i] + wc * c[i] + wd * d[i]) / (wb + wc + wd))",
}


def _pool_query(how: str):
    name = f"prompt_pool_{how}"

    def run(spark, d):
        states = F.array(*[F.slice("features", 16 * i + 1, 16) for i in range(4)])
        out = features.pooled(graph.entities(spark, d).select("entity", states.alias("states")), how)
        return out.select("entity", F.size("pooled").cast("long").alias("width"), F.round(V.total("pooled"), 6).alias("total"), F.round(V.norm("pooled"), 6).alias("norm"))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql(f", {_STATES}, w AS (SELECT *, exp(list_inner_product(a, b)) AS wb, exp(list_inner_product(a, c)) AS wc, exp(list_inner_product(a, d)) AS wd FROM s), p AS (SELECT entity, {_POOLS[how]} AS p FROM w) SELECT entity, len(p) AS width, round(list_sum(p), 6) AS total, round({_norm('p')}, 6) AS norm FROM p", "kg_entities")


for _how in _POOLS:
    _pool_query(_how)



@query()
def feature_random_fill(spark, d):
    """Entities without a vector get draws of N(0, 0.1) that depend on entity and seed only."""
    e = graph.entities(spark, d)
    out = features.with_features(e.select("entity"), e.where("label < 5"), 64, fill="random", seed=28)
    return out.select("entity", F.size("features").cast("long").alias("width"), F.round(V.norm("features"), 6).alias("norm"))


_ENCODED = """x AS (SELECT entity, t, i, features[16 * t + i + 1] AS v FROM kg_entities, range(4) a(t), range(16) b(i)),
    nx AS (SELECT entity, t, i, (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5) AS v FROM x WINDOW w AS (PARTITION BY entity, t)),
    en AS (SELECT entity, t, o, cos(t + o) / 4 + sum(v * sin(3 * t + 5 * i + 7 * o) / 4) AS v FROM nx, range(8) c(o) GROUP BY entity, t, o)"""


def _states(spark, d):
    return graph.entities(spark, d).select("entity", F.array(*[F.slice("features", 16 * i + 1, 16) for i in range(4)]).alias("states"))


@query(sql(f", {_ENCODED} SELECT entity, CAST(t AS INT) AS template, round(sum(v), 5) AS total, round(sqrt(sum(v * v)), 5) AS norm FROM en GROUP BY ALL", "kg_entities"))
def prompt_encodings(spark, d):
    out = features.prompt_encoded(_states(spark, d), features.closed_form_pool(16, 4, 8, 4, "sum"))
    return out.select("entity", F.posexplode("encoded").alias("template", "v")).select("entity", "template", F.round(V.total("v"), 5).alias("total"), F.round(V.norm("v"), 5).alias("norm"))


_APPLIED = {
    "sum": "po AS (SELECT entity, o AS j, sum(v) AS v FROM en GROUP BY ALL)",
    "mean": "po AS (SELECT entity, o AS j, avg(v) AS v FROM en GROUP BY ALL)",
    "concat": "po AS (SELECT entity, 8 * t + o AS j, v FROM en)",
    "attn": "q AS (SELECT * FROM en WHERE t = 0), sc AS (SELECT e.entity, e.t, exp(sum(q.v * e.v)) AS w FROM en e JOIN q USING (entity, o) WHERE e.t > 0 GROUP BY ALL), po AS (SELECT entity, o AS j, any_value(q.v) + sum(w * e.v) / sum(w) AS v FROM en e JOIN sc USING (entity, t) JOIN q USING (entity, o) GROUP BY ALL)",
}


def _applied_query(how: str):
    name = f"prompt_pool_applied_{how}"

    def run(spark, d):
        out = features.pool_applied(_states(spark, d), features.closed_form_pool(16, 4, 8, 4, how), how)
        return out.select("entity", F.posexplode("features").alias("k", "v")).groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql(f", {_ENCODED}, {_APPLIED[how]}, ou AS (SELECT entity, k, 1 / (1 + exp(-(sin(k) + sum(greatest(v, 0) * cos(2 * j + 3 * k) / 2)))) AS v FROM po, range(4) d(k) GROUP BY entity, k) SELECT CAST(k AS INT) AS k, count(*) AS n, round(avg(v), 6) AS mean FROM ou GROUP BY ALL", "kg_entities")


for _how in _APPLIED:
    _applied_query(_how)


@query(
    sql(
        f"""{_SCALED}, x0 AS (SELECT entity, generate_subscripts(f, 1) - 1 AS i, unnest(f) AS v FROM scaled),
        hi AS (SELECT entity, j, greatest(cos(j) / 4 + sum(v * sin(3 * i + 5 * j) / 8), 0) AS v FROM x0, range(16) a(j) GROUP BY entity, j),
        ou AS (SELECT entity, k, sin(k) / 4 + sum(v * cos(2 * j + 7 * k) / 4) AS v FROM hi, range(8) b(k) GROUP BY entity, k) SELECT entity, round(sum(v), 5) AS total, round(sqrt(sum(v * v)), 5) AS norm FROM ou GROUP BY 1""",
        "kg_entities",
    )
)
def mlp_projection(spark, d):
    out = projector.projected(features.standardised(graph.entities(spark, d)), projector.closed_form(64, 16, 8))
    return out.select("entity", F.round(V.total("features"), 5).alias("total"), F.round(V.norm("features"), 5).alias("norm"))


# ---- ranking and conformal sets


def _ended(spark, d, split):
    """The pairs of a split with their scaled features, class vectors of the training split."""
    t = graph.triples(spark, d)
    f = features.standardised(graph.entities(spark, d)).persist()
    vectors = ranking.translation_vectors(t.where("split = 'train'"), f, spark.range(CLASSES).select(F.col("id").cast("int").alias("relation")))
    return features.with_ends(t.where(F.col("split").isin(split)), f), vectors


def _scored(spark, d, split):
    """Scores of the pairs of a split, class vectors of the training split."""
    ends, vectors = _ended(spark, d, split)
    return ranking.translation_scores(ends, vectors), vectors


_VECTORS = (
    _SCALED
    + """, mv AS (SELECT k.*, h.f AS fh, t.f AS ft FROM kg_triples k JOIN scaled h ON h.entity = head JOIN scaled t ON t.entity = tail),
    dx AS (SELECT relation, split, head, tail, unnest(ft) - unnest(fh) AS x, generate_subscripts(ft, 1) AS pos FROM mv),
    av AS (SELECT relation, pos, avg(x) AS x FROM dx WHERE split = 'train' GROUP BY ALL),
    vec AS (SELECT CAST(r AS INT) AS relation, coalesce(v, list_transform(range(64), lambda i: CAST(0 AS DOUBLE))) AS v FROM range(100) g(r) LEFT JOIN (SELECT relation, list(x ORDER BY pos) AS v FROM av GROUP BY 1) a ON a.relation = r)"""
)
_SCORES = _VECTORS + ", mm AS (SELECT head, tail, relation, split, list(x ORDER BY pos) AS m FROM dx WHERE split <> 'train' GROUP BY ALL), lg AS (SELECT head, tail, mm.relation AS truth, split, vec.relation AS r, -list_distance(m, v) AS s FROM mm, vec)"
_RANKS = _SCORES + ", rk AS (SELECT head, tail, truth, split, (SELECT 1) AS one, count(*) FILTER (s >= st) AS rank FROM (SELECT *, max(s) FILTER (r = truth) OVER (PARTITION BY head, tail, truth) AS st FROM lg) GROUP BY ALL)"
_METRICS = "count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hits_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0 END), 6) AS hits_3, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hits_10"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(sql(f"{_VECTORS} SELECT relation, round({_norm('v')}, 6) AS norm FROM vec", "kg_entities", "kg_triples"))
def translation_vectors(spark, d):
    return _scored(spark, d, ["train"])[1].select("relation", F.round(V.norm("vector"), 6).alias("norm"))


@query(sql(f"{_RANKS} SELECT {_METRICS} FROM rk WHERE split = 'test'", "kg_entities", "kg_triples"))
def feature_translation_metrics(spark, d):
    scored, _ = _scored(spark, d, ["test"])
    return _rounded(ranking.metrics(scored.select(V.rank_of(F.col("scores"), F.col("relation")).alias("rank"))))


@query(sql(f"{_SCORES}, o AS (SELECT *, row_number() OVER (PARTITION BY head, tail, truth ORDER BY s DESC, r DESC) AS place FROM lg WHERE split = 'test') SELECT head, tail, r AS relation, round(s, 6) AS score, CAST(place AS INT) AS place FROM o WHERE place <= 3", "kg_entities", "kg_triples"))
def feature_translation_topk(spark, d):
    ends, vectors = _ended(spark, d, ["test"])
    top = ranking.translation_top(ends.select("head", "tail", "fh", "ft"), vectors, 3)
    return top.select("head", "tail", "relation", F.round("score", 6).alias("score"), "place")


@query(sql(f"{_SCORES}, a AS (SELECT split, truth, arg_max(r, s) AS p FROM lg GROUP BY split, head, tail, truth) SELECT split, round(avg(CASE WHEN p = truth THEN 1.0 ELSE 0 END), 6) AS accuracy FROM a GROUP BY 1", "kg_entities", "kg_triples"))
def accuracy_argmax(spark, d):
    scored, _ = _scored(spark, d, ["valid", "test"])
    return scored.groupBy("split").agg(F.round(F.avg((V.argmax("scores") == F.col("relation")).cast("double")), 6).alias("accuracy"))


@query(
    sql(
        """, s AS (SELECT head, tail, relation % 10 AS truth, r, (head * 31 + tail * 17 + r * 7) % 5 AS s FROM kg_triples, range(10) g(r) WHERE split = 'test'),
        t AS (SELECT *, max(s) FILTER (r = truth) OVER (PARTITION BY head, tail) AS st FROM s)
        SELECT count(DISTINCT (head, tail)) AS n, sum(CASE WHEN s >= st THEN 1 ELSE 0 END) AS pessimistic, sum(CASE WHEN s > st OR r = truth THEN 1 ELSE 0 END) AS optimistic,
               sum(CASE WHEN s > st OR (s = st AND r <= truth) THEN 1 ELSE 0 END) AS lower_index, sum(CASE WHEN s > st OR (s = st AND r >= truth) THEN 1 ELSE 0 END) AS higher_index FROM t""",
        "kg_triples",
    )
)
def rank_tie_rules(spark, d):
    t = graph.triples(spark, d).where("split = 'test'").withColumn("truth", F.col("relation") % 10)
    t = t.withColumn("scores", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda r: (F.col("head") * 31 + F.col("tail") * 17 + r * 7) % 5))
    rules = ["pessimistic", "optimistic", "lower_index", "higher_index"]
    return t.agg(F.count("*").alias("n"), *[F.sum(V.rank_of(F.col("scores"), F.col("truth"), r)).alias(r) for r in rules])


_ALPHAS = [0.01, 0.05, 0.1]
_PROBS = _SCORES + ", pr AS (SELECT head, tail, truth, split, r, exp(s) / sum(exp(s)) OVER (PARTITION BY head, tail, truth) AS p FROM lg)"
_CAL = """cal AS (SELECT 1 - p AS sc, row_number() OVER (ORDER BY 1 - p) - 1 AS place, count(*) OVER () AS n FROM pr WHERE split = 'valid' AND r = truth),
    al AS (SELECT unnest([0.01, 0.05, 0.1]::DOUBLE[]) AS alpha), q AS (SELECT alpha, n, sc AS q_hat FROM al, cal WHERE place = least(CAST(ceil(round((n + 1) * (1 - alpha), 9)) AS BIGINT), n - 1))"""
_QUANTILES = _PROBS + ", " + _CAL


def _conformal(spark, d):
    scored, _ = _scored(spark, d, ["valid", "test"])
    p = scored.select("split", F.col("relation").alias("label"), V.softmax(F.col("scores")).alias("probs")).persist()
    cal = p.where("split = 'valid'").select((1 - F.element_at("probs", F.col("label") + 1)).alias("score"))
    return p, ranking.quantiles(cal, _ALPHAS)


@query(sql(f"{_QUANTILES} SELECT alpha, n, round(q_hat, 6) AS q_hat FROM q", "kg_entities", "kg_triples"))
def conformal_quantiles(spark, d):
    return _conformal(spark, d)[1].select("alpha", "n", F.round("q_hat", 6).alias("q_hat"))


@query(sql(f"{_QUANTILES}, c AS (SELECT alpha, head, tail, truth, max(CASE WHEN r = truth AND p >= 1 - q_hat THEN 1.0 ELSE 0 END) AS hit, count(*) FILTER (p >= 1 - q_hat) AS size FROM pr, q WHERE split = 'test' GROUP BY ALL) SELECT alpha, round(avg(hit), 4) AS coverage, round(avg(size), 2) AS mean_size FROM c GROUP BY 1", "kg_entities", "kg_triples"))
def conformal_metrics(spark, d):
    t = graph.triples(spark, d)
    f = features.standardised(graph.entities(spark, d)).persist()
    score = ranking.translation_scorer(ranking.translation_vectors(t.where("split = 'train'"), f, spark.range(CLASSES).select(F.col("id").cast("int").alias("relation"))))

    def probs(p):
        e = np.exp((z := score(p)) - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    ends = features.with_ends(t.where("split <> 'train'"), f).withColumnRenamed("relation", "label")
    out = ranking.conformal_by(probs, *[ends.where(F.col("split") == x).select("fh", "ft", "label") for x in ("valid", "test")], _ALPHAS)
    return out.select("alpha", F.round("coverage", 4).alias("coverage"), F.round("mean_size", 2).alias("mean_size"))


# ---- tensor model and embedding scores

_K = 4


def _factor_sql() -> str:
    i, r, lo = "range(64) a(i)", f"range({CLASSES}) b(r)", f"range({_K}) c(l)"
    return f""", pj AS (SELECT entity, l, sum(features[i + 1] * sin(31 * i + l) / 8) AS xw, sum(features[i + 1] * cos(17 * l + i) / 8) AS yh FROM kg_entities, {i}, {lo} GROUP BY ALL),
    z AS (SELECT head, tail, relation, split, h.l AS l, h.xw * t.yh AS z FROM kg_triples JOIN pj h ON h.entity = head JOIN pj t ON t.entity = tail AND t.l = h.l),
    cc AS (SELECT l, CAST(r AS INT) AS r, sin(7 * l + 13 * r) / 8 AS c FROM {lo}, {r}),
    lo AS (SELECT head, tail, relation, split, r, sum(z * c) AS s FROM z JOIN cc USING (l) GROUP BY ALL)"""


def _pairs(spark, d, split):
    t = graph.triples(spark, d)
    return features.with_ends(t.where(F.col("split").isin(split)), graph.entities(spark, d)).withColumn("label", F.col("relation"))


def _blocks(spark, d):
    """All pairs as blocks of row numbers, for training in many passes."""
    return coded.coded(graph.triples(spark, d).withColumn("label", F.col("relation")), graph.entities(spark, d))


def _factors():
    return cpd.closed_form(64, _K, CLASSES)


@query(sql(f"{_factor_sql()}, p AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY head, tail, relation) AS p FROM lo WHERE split = 'test') SELECT relation, count(*) AS n, round(avg(p), 6) AS mean_p FROM p WHERE r = relation GROUP BY 1", "kg_entities", "kg_triples"))
def cpd_scores(spark, d):
    out = cpd.scores(_pairs(spark, d, ["test"]).select("relation", "fh", "ft"), _factors())
    return out.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg(F.element_at("probs", F.col("relation") + 1)), 6).alias("mean_p"))


@query(sql(f"{_factor_sql()}, rk AS (SELECT head, tail, relation, count(*) FILTER (s >= st) AS rank FROM (SELECT *, max(s) FILTER (r = relation) OVER (PARTITION BY head, tail, relation) AS st FROM lo WHERE split = 'test') GROUP BY ALL) SELECT {_METRICS} FROM rk", "kg_entities", "kg_triples"))
def cpd_metrics(spark, d):
    out = cpd.scores(_pairs(spark, d, ["test"]).select("relation", "fh", "ft"), _factors())
    return _rounded(ranking.metrics(out.select(V.rank_of(F.col("probs"), F.col("relation")).alias("rank"))))


@query(sql(f"{_factor_sql()}, p AS (SELECT *, exp(s - max(s) OVER w) AS e, sum(exp(s - m)) OVER w AS t FROM (SELECT *, max(s) OVER (PARTITION BY head, tail, relation) AS m FROM lo WHERE split = 'train') WINDOW w AS (PARTITION BY head, tail, relation)) SELECT round(-sum(ln(e / (t + 1e-10) + 1e-10)), 4) AS loss FROM p WHERE r = relation", "kg_entities", "kg_triples"))
def cpd_loss(spark, d):
    f = _factors()
    total = cpd.matrix_sum(_pairs(spark, d, ["train"]), lambda x, y, r: cpd.block_loss(x, y, r, f))
    return spark.createDataFrame([(round(float(total[0]), 4),)], "loss double")


@query(
    sql(
        f"""{_factor_sql()}, p AS (SELECT *, exp(s - m) / (sum(exp(s - m)) OVER (PARTITION BY head, tail, relation) + 1e-10) - CASE WHEN r = relation THEN 1 ELSE 0 END AS dl FROM (SELECT *, max(s) OVER (PARTITION BY head, tail, relation) AS m FROM lo WHERE split = 'train')),
        g AS (SELECT l, r, sum(z * dl) AS g FROM p JOIN z USING (head, tail, relation) GROUP BY ALL) SELECT CAST(l AS INT) AS l, round(sqrt(sum(g * g)), 4) AS norm FROM g GROUP BY 1""",
        "kg_entities",
        "kg_triples",
    )
)
def cpd_grad_c_norm(spark, d):
    f = _factors()
    g = cpd.matrix_sum(_pairs(spark, d, ["train"]), lambda x, y, r: cpd.block_gradient(x, y, r, f, "c")).reshape(_K, CLASSES)
    return spark.createDataFrame([(i, round(float(np.linalg.norm(g[i])), 4)) for i in range(_K)], "l int, norm double")


@query()
def cpd_grad_hvp_norms(spark, d):
    """Norms of all gradients and of the Hessian products with the factors themselves."""
    f = _factors()
    wanted = [((kind, f, b, getattr(f, b) if kind == "hessian" else None), 0) for b in "whc" for kind in ("gradient", "hessian")]
    ends = np.cumsum([0, *[getattr(f, b).size for (_, _, b, _), _ in wanted]])
    # all sums in one pass, so that the wide pairs need not be kept
    got = cpd.matrix_sum(_pairs(spark, d, ["train"]), lambda x, y, r: np.concatenate([a.ravel() for a in cpd.block_answers(x, y, r, wanted)]), size=int(ends[-1]))
    norms = [round(float(np.linalg.norm(got[a:e])), 3) for a, e in zip(ends[:-1], ends[1:], strict=True)]
    rows = [(b, norms[2 * i], norms[2 * i + 1]) for i, b in enumerate("whc")]
    return spark.createDataFrame(rows, "factor string, gradient double, hessian double")


@query()
def cpd_training(spark, d):
    """One configuration trained by distributed passes: first and last loss, validation and test MRR."""
    return cpd.fit_configs(_blocks(spark, d), ledger.grid(spark, k=[8], penalty=[10.0], bias=[4], seed=[7001]), CLASSES, rounds=1)


@query()
def cpd_grid_search(spark, d):
    """A grid of 18 configurations of two seeds each, 50 rounds, all in the same passes, best mean validation MRR first."""
    g = ledger.grid(spark, k=[2, 4, 8], penalty=[1.0, 10.0, 100.0], bias=[1, 4], seed=[1, 2])
    return ledger.best(cpd.fit_configs(_blocks(spark, d), g, CLASSES, rounds=50).join(F.broadcast(g), "config"), ["k", "penalty", "bias"], "valid_mrr", 5)


@query(sql(f"{_factor_sql()}, p AS (SELECT head, tail, relation, arg_max(r, s) AS r FROM lo WHERE split = 'test' GROUP BY ALL) SELECT 'r' || r AS predicted, count(*) AS n, count(*) FILTER (r = relation) AS hits FROM p GROUP BY 1", "kg_entities", "kg_triples"))
def cpd_predictions(spark, d):
    """The names that the tensor model predicts for the test pairs, and how often they are right."""
    names = spark.range(CLASSES).select(F.col("id").cast("int").alias("idx"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("relation"))
    out = cpd.predict(_pairs(spark, d, ["test"]).select(F.concat(F.lit("r"), F.col("relation").cast("string")).alias("name"), "fh", "ft"), _factors(), names)
    return out.groupBy("predicted").agg(F.count("*").alias("n"), F.count_if(F.col("name") == F.col("predicted")).alias("hits"))


_KGE = {
    "distmult": ("sum(h.features[i + 1] * t.features[i + 1] * sin(5 * r + 3 * i))", 64),
    "complex": ("sum((h.features[i + 1] * t.features[i + 1] - h.features[i + 33] * t.features[i + 33]) * sin(5 * r + 3 * i) + (h.features[i + 1] * t.features[i + 33] + h.features[i + 33] * t.features[i + 1]) * cos(2 * r + 7 * i))", 32),
    "rotate": ("sum((h.features[i + 1] * t.features[i + 1] - h.features[i + 33] * t.features[i + 33]) * cos(sin(5 * r + 3 * i) * pi()) + (h.features[i + 1] * t.features[i + 33] + h.features[i + 33] * t.features[i + 1]) * sin(sin(5 * r + 3 * i) * pi()))", 32),
}


def _kge_query(kind: str, expression: str, n: int):
    def run(spark, d):
        return _rounded(ranking.metrics(kge.ranks(_pairs(spark, d, ["test"]), kind, kge.closed_form(kind, CLASSES, 64))))

    name = f"{kind}_metrics"
    QUERIES[name] = run
    ORACLE_SQL[name] = sql(
        f""", s AS (SELECT head, tail, relation, r, {expression} AS s FROM kg_triples JOIN kg_entities h ON h.entity = head JOIN kg_entities t ON t.entity = tail, range({CLASSES}) a(r), range({n}) b(i) WHERE split = 'test' GROUP BY ALL),
        rk AS (SELECT head, tail, relation, count(*) FILTER (s >= st) AS rank FROM (SELECT *, max(s) FILTER (r = relation) OVER (PARTITION BY head, tail, relation) AS st FROM s) GROUP BY ALL) SELECT {_METRICS} FROM rk""",
        "kg_entities",
        "kg_triples",
    )


for _kind, _x in _KGE.items():
    _kge_query(_kind, *_x)


def _kge_conformal(kind: str, expression: str, n: int):
    name = f"{kind}_conformal"

    def run(spark, d):
        p = _pairs(spark, d, ["valid", "test"])
        out = kge.conformal(p.where("split = 'valid'"), p.where("split = 'test'"), kind, kge.closed_form(kind, CLASSES, 64), _ALPHAS)
        return out.select("alpha", F.round("coverage", 4).alias("coverage"), F.round("mean_size", 2).alias("mean_size"))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql(
        f""", s AS (SELECT head, tail, relation AS truth, split, r, {expression} AS s FROM kg_triples JOIN kg_entities h ON h.entity = head JOIN kg_entities t ON t.entity = tail, range({CLASSES}) a(r), range({n}) b(i) WHERE split <> 'train' GROUP BY ALL),
        mx AS (SELECT *, exp(s - max(s) OVER (PARTITION BY head, tail)) AS e FROM s), pr AS (SELECT *, e / sum(e) OVER (PARTITION BY head, tail) AS p FROM mx),
        {_CAL}, c AS (SELECT alpha, head, tail, truth, max(CASE WHEN r = truth AND p >= 1 - q_hat THEN 1.0 ELSE 0 END) AS hit, count(*) FILTER (p >= 1 - q_hat) AS size FROM pr, q WHERE split = 'test' GROUP BY ALL)
        SELECT alpha, round(avg(hit), 4) AS coverage, round(avg(size), 2) AS mean_size FROM c GROUP BY 1""",
        "kg_entities",
        "kg_triples",
    )


for _kind, _x in _KGE.items():
    _kge_conformal(_kind, *_x)


@query()
def kge_training(spark, d):
    """DistMult, ComplEx and RotatE by mini-batch Adam, a distributed gradient a step: first and last loss, test metrics."""
    return kge.fit_methods(_blocks(spark, d), ["distmult", "complex", "rotate"], CLASSES, dim=64, epochs=10, batch=8192, rate=0.02)  # eight times the batch, a larger rate


@query()
def mlp_projector_training(spark, d):
    """The projector trained on the scaled features: mean loss of each epoch."""
    f = features.standardised(graph.entities(spark, d)).select("entity", "features")
    t = graph.triples(spark, d).where("split = 'train'").withColumn("label", F.col("relation"))
    blocks = coded.coded(t, f).of("train").persist()
    _, curve = projector.fit(blocks, 64, CLASSES, out=512, hidden=512, epochs=20, batch=4096, dropout=0.3, seed=28)
    blocks.unpersist()
    return spark.createDataFrame(list(enumerate(curve)), "epoch int, loss double")


def _classifier_query(method: str, score=None):
    def run(spark, d):
        t = graph.triples(spark, d).withColumn("label", F.col("relation"))
        out = (score or classifiers.METHODS[method])(t, graph.entities(spark, d), CLASSES).where("split = 'test'")
        return _rounded(ranking.metrics(out.select(V.rank_of(F.col("probs"), F.col("label")).alias("rank"))))

    QUERIES[f"{method}_metrics"] = run


for _how in ("concat", "subtract"):
    _classifier_query(f"lr_{_how}", lambda t, f, n, how=_how: classifiers.trained(t, f, how, lambda m: classifiers.logistic(m, iterations=1000), n))
    _classifier_query(f"rf_{_how}")
    _classifier_query(f"gbt_{_how}", lambda t, f, n, how=_how: classifiers.boosted(t, f, how, boosting.Settings(), n))

# ---- ledger

_NEW = "new_runs AS (SELECT method, model, aggregation, version, round(mrr + 1, 6) AS mrr, CAST(length(version) AS DOUBLE) AS hits_1 FROM runs WHERE model = 'm1')"


def _new(spark, d):
    return graph.runs(spark, d).where("model = 'm1'").select("method", "model", "aggregation", "version", F.round(F.col("mrr") + 1, 6).alias("mrr"), F.length("version").cast("double").alias("hits_1"))


@query(sql(f", {_NEW} SELECT method, model, aggregation, version, mrr, CAST(NULL AS DOUBLE) AS hits_1 FROM runs r WHERE NOT EXISTS (FROM new_runs n WHERE (n.method, n.model, n.aggregation, n.version) = (r.method, r.model, r.aggregation, r.version)) UNION ALL FROM new_runs", "runs"))
def ledger_upsert(spark, d):
    return ledger.upsert(graph.runs(spark, d), _new(spark, d))


@query(sql(", w AS (SELECT DISTINCT m.method, r.model, r.aggregation, r.version FROM runs r, (SELECT DISTINCT method FROM runs UNION SELECT 'tensor_softmax') m) SELECT * FROM w WHERE NOT EXISTS (FROM runs r WHERE (w.method, w.model, w.aggregation, w.version) = (r.method, r.model, r.aggregation, r.version))", "runs"))
def ledger_pending(spark, d):
    runs = graph.runs(spark, d)
    methods = runs.select("method").distinct().union(spark.createDataFrame([("tensor_softmax",)], "method string"))
    wanted = runs.select("model", "aggregation", "version").distinct().crossJoin(F.broadcast(methods))
    return ledger.pending(wanted.select(*ledger.KEYS), runs)


@query(sql(", have AS (SELECT * FROM runs WHERE NOT (method = 'view' AND starts_with(version, 'v1_'))), m AS (SELECT count(DISTINCT method) AS k FROM runs) SELECT model, aggregation, version FROM (SELECT DISTINCT model, aggregation, version FROM runs) w WHERE NOT EXISTS (SELECT 1 FROM have r, m WHERE (r.model, r.aggregation, r.version) = (w.model, w.aggregation, w.version) GROUP BY k HAVING count(DISTINCT method) = k)", "runs"))
def ledger_pending_families(spark, d):
    """Families that a ledger without one method's runs of one version has not completed."""
    runs = graph.runs(spark, d)
    methods = [r["method"] for r in runs.select("method").distinct().collect()]  # as many as there are methods
    have = runs.where(~((F.col("method") == "view") & F.col("version").startswith("v1_")))
    return ledger.pending_families(runs.select("model", "aggregation", "version").distinct(), have, methods)


_BASE = "CASE WHEN regexp_extract(version, '^(.+_ind)_seed\\d+$', 1) <> '' THEN regexp_extract(version, '^(.+_ind)_seed\\d+$', 1) ELSE version END"
_SUMMARY = f"su AS (SELECT method, model, aggregation, {_BASE} AS base_version, count(DISTINCT version) AS n_seeds, avg(mrr) AS mean, CASE WHEN count(mrr) = 1 THEN 0 ELSE stddev_samp(mrr) END AS std FROM runs GROUP BY ALL)"


@query(sql(f", {_SUMMARY} SELECT method, model, aggregation, base_version, n_seeds, round_even(mean, 6) AS mrr_mean, round_even(std, 6) AS mrr_std FROM su", "runs"))
def ledger_summary(spark, d):
    return ledger.summary(graph.runs(spark, d))


_PLACE = {"click": 0, "view": 1, "purchase": 2}


@query(sql(f", {_SUMMARY} SELECT base_version, model, method, CASE method WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 ELSE 99 END AS place, n_seeds, printf('%.4f', round_even(mean, 6)) || '+/-' || printf('%.4f', round_even(std, 6)) AS mrr FROM su", "runs"))
def ledger_report(spark, d):
    out = ledger.report(ledger.summary(graph.runs(spark, d)), ["mrr"], order=_PLACE)
    return out.orderBy("base_version", "model", "place", "method")


@query(
    sql(
        f""", ax AS (SELECT me.method, mo.model, ba.base_version FROM (SELECT DISTINCT method FROM runs) me, (SELECT DISTINCT model FROM runs) mo, (SELECT DISTINCT {_BASE} AS base_version FROM runs) ba),
        nu AS (SELECT *, row_number() OVER (ORDER BY method, model, base_version) - 1 AS config FROM ax), k AS (SELECT method, model, {_BASE} AS base_version, count(*) AS n FROM runs GROUP BY ALL)
        SELECT config, method, model, base_version, coalesce(n, 0) AS runs FROM nu LEFT JOIN k USING (method, model, base_version)""",
        "runs",
    )
)
def grid_configs(spark, d):
    """Every combination of the ledger's methods, models and base versions, numbered, and how often it was run."""
    runs = graph.runs(spark, d).withColumn("base_version", splits.base_version("version"))
    axes = {c: sorted(r[0] for r in runs.select(c).distinct().collect()) for c in ("method", "model", "base_version")}  # the axes of the grid
    done = runs.groupBy(*axes).agg(F.count("*").alias("runs"))
    return ledger.grid(spark, **axes).join(done, list(axes), "left").select("config", *axes, F.coalesce("runs", F.lit(0)).alias("runs"))


@query(sql(f", {_SUMMARY} SELECT method, model, aggregation, base_version, n_seeds, round_even(mean, 6) AS mrr_mean, round_even(std, 6) AS mrr_std FROM su WHERE base_version IN ('v0_ind', 'v2_ind')", "runs"))
def ledger_summary_of_bases(spark, d):
    return ledger.summary(graph.runs(spark, d), bases=["v0_ind", "v2_ind", "v9_ind"])


@query(sql("SELECT method, model, round(avg(mrr), 6) AS mrr_mean, count(mrr) AS runs FROM runs GROUP BY ALL ORDER BY avg(mrr) DESC, method, model LIMIT 5", "runs"))
def grid_best(spark, d):
    return ledger.best(graph.runs(spark, d), ["method", "model"], "mrr", 5).withColumn("mrr_mean", F.round("mrr_mean", 6))


@query(sql("SELECT method, model, version, mrr, coalesce(mrr > max(mrr) OVER (PARTITION BY method, model ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS improved FROM runs", "runs"))
def running_best(spark, d):
    return ledger.running_best(graph.runs(spark, d), ["method", "model"], "version", "mrr").drop("aggregation")


@query(sql("SELECT version, method, mrr FROM runs WHERE starts_with(version, 'v1_')", "runs"))
def ledger_prefix_rows(spark, d):
    return ledger.present(ledger.with_prefix(graph.runs(spark, d), "version", "v1_"), ["version", "method", "train_time_s", "mrr"])


@query(sql("SELECT method, model, count(DISTINCT version) AS n_seeds, round_even(avg(mrr), 6) AS mrr_mean, round_even(CASE WHEN count(mrr) = 1 THEN 0 ELSE stddev_samp(mrr) END, 6) AS mrr_std FROM runs GROUP BY ALL", "runs"))
def grid_config_summary(spark, d):
    return ledger.config_summary(graph.runs(spark, d), ["method", "model"], ["mrr"], seed="version")


# ---- graph extraction

_ADJ = "adj AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM kg_edges UNION ALL SELECT dst, src FROM kg_edges)), pairs AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pair, src AS head, dst AS tail FROM kg_edges WHERE relation = 'part_of')"


def _level_sql(name: str, end: str) -> str:
    return f"""{name}1 AS (SELECT DISTINCT pair, dst AS node FROM pairs JOIN adj ON src = {end} WHERE dst <> {end}),
    {name}2 AS (SELECT DISTINCT l.pair, dst AS node FROM {name}1 l JOIN pairs p USING (pair) JOIN adj ON src = node WHERE dst <> p.{end} AND NOT EXISTS (FROM {name}1 x WHERE x.pair = l.pair AND x.node = dst)),
    {name} AS (SELECT pair, node, 1 AS hop FROM {name}1 UNION ALL SELECT pair, node, 2 FROM {name}2)"""


def _graph(spark, d):
    """Coded edges(src, dst), the part_of pairs numbered in the order of their names, the adjacency."""
    e = cut(graph.coded_edges(spark, d))
    pairs = cut(with_position(e.where("relation = 'part_of'").select(F.col("src").alias("head"), F.col("dst").alias("tail")), [graph.named("head"), graph.named("tail")], "pair"))
    return e.select("src", "dst"), pairs, cut(subgraph.symmetric(e))


@query(sql(f", {_ADJ}, {_level_sql('h', 'head')} SELECT pair, CAST(hop AS INT) AS hop, count(*) AS n FROM h GROUP BY ALL", "kg_edges"))
def khop_neighbors(spark, d):
    _, pairs, adj = _graph(spark, d)
    return subgraph.levels(pairs.select("pair", F.col("head").alias("node")), adj, 2).groupBy("pair", "hop").agg(F.count("*").alias("n"))


_NODES = "inn AS (SELECT DISTINCT h.pair, h.node FROM h JOIN t USING (pair, node) JOIN pairs p USING (pair) WHERE h.node NOT IN (p.head, p.tail)), un AS (SELECT DISTINCT pair, node FROM (FROM h UNION ALL FROM t) JOIN pairs p USING (pair) WHERE node NOT IN (p.head, p.tail))"


# Two hops around both ends of every edge: balls and paths are counted, as rows of (pair, node) are too many.
_EVERY = ", adj AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM kg_edges UNION ALL SELECT dst, src FROM kg_edges) WHERE src <> dst), pairs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pair, src AS head, dst AS tail FROM kg_edges)"


def _every_pair(spark, d):
    """All edges(pair, head, tail) of the graph with coded keys, numbered in the order of their names."""
    e = graph.coded_edges(spark, d).select(F.col("src").alias("head"), F.col("dst").alias("tail"))
    return cut(with_position(e, [graph.named("head"), graph.named("tail")], "pair").select("pair", "head", "tail"))


@query(
    sql(
        f"""{_EVERY}, ball AS MATERIALIZED (SELECT DISTINCT x, y FROM (SELECT src AS x, src AS y FROM adj UNION ALL SELECT src, dst FROM adj UNION ALL SELECT a.src, b.dst FROM adj a JOIN adj b ON b.src = a.dst)),
        size AS (SELECT x, count(*) AS n FROM ball GROUP BY 1), met AS (SELECT pair, count(*) AS n FROM pairs JOIN ball a ON a.x = head SEMI JOIN ball b ON b.x = tail AND b.y = a.y GROUP BY 1)
        SELECT pair, met.n AS enclosing, h.n + t.n - met.n AS whole FROM pairs JOIN met USING (pair) JOIN size h ON h.x = head JOIN size t ON t.x = tail""",
        "kg_edges",
    )
)
def enclosing_subgraph_sizes(spark, d):
    """Sizes of the two-hop subgraphs of every edge of the graph."""
    return balls.sizes(_every_pair(spark, d), None, 2).select("pair", "enclosing", "whole")


_ALL = f""", adj AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM kg_edges UNION ALL SELECT dst, src FROM kg_edges)), pairs AS (SELECT row_number() OVER (ORDER BY src, relation, dst) - 1 AS pair, relation, src AS head, dst AS tail FROM kg_edges),
    h AS (SELECT DISTINCT pair, dst AS node FROM pairs JOIN adj ON src = head WHERE dst <> head), t AS (SELECT DISTINCT pair, dst AS node FROM pairs JOIN adj ON src = tail WHERE dst <> tail), {_NODES},
    a AS (SELECT pair, count(*) AS n FROM inn GROUP BY 1), b AS (SELECT pair, count(*) AS n FROM un GROUP BY 1)"""


@query(sql(f"{_ALL} SELECT relation, count(*) AS pairs, CAST(sum(coalesce(a.n, 0) + 2) AS BIGINT) AS enclosing, CAST(sum(coalesce(b.n, 0) + 2) AS BIGINT) AS whole, max(coalesce(b.n, 0) + 2) AS largest FROM pairs LEFT JOIN a USING (pair) LEFT JOIN b USING (pair) GROUP BY 1", "kg_edges"))
def enclosing_sizes_all_pairs(spark, d):
    """One-hop subgraphs of every edge of the graph, by relation."""
    e = cut(graph.coded_edges(spark, d))
    pairs = e.select(F.col("relation").alias("pair"), F.col("src").alias("head"), F.col("dst").alias("tail"))  # no size needs a pair's number
    out = subgraph.one_hop_sizes(pairs, subgraph.symmetric(e)).withColumnRenamed("pair", "relation")
    return out.groupBy("relation").agg(F.count("*").alias("pairs"), F.sum("enclosing").alias("enclosing"), F.sum("whole").alias("whole"), F.max("whole").alias("largest"))


_DRNL = """sub AS (SELECT pair, node FROM un UNION SELECT pair, head FROM pairs UNION SELECT pair, tail FROM pairs),
    se AS (SELECT a.pair, e.src, e.dst FROM sub a JOIN adj e ON e.src = a.node JOIN sub b ON b.pair = a.pair AND b.node = e.dst),
    eh AS (SELECT se.* FROM se JOIN pairs p USING (pair) WHERE src <> p.tail AND dst <> p.tail), et AS (SELECT se.* FROM se JOIN pairs p USING (pair) WHERE src <> p.head AND dst <> p.head),
    h1 AS (SELECT DISTINCT pair, dst AS node FROM eh JOIN pairs p USING (pair) WHERE src = p.head), h2 AS (SELECT DISTINCT eh.pair, dst AS node FROM eh JOIN h1 ON h1.pair = eh.pair AND h1.node = eh.src),
    t1 AS (SELECT DISTINCT pair, dst AS node FROM et JOIN pairs p USING (pair) WHERE src = p.tail), t2 AS (SELECT DISTINCT et.pair, dst AS node FROM et JOIN t1 ON t1.pair = et.pair AND t1.node = et.src),
    dh AS (SELECT pair, node, min(d) AS d FROM (SELECT *, 1 AS d FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY ALL), dt AS (SELECT pair, node, min(d) AS d FROM (SELECT *, 1 AS d FROM t1 UNION ALL SELECT *, 2 FROM t2) GROUP BY ALL),
    lab AS (SELECT un.pair, un.node, dt.d AS first, dh.d AS second FROM un JOIN dh USING (pair, node) JOIN dt USING (pair, node) UNION ALL SELECT pair, head, 0, 1 FROM pairs UNION ALL SELECT pair, tail, 1, 0 FROM pairs)"""


@query(
    sql(
        f"""{_EVERY}, two AS MATERIALIZED (SELECT a.src AS x, b.dst AS z, count(*) AS n FROM adj a JOIN adj b ON b.src = a.dst WHERE a.src <> b.dst GROUP BY ALL), far AS MATERIALIZED (SELECT x, z, n FROM two ANTI JOIN adj ON src = x AND dst = z)
        SELECT pair, CAST(first AS INT) AS first, CAST(second AS INT) AS second, n FROM (
            SELECT pair, 0 AS first, 1 AS second, 1 AS n FROM pairs UNION ALL SELECT pair, 1, 0, 1 FROM pairs
            UNION ALL SELECT pair, 1, 1, count(*) FROM pairs JOIN adj a ON a.src = head SEMI JOIN adj b ON b.src = tail AND b.dst = a.dst GROUP BY 1
            UNION ALL SELECT pair, 1, 2, count(*) FROM pairs JOIN adj a ON a.src = tail JOIN far f ON f.x = head AND f.z = a.dst WHERE f.n >= 2 AND a.dst <> head GROUP BY 1
            UNION ALL SELECT pair, 2, 1, count(*) FROM pairs JOIN adj a ON a.src = head JOIN far f ON f.x = tail AND f.z = a.dst WHERE f.n >= 2 AND a.dst <> tail GROUP BY 1
            UNION ALL SELECT pair, 2, 2, count(*) FROM pairs JOIN far f ON f.x = head SEMI JOIN far g ON g.x = tail AND g.z = f.z WHERE f.z <> tail GROUP BY 1)""",
        "kg_edges",
    )
)
def drnl_labels(spark, d):
    """Distance labels of the two-hop subgraphs of every edge of the graph, counted by pair."""
    out = balls.label_counts(_every_pair(spark, d), None)
    rows = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), n.cast("long").alias("n")) for a, b, n in [(0, 1, F.lit(1)), (1, 0, F.lit(1)), *[(a, b, F.col(f"n{a}{b}")) for a in (1, 2) for b in (1, 2)]]]
    return out.select("pair", F.inline(F.array(*rows))).where("n > 0")


@query(sql(", r AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS t FROM (SELECT DISTINCT relation FROM kg_edges)), e AS (SELECT src, dst, t FROM kg_edges JOIN r USING (relation)), k AS (SELECT count(*) AS k FROM r) SELECT type, count(*) AS n, count(DISTINCT src) AS sources FROM (SELECT src, dst, t AS type FROM e UNION ALL SELECT dst, src, t + k FROM e, k) GROUP BY 1", "kg_edges"))
def inverse_edges(spark, d):
    e = graph.edges(spark, d)
    r = vocab.dense_index(e, "relation", "type")
    out = subgraph.inverse(e.join(F.broadcast(r), "relation"), r.count())
    return out.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"))


_LABELS = f", {_ADJ}, {_level_sql('hh', 'head')}, {_level_sql('tt', 'tail')}, un AS (SELECT DISTINCT pair, node FROM (FROM hh UNION ALL FROM tt) JOIN pairs p USING (pair) WHERE node NOT IN (p.head, p.tail)), {_DRNL}"


def _dataset(spark, d):
    e, pairs, _ = _graph(spark, d)
    return subgraph.dataset(pairs, e, 2)


@query(sql(f"{_LABELS} SELECT max(first) AS max_first, max(second) AS max_second, round(avg(n), 6) AS mean_size FROM (SELECT pair, count(*) AS n, max(first) AS first, max(second) AS second FROM lab GROUP BY 1)", "kg_edges"))
def subgraph_label_extent(spark, d):
    return _dataset(spark, d)[2].withColumn("mean_size", F.round("mean_size", 6))


@query(
    sql(
        f"""{_LABELS}, top AS (SELECT max(first) AS f, max(second) AS s FROM lab)
        SELECT pair, CASE WHEN first = 0 AND second = 1 THEN 1 WHEN first = 1 AND second = 0 THEN 2 ELSE 0 END AS mark,
               array_to_string(list_concat(list_transform(range(0, f + 1), lambda i: CAST(i = first AS INT)), list_transform(range(0, s + 1), lambda i: CAST(i = second AS INT))), '') AS features, count(*) AS n
        FROM lab, top GROUP BY ALL""",
        "kg_edges",
    )
)
def subgraph_node_features(spark, d):
    nodes = _dataset(spark, d)[0]
    return nodes.groupBy("pair", "mark", F.array_join(F.transform("features", lambda x: x.cast("string")), "").alias("features")).agg(F.count("*").alias("n"))


@query(
    sql(
        f"""{_LABELS} SELECT pair, count(*) AS edges, count(*) FILTER (src = p.head) AS out_head FROM pairs p JOIN (SELECT a.pair, e.src, e.dst FROM lab a JOIN adj e ON e.src = a.node JOIN lab b ON b.pair = a.pair AND b.node = e.dst) i USING (pair)
        WHERE NOT (src = p.head AND dst = p.tail) AND NOT (src = p.tail AND dst = p.head) GROUP BY 1""",
        "kg_edges",
    )
)
def subgraph_edges_without_target(spark, d):
    _, pairs, _ = _graph(spark, d)
    inside = _dataset(spark, d)[1]
    return inside.join(F.broadcast(pairs), "pair").groupBy("pair").agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("head")).alias("out_head"))


from . import catalog_network  # noqa: E402, F401  registers its queries

#: Queries that train: they take minutes, and come last.
TRAINING = [n for n in QUERIES if n.endswith("_training") or n in ("cpd_grid_search", "subgraph_network_conformal") or n.startswith(("lr_", "rf_", "gbt_"))]
