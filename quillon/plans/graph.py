"""The knowledge graph and ledger that the queries derive from the warehouse tables.

Integer arithmetic only, so that any SQL engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, features (doubles), label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entity"), F.col("embedding").cast("array<double>").alias("features"), "label")


def _labelled_pairs(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    """head, tail, relation (10 * label of head + label of tail), split of distinct pairs(head, tail) of different entities, whose keys wrap around."""
    e = entities(spark, sf_dir)
    n = e.agg(F.count("*").alias("n"))
    pairs = pairs.toDF("h", "t").crossJoin(F.broadcast(n))  # one row
    pairs = pairs.select((F.col("h") % F.col("n")).alias("head"), (F.col("t") % F.col("n")).alias("tail")).where("head <> tail").distinct()
    labels = cut(e.select("entity", "label"))  # written, its size is known: joined where the pairs are, if small
    out = pairs.join(labels.toDF("head", "lh"), "head").join(labels.toDF("tail", "lt"), "tail")
    b = (F.col("head") * 7919 + F.col("tail") * 104729) % 10
    return out.select("head", "tail", (10 * F.col("lh") + F.col("lt")).cast("int").alias("relation"), F.when(b == 0, "valid").when(b == 1, "test").otherwise("train").alias("split"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """head, tail, relation, split: entities that lineitem brings together, a dense graph."""
    return _labelled_pairs(spark, sf_dir, table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """head, tail, relation, split: entities that orders brings together, a sparser graph."""
    return _labelled_pairs(spark, sf_dir, table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"))


#: Tables by the letter of their keys; a coded key is its number times 8 and the letter's place here.
LETTERS = "rncspo"


def coded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, relation, dst of `edges` with long keys (see LETTERS), which take a fraction of the room of the names; `named` turns one back."""

    def key(prefix: str, col: str):
        return (F.col(col).cast("long") * 8 + LETTERS.index(prefix)).cast("long")

    def rel(name: str, src, dst, df: DataFrame) -> DataFrame:  # no two of them have a row in common
        return df.select(src.alias("src"), dst.alias("dst")).distinct().select("src", F.lit(name).alias("relation"), "dst")

    li = table(spark, sf_dir, "lineitem")
    parts = [
        rel("located_in", key("c", "c_custkey"), key("n", "c_nationkey"), table(spark, sf_dir, "customer")),
        rel("located_in", key("s", "s_suppkey"), key("n", "s_nationkey"), table(spark, sf_dir, "supplier")),
        rel("part_of", key("n", "n_nationkey"), key("r", "n_regionkey"), table(spark, sf_dir, "nation")),
        rel("placed_by", key("o", "o_orderkey"), key("c", "o_custkey"), table(spark, sf_dir, "orders")),
        rel("contains", key("o", "l_orderkey"), key("p", "l_partkey"), li),
        rel("supplied_by", key("p", "l_partkey"), key("s", "l_suppkey"), li),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def named(code: str):
    """The name of a coded key: its table's letter and its number."""
    c = F.col(code)
    return F.concat(F.substring(F.lit(LETTERS), c.bitwiseAND(7).cast("int") + 1, F.lit(1)), F.shiftright(c, 3).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, relation, dst: the relations between the warehouse tables, keys prefixed by their table."""
    return coded_edges(spark, sf_dir).select(named("src").alias("src"), "relation", named("dst").alias("dst"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An experiment ledger: method, model, aggregation, version, mrr (one row a key)."""
    e = table(spark, sf_dir, "events")
    out = e.select(
        F.col("event_type").alias("method"),
        F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("model"),
        F.lit("sum").alias("aggregation"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string"), F.lit("_ind_seed"), F.col("user_id").cast("string")).alias("version"),
        "value",
    )
    return out.groupBy("method", "model", "aggregation", "version").agg(F.round(F.avg("value"), 6).alias("mrr"))


def _pairs_sql(source: str, head: str, tail: str) -> str:
    return f"""
        SELECT head, tail, CAST(10 * h.label + t.label AS INT) AS relation,
               CASE (head * 7919 + tail * 104729) % 10 WHEN 0 THEN 'valid' WHEN 1 THEN 'test' ELSE 'train' END AS split
        FROM (SELECT DISTINCT {head} % n AS head, {tail} % n AS tail FROM {source}, (SELECT count(*) AS n FROM embeddings) WHERE {head} % n <> {tail} % n) p
        JOIN embeddings h ON h.vec_id = head JOIN embeddings t ON t.vec_id = tail"""


#: The same views as DuckDB common table expressions.
SQL = {
    "kg_entities": "SELECT vec_id AS entity, CAST(embedding AS DOUBLE[]) AS features, label FROM embeddings",
    "kg_triples": _pairs_sql("lineitem", "l_partkey", "l_orderkey"),
    "kg_links": _pairs_sql("orders", "o_custkey", "o_orderkey"),
    "kg_edges": """
        SELECT 'c' || c_custkey AS src, 'located_in' AS relation, 'n' || c_nationkey AS dst FROM customer
        UNION SELECT 's' || s_suppkey, 'located_in', 'n' || s_nationkey FROM supplier
        UNION SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey FROM nation
        UNION SELECT 'o' || o_orderkey, 'placed_by', 'c' || o_custkey FROM orders
        UNION SELECT 'o' || l_orderkey, 'contains', 'p' || l_partkey FROM lineitem
        UNION SELECT 'p' || l_partkey, 'supplied_by', 's' || l_suppkey FROM lineitem""",
    "runs": """
        SELECT event_type AS method, 'm' || (user_id % 2) AS model, 'sum' AS aggregation, 'v' || (user_id % 3) || '_ind_seed' || user_id AS version, round(avg(value), 6) AS mrr
        FROM events GROUP BY ALL""",
}


def sql(query: str, *views: str) -> str:
    """query with the named views in front."""
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + " " + query if not query.lstrip().startswith(",") else "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + query
