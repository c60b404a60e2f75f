"""Merkle manifest of a table: one root for all rows, a subroot for each part, a proof for each row.

Rows of a part ascend by key. Runs of FAN consecutive nodes become one node, the SHA-256 of their
hex digests, until one is left. Blocks of FAN ** LEVELS leaves are aligned with the runs, so a block
is a subtree: executors work it out in DuckDB from Arrow tables, level by level. Spark combines the
block roots (a row for 4096 leaves) and hands every block its outer proof; a second pass over the
blocks, which hold digests and no texts, finishes the proofs of the leaves.

Null values are written `-` and so differ from empty ones. Null keys come first; rows of equal keys
follow their digest, and rows alike in all fields are a leaf each. A null part is a part of its own.
Texts of any length are hashed whole, in the JVM. An empty table has an empty manifest. Only the
named columns are read.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import with_position
from .common import stash

FAN = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as byte count, colon and value, or `-` where it is null."""
    texts = [x.cast("string") for x in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]), 256)


def leaves(docs: DataFrame, key: str = "doc_id", part: str = "lang", fields: tuple[str, ...] = FIELDS, forged: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """g (the part, never null), key, leaf and other: the digest with the forged fields on the rows that `where` names, else null."""
    own = digest([F.col(c) for c in fields])
    false = digest([(forged or {}).get(c, F.col(c)) for c in fields])
    part = F.col(part).cast("string")
    return docs.select(
        F.coalesce(F.concat(F.lit("="), part), F.lit("-")).alias("g"),
        F.col(key).alias("key"),
        own.alias("leaf"),
        (F.when(where, false) if where is not None else F.lit(None).cast("string")).alias("other"),
    )


def placed(leaf: DataFrame) -> DataFrame:
    """leaf(g, key, leaf, other) with i, the place in the part, and n, the part's size; no task holds a part.

    Rows are sorted in ranges; a row for each range and part tells how many rows lie before it.
    """
    rows = stash(leaf.withColumn("row", F.monotonically_increasing_id()))
    order = [F.asc("g"), F.asc_nulls_first("key"), F.asc("leaf"), F.asc("row")]
    rows = stash(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()).drop("row"))
    run, place = F.shiftright("at", 33).alias("run"), F.col("at").bitwiseAND((1 << 33) - 1)
    whole = Window.partitionBy("g")
    before = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("g", run).agg(F.count("*").alias("c"), F.min(place).alias("first"))
    runs = runs.select("g", "run", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    return rows.withColumn("run", run).join(runs, ["g", "run"]).select("g", "key", "leaf", "other", (place + F.col("shift")).alias("i"), "n")


@cache
def engine():
    """DuckDB in memory, one for each Python worker."""
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def height(n: int, levels: int) -> int:
    """Levels that a block of a part of n leaves goes up."""
    up = 0
    while n > 1 and up < levels:
        n, up = -(-n // FAN), up + 1
    return up


def _levels(up: int) -> str:
    """Node tables l0 to l<up> of the registered leaves."""
    steps = [f"l{k + 1} AS (SELECT i // {FAN} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l{k} GROUP BY 1)" for k in range(up)]
    return "WITH " + ", ".join(["l0 AS (SELECT i, leaf AS h FROM leaves)", *steps])


def _run(block: pa.Table, sql: str, values: list | None = None) -> pa.Table:
    con = engine()
    con.register("leaves", block)
    try:
        return con.sql(sql, params=values or []).to_arrow_table()
    finally:
        con.unregister("leaves")


def _block_sql(up: int, outer: int) -> str:
    """Leaves with their folded root and the digest of their siblings; parameters: each outer level's left and right siblings, then all of them."""
    run = f"PARTITION BY i // {FAN} ORDER BY i ROWS BETWEEN"
    beside = [
        f"m{k} AS (SELECT i, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM l{k})"
        for k in range(up)
    ]
    folded, joins = "coalesce(x.other, x.leaf)", ""
    for k in range(up):
        folded = f"sha256(m{k}.pre || {folded} || m{k}.post)"
        joins += f" JOIN m{k} ON m{k}.i = x.i // {FAN**k}"
    for k in range(outer):
        folded = f"sha256(${2 * k + 1} || {folded} || ${2 * k + 2})"
    siblings = " || ".join([f"m{k}.pre || m{k}.post" for k in range(up)] + [f"${2 * outer + 1}"])
    return f"{', '.join([_levels(up), *beside])} SELECT x.key, x.leaf, {siblings} AS siblings, {folded} AS folded FROM leaves x{joins}"


def climb(nodes: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(g, h) of the top of each tree over nodes(g, i, h, n), and for each level (g, i, pre, post): what stands left and right of a node in its run.

    most is the largest number of nodes of a tree; a tree that has come to one node waits for the others.
    """
    levels = []
    while most > 1:
        run = nodes.groupBy("g", F.expr(f"i div {FAN}").alias("up"), "n").agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("run"))  # FAN rows at most
        run = stash(run)
        digests = F.transform("run", lambda x: x["h"])
        member = run.where("n > 1").select("g", F.posexplode("run").alias("at", "own"), digests.alias("hs"))
        around = lambda a, b: F.array_join(F.slice("hs", a, b), "")
        levels.append(member.select("g", F.col("own.i").alias("i"), around(F.lit(1), F.col("at")).alias("pre"), around(F.col("at") + 2, F.lit(FAN)).alias("post")))
        h = F.when(F.col("n") > 1, F.sha2(F.array_join(digests, ""), 256)).otherwise(F.col("run")[0]["h"])
        nodes = run.select("g", F.col("up").alias("i"), h.alias("h"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"))
        most = -(-most // FAN)
    return nodes.select("g", "h"), levels


def _outer(blocks: DataFrame) -> DataFrame:
    """g, block, path (left and right siblings above the block, level by level), subroot and root for blocks(g, block, h, n)."""
    nodes = blocks.select("g", F.col("block").alias("i"), "h", "n")
    most = nodes.agg(F.max("n")).first()[0] or 0
    subroots, below = climb(nodes, most)
    subroots = stash(subroots)
    parts = stash(with_position(subroots, ["g"], "place"))
    count = parts.count()
    roots, above = climb(parts.select(F.lit("").alias("g"), F.col("place").alias("i"), "h", F.lit(count).cast("long").alias("n")), count)

    def up(rows: DataFrame, key: str, levels: list[DataFrame], tree: Column) -> DataFrame:
        for k, level in enumerate(levels):
            step = level.select(F.col("g").alias("tree"), F.col("i").alias("node"), F.struct("pre", "post").alias("step"))
            rows = rows.withColumn("node", F.expr(f"{key} div {FAN**k}")).withColumn("tree", tree).join(step, ["tree", "node"], "left")
            rows = rows.withColumn("path", F.when(F.col("step").isNull(), F.col("path")).otherwise(F.concat("path", F.array("step")))).drop("tree", "node", "step")
        return rows

    empty = F.expr("cast(array() as array<struct<pre: string, post: string>>)")
    part = up(parts.select("g", "place", F.col("h").alias("subroot"), empty.alias("path")), "place", above, F.lit(""))
    part = stash(part.join(roots.select(F.col("h").alias("root")), F.lit(True)).select("g", F.col("path").alias("top"), "subroot", "root"))  # one root
    block = up(blocks.select("g", "block", empty.alias("path")), "block", below, F.col("g"))
    return block.join(part, "g").select("g", "block", F.concat("path", "top").alias("path"), "subroot", "root")


def manifest(leaf: DataFrame, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of leaf(g, key, leaf, other).

    proof_sha256 is the digest of all siblings of a leaf, level by level to the root, left to right;
    folded_root is worked out from other (where it isn't null, else from leaf) and these siblings,
    and verified tells whether it is the root. With proofs, the siblings themselves come as text.
    """
    size = FAN**levels
    rows = stash(placed(leaf).withColumn("block", F.expr(f"i div {size}")))

    def top(key, block):
        up = height(block["n"][0].as_py(), levels)
        h = _run(block, f"{_levels(up)} SELECT h FROM l{up}")["h"][0].as_py()
        return pa.table({"g": [key[0].as_py()], "block": [key[1].as_py()], "h": [h], "n": [block["n"][0].as_py()]})

    tops = rows.select("g", "block", "i", "leaf", "n").groupBy("g", "block").applyInArrow(top, "g string, block long, h string, n long")
    tops = stash(tops.withColumn("n", F.expr(f"(n + {size - 1}) div {size}")))
    outer = _outer(tops)
    kind = leaf.schema["key"].dataType.simpleString()

    def prove(key, block, above):
        up = height(block["n"][0].as_py(), levels)
        path = above["path"][0].as_py()
        values = [x for step in path for x in (step["pre"], step["post"])] + ["".join(step["pre"] + step["post"] for step in path)]
        root = above["root"][0].as_py()
        sql = f"SELECT key, leaf, ${len(values) + 1} AS subroot, ${len(values) + 2} AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = ${len(values) + 2} AS verified{', siblings' if proofs else ''} FROM ({_block_sql(up, len(path))})"
        return _run(block, sql, [*values, above["subroot"][0].as_py(), root])

    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", siblings string" if proofs else "")
    return rows.groupBy("g", "block").cogroup(outer.groupBy("g", "block")).applyInArrow(prove, schema)


def tampering(key: str = "doc_id", text: str = "text") -> tuple[dict[str, Column], Column]:
    """Forged fields and the rows they stand on: A-Z lower-cased where 3 divides the CRC-32 of the key; null keys and texts stay."""
    return {text: F.translate(F.col(text), UPPER, LOWER)}, F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 0, F.lit(False))


def study(docs: DataFrame) -> DataFrame:
    """The manifest of documents, folded from tampered texts where `tampering` says so."""
    forged, where = tampering()
    return manifest(leaves(docs, forged=forged, where=where)).withColumnRenamed("key", "doc_id")
