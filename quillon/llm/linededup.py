"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

A line's tokens are its runs between blanks and tabs; a token with a digit is a variable
field. The tree's levels are the number of tokens and the first three tokens; below them the
remaining tokens form up to four blocks. Templates of a line are the line itself, with its
digit fields generalised, and the line with any one block generalised to a field. A
template is recurring if it stands in at least `min_docs` documents. Of each recurring
template the smallest (doc_id, place) stays, its other lines are dropped.

A null text has no lines and stays null. Blank lines belong to no template and stay, unless
every line with text goes: then the text is empty. Rows equal in doc_id and text count as
one document and are changed alike. Lines and texts of any length are read whole; of lines
that tie in doc_id and place the smaller row hash stays. Other columns pass through, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .decontaminate import once

DEPTH, BLOCKS, MIN_DOCS = 3, 4, 5
FIELD = "<*>"
_DIGITS = r"(?<![^ \t\r])[^ \t\r0-9]*+[0-9][^ \t\r]*"


def _row():
    return F.xxhash64("doc_id", "text")


def template_keys(lines: DataFrame) -> DataFrame:
    """lines(line, ...) with `keys`: hash of the line's tree node, then of its templates, or null for a blank line."""
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", _DIGITS, FIELD)).otherwise(F.col("line"))

    def keys(t):
        n = F.size(t)
        rest = n - DEPTH
        exact = F.xxhash64(n, F.lit(-1), t)
        width = F.ceil(rest / BLOCKS).cast("int")

        def without(j: int):
            # tokens before and after block j; both keep their places, as the block's width follows from n
            return F.xxhash64(n, F.lit(j), F.slice(t, F.lit(1), DEPTH + j * width), F.slice(t, DEPTH + (j + 1) * width + 1, n))

        blocks = [F.when((rest >= 2) & (rest > j * width), without(j)) for j in range(BLOCKS)]
        return F.when(n > 0, F.array_compact(F.array(F.xxhash64(n, F.slice(t, 1, DEPTH)), exact, *blocks)))

    return lines.withColumn("keys", once(F.array_remove(F.split(masked, r"[ \t\r]+"), ""), keys))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """row (see _row), places: the 0-based lines that go, for each document that loses some."""
    # the row's hash is taken before its lines part, so that no line carries the text
    lines = docs.select("doc_id", _row().alias("row"), F.split("text", "\n").alias("lines")).select("doc_id", "row", F.posexplode_outer("lines").alias("place", "line"))
    # outer explodes: for plain ones the optimizer works out the arrays a second time, to filter on their size
    lines = stash(template_keys(lines).select("doc_id", "row", "place", "keys"))
    lines = lines.where("keys is not null").select("doc_id", "row", "place", F.element_at("keys", 1).alias("node"), F.slice("keys", 2, BLOCKS + 1).alias("keys"))
    nodes = lines.groupBy("node").count().where(F.col("count") >= min_docs).select("node")
    keys = stash(lines.join(nodes, "node").select("doc_id", "row", "place", F.explode("keys").alias("key")))
    # a flat minimum is hashed, not sorted: rows of a document stay side by side and shuffle small
    own = keys.groupBy("key", "row", "doc_id").agg(F.min("place").alias("place"))
    met = own.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "place")).alias("first"))
    met = met.where(F.col("n") >= min_docs).select("key", "first.row", "first.place")
    again = keys.alias("k").join(met.alias("m"), "key").where("k.row <> m.row or k.place <> m.place")
    return again.groupBy("k.row").agg(F.collect_set("k.place").alias("places"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """docs with the recurring lines cut from text; with counts, also n_lines and n_dropped (0 for a null text)."""
    gone = dropped_lines(docs.select("doc_id", "text"), min_docs).select(F.col("row").alias("__quillon_row"), F.col("places").alias("__quillon_places"))
    out = docs.withColumn("__quillon_own", _row()).join(gone, F.col("__quillon_own") == F.col("__quillon_row"), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("__quillon_places", i))
    kept = F.when(F.exists(kept, lambda x: F.length(F.trim(x)) > 0), F.array_join(kept, "\n")).otherwise("")
    text = F.when(F.col("__quillon_places").isNull(), F.col("text")).otherwise(kept).alias("text")
    more = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__quillon_places"), F.lit(0)).cast("long").alias("n_dropped")] if counts else []
    return out.select(*[text if c == "text" else F.col(c) for c in docs.columns], *more)
