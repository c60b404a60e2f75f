"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

A text's words are its lower-cased runs between ASCII white space; its shingles are the
distinct runs of five words (a shorter text: its whole sequence as one, no words: none). An
item leaks into a document that holds at least `threshold` of its shingles.

Items are partitioned by the power of two of their size. An item's signature is its bottom-k
MinHash: of its n shingles the n - ceil(threshold * n) + 1 smallest hashes. A document that
holds enough of the item must hold one of these, so the search misses nothing. Documents are
searched partition by partition: only for partitions whose smallest item they are large
enough to hold, and there only with shingles up to the partition's largest signature hash.
Candidates of a partition are verified on the exact shingles.

Null or wordless items and documents never match. A text of any length is read whole. Repeated
rows give repeated pairs; ids may be null, such rows take no part. There are no ties: every
item that leaks is reported. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import once
from .common import stash

WORDS, THRESHOLD = 5, 0.8
#: Tables up to so many rows and bytes are broadcast; beyond, the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def words(text: str):
    return F.array_remove(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), "")


def _runs(w, k: int, make):
    n = F.size(w)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: make(F.slice(w, i, k)))).when(n > 0, F.array(make(w)))


def shingles(text, k: int):
    """The distinct runs of k words, as strings: words hold no blank."""
    return once(words(text), lambda w: F.array_distinct(_runs(w, k, lambda r: F.array_join(r, " "))))


def hashed(k: int):
    """Hashes of all runs of k words of `text`: each word is hashed once, a run from the hashes of its words."""
    return once(once(words("text"), lambda w: F.transform(w, lambda x: F.xxhash64(x))), lambda w: _runs(w, k, lambda r: F.xxhash64(r)))


def _key(h, part):
    """A partition's own value of a hash: only shingles that were dealt to the partition meet its signatures."""
    return h.bitwiseXOR(F.shiftleft(F.lit(part) if isinstance(part, int) else part, 1).cast("long"))


def _bounded(df: DataFrame, rows: int, size: int) -> DataFrame:
    """df to be broadcast if its rows and bytes are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """item_id, doc_id, n_shingles (of the item), n_shared, containment: one row for each leaked item of a document."""
    percent = round(100 * threshold)
    sets = items.where("item_id is not null").select("item_id", shingles("text", k).alias("runs"), hashed(k).alias("hashes")).where(F.size("runs") > 0)
    sets = stash(sets.withColumn("n_shingles", F.size("runs").cast("long")))
    need = F.expr(f"cast((n_shingles * {percent} + 99) div 100 as int)")
    signature = F.slice(F.array_sort(F.array_distinct("hashes")), F.lit(1), (F.col("n_shingles") - need + 1).cast("int"))
    sketch = stash(sets.select("item_id", F.floor(F.log2("n_shingles")).cast("int").alias("part"), need.alias("need"), F.explode(signature).alias("h")))
    parts = sketch.groupBy("part").agg(F.max("h").alias("top"), F.min("need").alias("least"), F.count("*").alias("n")).collect()  # one row a power of two
    rows = sum(r["n"] for r in parts)
    if not rows:
        return sets.select("item_id", F.col("item_id").alias("doc_id"), "n_shingles", F.col("n_shingles").alias("n_shared"), F.lit(0.0).alias("containment")).limit(0)

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")

    def searched(runs, near, rest):
        """Keys (see _key) of the hashes that each partition looks at; partitions of lower bounds read what is left of the higher."""
        (part, top, least), *lower = rest

        def keys(low):
            own = F.when(F.size(runs) >= least, F.transform(low, lambda h: _key(h, part))).otherwise(F.array().cast("array<long>"))
            return F.concat(own, searched(runs, low, lower)) if lower else own

        return once(F.filter(near, lambda h: h <= top), keys)

    bounds = sorted(((r["part"], r["top"], r["least"]) for r in parts), key=lambda x: -x[1])
    runs = docs.select("doc_id", hashed(k).alias("runs"))
    # outer explodes: for plain ones the optimizer works out the arrays a second time, to filter on their size
    joined = runs.select("doc_id", F.size("runs").alias("size"), F.explode_outer(once(F.col("runs"), lambda r: searched(r, r, bounds))).alias("key"))
    keyed = sketch.select("item_id", "need", _key(F.col("h"), F.col("part")).alias("key"))
    pairs = joined.join(_bounded(keyed, rows, 24 * rows), "key").where("size >= need").select("item_id", "doc_id").distinct()
    pairs = stash(pairs)
    wanted = pairs.select("doc_id").distinct()
    some = wanted.count()
    held = docs.join(_bounded(wanted, some, 16 * some), "doc_id", "left_semi")
    held = held.select("doc_id", shingles("text", k).alias("held"))
    # all shingles of all items: far more than the signatures
    held_bytes = sets.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + F.octet_length(r) + 24) + 8 * F.size("hashes") + 64)).first()[0]
    found = pairs.join(held, "doc_id").join(_bounded(sets, rows, held_bytes), "item_id")
    found = found.withColumn("n_shared", F.size(F.array_intersect("runs", "held")).cast("long"))
    found = found.where(F.col("n_shared") >= need)
    return found.select("item_id", "doc_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """docs without those that hold a benchmark item; rows without doc_id stay."""
    hit = leaks(docs, items, threshold, k).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
