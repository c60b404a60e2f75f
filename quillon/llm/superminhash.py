"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

A document's set holds the distinct runs of `words` words (A-Z lower-cased, words split at
ASCII white space); shorter texts have their whole sequence as the one member; a null text
or one without words has the empty set and is linked with nothing. Documents are linked if
100 * |intersection| >= 100 * threshold * |union|, checked on the full sets. Rows that share
a doc_id count as one document; a row without doc_id is linked with nothing and stays. Texts of
any length are read whole; of equal sets the smallest doc_id stands for the class. Extra columns
are ignored.

Plan: equal sets are collapsed to one class first. Of every band bucket only the pairs
(pivot, member) are verified, so a bucket of n costs n - 1. What stays apart within a bucket
of three or more is then compared completely, in blocks of bounded size whose rows do not
leave the block; only links of a spanning forest come out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, components, forest, stash
from .hashing import U, Words, chunks, mix, shingles

REGISTERS, ROWS, BANDS = 256, 6, 42
#: Signature likeness below which a pair is not looked at: over five standard errors under 0.8.
SLACK = 0.14


def distinct_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    w = Words(texts)
    s, off = shingles(w.hashes(), w.offsets, words)
    return [np.unique(s[off[i] : off[i + 1]]) for i in range(len(texts))]


def _rank(x: np.ndarray, level: int) -> np.ndarray:
    """Register that each element takes at a level: a keyed bijection of 0..255, so no element repeats a register."""
    k = mix(x ^ U(0x5851F42D4C957F2D))
    y = (U(level) * (k | U(1)) + (k >> U(8))) & U(255)
    y ^= y >> U(4)
    y = (y * ((k >> U(16)) | U(1)) + (k >> U(24))) & U(255)
    y ^= y >> U(4)
    return ((y * ((k >> U(32)) | U(1)) + (k >> U(40))) & U(255)).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash of each set: register = smallest level + fraction over the elements.

    At level j an element reaches the register that its permutation has at place j with the
    value j + r. Levels go up, so a set is done as soon as all its registers are reached.
    """
    reg = np.full(len(sets) * REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    x = np.concatenate(sets) if sets else np.zeros(0, dtype=U)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for level in range(REGISTERS):
        if not len(x):
            break
        fraction = (mix(x + U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(40)).astype(np.uint32)
        np.minimum.at(reg, row * REGISTERS + _rank(x, level), np.uint32(level << 24) | fraction)
        todo = (reg.reshape(-1, REGISTERS) == 0xFFFFFFFF).any(axis=1)[row]
        if not todo.all():
            x, row = x[todo], row[todo]
    return reg.reshape(-1, REGISTERS)


def bands(sig: np.ndarray, rows: int = ROWS, count: int = BANDS) -> np.ndarray:
    s = sig[:, : rows * count].reshape(len(sig), count, rows).astype(U)
    weights = mix(np.arange(1, rows + 1, dtype=U)) | U(1)
    return mix((s * weights).sum(axis=2, dtype=U) + np.arange(count, dtype=U) * U(0xD1B54A32D192ED03)).view(np.int64)


def _sketch(words: int):
    def run(batches):
        for b in batches:
            for first, texts in chunks(b.column("text").to_pylist()):
                sets = distinct_sets(texts, words)
                sig = signatures(sets)
                keys = bands(sig)
                n = len(texts)
                flat = pa.array(keys.ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(first, n),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), flat),
                        pa.array([r.tobytes() for r in (sig & 255).astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "bands", "sig"],
                )

    return run


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From the low bytes of the registers; one in 256 agrees by chance."""
    return ((a == b).mean(axis=-1) * 256 - 1) / 255


def _bytes2d(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1 if len(column) else REGISTERS)


def _alike(floor: float):
    def run(batches):
        for p in batches:
            if len(p):
                p = p[_likeness(_bytes2d(p["sig_a"]), _bytes2d(p["sig_b"])) >= floor]
            yield p[["a", "b"]]

    return run


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < round(100 * threshold) * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= round(100 * threshold) * (len(x) + len(y) - both)


def _verify(words: int, threshold: float):
    def run(batches):
        for p in batches:
            keep = []
            for i in range(0, len(p), 100):
                q = p.iloc[i : i + 100]
                sets = distinct_sets([(t or "").encode("utf-8", "surrogatepass") for t in (*q["text_a"], *q["text_b"])], words)
                keep += [_linked(sets[k], sets[len(q) + k], threshold) for k in range(len(q))]
            yield p.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return run


def _blocks(members: DataFrame, size: int) -> DataFrame:
    """Deal members(key, rep, comp, ...) so that every two of a key that are apart meet in a group (key, lo, hi).

    Members of the key's largest component need not meet each other: they are dealt to
    blocks once for each block of the others, and those to each block of the largest.
    """
    sizes = members.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("m"), F.sum("count").alias("n"))
    sizes = sizes.select("key", F.col("m.comp").alias("main"), F.ceil(F.col("m.count") / size).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("m.count")) / size).cast("int").alias("others")).where("others > 0")
    dealt = members.join(sizes, "key")

    def block(many):
        return F.pmod(F.xxhash64("rep"), F.col(many)).cast("int")

    def upto(many):
        return F.sequence(F.lit(0), F.col(many) - 1)

    own = F.transform(upto("others"), lambda i: F.struct(i.alias("lo"), block("mains").alias("hi")))
    meets = F.transform(upto("mains"), lambda j: F.struct(block("others").alias("lo"), j.alias("hi")))
    beside = F.filter(upto("others"), lambda i: i != block("others"))
    beside = F.transform(beside, lambda i: F.struct(F.least(i, block("others")).alias("lo"), (F.col("mains") + F.greatest(i, block("others"))).alias("hi")))
    groups = F.when(F.col("comp") == F.col("main"), own).otherwise(F.concat(meets, beside))
    return dealt.withColumn("g", F.explode(groups)).select(*members.columns, "g.lo", "g.hi")


def _flag(floor: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rep").reset_index(drop=True)
        sig, comp = _bytes2d(pdf["sig"]), pdf["comp"].to_numpy()
        hit = np.zeros(len(pdf), dtype=bool)
        for i in range(len(pdf)):
            near = (comp != comp[i]) & (_likeness(sig, sig[i]) >= floor)
            hit[i] = near.any()
        return pdf.loc[hit, ["key", "rep"]]

    return run


def _join_apart(words: int, threshold: float, floor: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rep").reset_index(drop=True)
        sets = distinct_sets([(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"]], words)
        sig, rep = _bytes2d(pdf["sig"]), pdf["rep"].tolist()
        group = {c: c for c in pdf["comp"].tolist()}
        comp = pdf["comp"].tolist()

        def find(c):
            while group[c] != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        links = []
        for i in range(1, len(pdf)):
            like = _likeness(sig[:i], sig[i])
            for k in np.argsort(-like, kind="stable"):
                if like[k] < floor:
                    break
                a, b = find(comp[i]), find(comp[k])
                if a != b and _linked(sets[i], sets[k], threshold):
                    group[max(a, b)] = min(a, b)
                    links.append((rep[i], rep[k]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def near_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, one row for each row of docs(doc_id, text, ...)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketch = stash(docs.mapInArrow(_sketch(words), "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"))
    classes, links = linked(sketch, docs, words, threshold, threshold - SLACK, block)
    found = components(links).withColumnRenamed("vertex", "rep")

    named = sketch.select("doc_id", "n_shingles", "digest")
    own = named.where("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = named.where("doc_id is not null and digest is not null").join(classes.join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id")), "digest")
    rest = rest.select("doc_id", "n_shingles", "component_id")
    return rest.unionByName(own).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def linked(sketch: DataFrame, docs: DataFrame, words: int, threshold: float, floor: float, block: int = 256) -> tuple[DataFrame, DataFrame]:
    """(digest, rep) of the classes of equal sets, and verified links (a, b) of reps that join all that is linked.

    sketch(doc_id, digest, bands array<long>, sig) should be a table, docs(doc_id, text) has the
    texts. Pairs whose signatures are less alike than floor are not looked at.
    """
    linkable = sketch.where("doc_id is not null and digest is not null")
    classes = linkable.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = stash(linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("x")).select(F.col("x.doc_id").alias("rep"), "x.bands", "x.sig"))
    sigs = reps.select("rep", "sig")
    members = reps.select("rep", F.explode("bands").alias("key"))

    pivots = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep")).alias("p"), F.count("*").alias("n")).where("n > 1").select("key", F.col("p.rep").alias("a"), "n")
    met = stash(members.join(pivots, "key").select("key", "a", F.col("rep").alias("b"), "n"))
    pairs = met.where("a <> b").select("a", "b").distinct()
    pairs = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = stash(pairs.mapInPandas(_alike(floor), "a long, b long"))

    def texts(of: DataFrame, *names: str) -> DataFrame:
        for x in names:
            of = of.join(docs.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")), x)
        return of

    links = stash(texts(pairs, "a", "b").mapInPandas(_verify(words, threshold), "a long, b long"))
    # rows that share a doc_id are one document
    shared = linkable.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    shared = linkable.join(shared, "doc_id").select("doc_id", "digest").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stash(links.union(shared))
    first = components(links)

    # what is still apart in a bucket of three or more
    inside = met.select("key", F.col("b").alias("rep"), "n").where("n > 2").join(first.withColumnRenamed("vertex", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    apart = inside.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("of")).where("lo <> hi")
    apart = apart.groupBy("of").agg(F.min("key").alias("key")).select("key")  # buckets of the same members count once
    inside = stash(inside.join(apart, "key").join(sigs, "rep"))
    flagged = _blocks(inside, 4 * block).groupBy("key", "lo", "hi").applyInPandas(_flag(floor), "key long, rep long").distinct()
    inside = inside.join(flagged, ["key", "rep"])
    inside = inside.drop("n").join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep")
    more = _blocks(inside, block).groupBy("key", "lo", "hi").applyInPandas(_join_apart(words, threshold, floor), "a long, b long")
    return classes, links.union(more)


__all__ = ["near_groups", "signatures", "bands", "distinct_sets", "forest"]
