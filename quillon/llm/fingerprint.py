"""Document fingerprints: MinHash by universal hash permutations over word shingles.

Each of 128 multiply-shift permutations keeps its minimum over the five-word shingles of a
text (A-Z lower-cased, words split at ASCII white space; a shorter text has its whole
sequence as one shingle). A fingerprint is the low byte of each minimum as hex, the empty
string for a text without words (null counts as empty). Likeness of two fingerprints
estimates the Jaccard similarity of the texts, corrected for the bytes that agree by
chance; two empty ones have likeness 1, an empty and another one 0. Texts of any length are
read whole. Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, stash
from .hashing import U, Words, chunks, mix, shingles
from .superminhash import bands, distinct_sets, linked

PERMUTATIONS, WORDS, BAND_ROWS = 128, 5, 5
#: Fingerprint likeness below the threshold by which a pair is not looked at: over five standard errors under 0.8.
SLACK = 0.19
_A = (mix(np.arange(1, PERMUTATIONS + 1, dtype=U)) | U(1))[:, None]
_B = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=U))[:, None]


def signatures(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(texts, 128) uint32 minima and the number of shingles of each text."""
    w = Words(texts)
    s, off = shingles(w.hashes(), w.offsets, words)
    out = np.zeros((len(texts), PERMUTATIONS), dtype=np.uint32)
    for i in range(len(texts)):
        low = None
        for at in range(off[i], off[i + 1], 2048):
            x = s[at : min(at + 2048, off[i + 1])]
            m = ((_A * x + _B) >> U(32)).min(axis=1)
            low = m if low is None else np.minimum(low, m)
        if low is not None:
            out[i] = low
    return out, np.diff(off)


def likeness(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> float:
    if not na or not nb:
        return float(na == nb)
    return float(min(1.0, max(0.0, (256 * (a == b).mean() - 1) / 255)))


def _hex(sig: np.ndarray, n: int) -> str:
    return sig.astype(np.uint8).tobytes().hex() if n else ""


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, fingerprint for each row of docs(doc_id, text, ...)."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            for first, texts in chunks(b.column("text").to_pylist()):
                sig, n = signatures(texts, words)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(texts)), pa.array(n), pa.array([_hex(x, k) for x, k in zip(sig, n, strict=True)], pa.string())], ["doc_id", "n_shingles", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, fingerprint string")


def _sketch(words: int, rows: int):
    count = PERMUTATIONS // rows

    def run(batches):
        for b in batches:
            for first, texts in chunks(b.column("text").to_pylist()):
                sig, n = signatures(texts, words)
                sets, low = distinct_sets(texts, words), (sig & 255).astype(np.uint8)
                flat = pa.array(bands(low, rows, count).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(first, len(texts)),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if k else None for s, k in zip(sets, n, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * count), flat),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    ["doc_id", "digest", "bands", "sig"],
                )

    return run


def near_classes(docs: DataFrame, threshold: float = 0.8, rows: int = BAND_ROWS, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b, linked pairs of classes, and (doc_id, class) of all rows; a class is the smallest doc_id of equal shingle sets.

    Signature bands are joined and Jaccard is verified on the full texts. Within a band bucket
    each member meets the bucket's pivot, and what stays apart is then compared completely; the
    pairs join all that is linked, not every linked pair is among them. A document without words
    or doc_id is a class of its own.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketch = stash(docs.mapInArrow(_sketch(words, rows), "doc_id long, digest binary, bands array<long>, sig binary"))
    classes, links = linked(sketch, docs, words, threshold, threshold - SLACK)
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links, sketch.select("doc_id", "digest").join(classes, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class"))


def near_links(docs: DataFrame, threshold: float = 0.8, rows: int = BAND_ROWS, words: int = WORDS) -> DataFrame:
    """The linked pairs of near_classes."""
    return near_classes(docs, threshold, rows, words)[0]


def with_classes(study: DataFrame, docs: DataFrame) -> DataFrame:
    """study(doc_id, ...) with class, the smallest doc_id of documents of equal shingle sets, and n_links, the other classes that near_classes links with it.

    Rows that share a doc_id have the smallest class of them; a null doc_id has no class.
    """
    links, members = near_classes(docs)
    links = stash(links)
    count = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    cls = members.where("doc_id is not null").groupBy("doc_id").agg(F.min("class").alias("class"))
    out = study.join(cls, "doc_id", "left").join(count, "class", "left")
    return out.select(*study.columns, "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _signed(texts: list[str], words: int) -> list[tuple[np.ndarray, int]]:
    """Signature and number of shingles of each text."""
    out: list = []
    for _, part in chunks(texts):
        sig, n = signatures(part, words)
        out += zip(sig, n.tolist(), strict=True)
    return out


def _low(sig: np.ndarray, n: int) -> bytes:
    return sig.astype(np.uint8).tobytes() if n else b""


def _keys(signed: list) -> np.ndarray:
    """Band keys of signatures, a row each."""
    return bands(np.stack([sig for sig, _ in signed]) & 255, BAND_ROWS, PERMUTATIONS // BAND_ROWS)


def _verified(a: str, b: str, words: int) -> float:
    """Jaccard similarity of the full shingle sets, which are not both empty."""
    x, y = distinct_sets([t.encode("utf-8", "surrogatepass") for t in (a, b)], words)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _study(texts: list[str], after: list[str], prints: list, words: int) -> list[tuple]:
    """n_chars, SHA-256 of the edited text, both fingerprints, near_edited, near_next, jaccard_edited, jaccard_next; prints are those of texts and, one place on, of after."""
    if not texts:
        return []
    out = []
    edits = [_edited(t, a) for t, a in zip(texts, after, strict=True)]
    signed = _signed(edits, words)
    mine, changes = _keys(prints), _keys(signed)
    shared = np.stack([(mine[:-1] == changes).any(axis=1), (mine[:-1] == mine[1:]).any(axis=1)], axis=1).tolist()
    for t, e, f, (own, n), (changed, m), (following, k), meets in zip(texts, edits, after, prints[: len(texts)], signed, prints[1:], shared, strict=True):
        digest = hashlib.sha256(e.encode("utf-8", "surrogatepass")).digest()
        exact = [_verified(t, other, words) if n and size and near else None for other, size, near in ((e, m, meets[0]), (f, k, meets[1]))]
        out.append((len(t), digest, _low(own, n), _low(changed, m), likeness(own & 255, n, changed & 255, m), likeness(own & 255, n, following & 255, k), *exact))
    return out


#: Columns of a study: those of an ordinary row, then what marks the first and the last row of a range.
_STUDY = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("jaccard_edited", pa.float64()), ("jaccard_next", pa.float64())]
    + [("range", pa.int64()), ("place", pa.string()), ("text", pa.string())]
)
_STUDY_DDL = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, jaccard_edited double, jaccard_next double, range long, place string, text string"


def _ranges(words: int):
    """Over a range in descending doc_id: the study of all rows but the last, and the texts of the first and the last."""

    def run(batches):
        part = TaskContext.get().partitionId()
        held: tuple | None = None  # the row that waits for its next one: doc_id, text, print

        def mark(place: str, doc_id, text: str):
            return pa.RecordBatch.from_pylist([{"doc_id": doc_id, "range": part, "place": place, "text": text}], schema=_STUDY)

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            if not ids:
                continue
            prints = _signed(texts, words)
            if held is None:
                yield mark("first", ids[0], texts[0])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], [held[2], *prints]
            held = ids[-1], texts[-1], prints[-1]
            rows = _study(texts[:-1], texts[1:], prints, words)
            if rows:
                n = len(rows)
                columns = [pa.array(c, t) for c, t in zip([ids[:-1], *zip(*rows, strict=True), [part] * n, [None] * n, [None] * n], _STUDY.types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=_STUDY)
        if held is not None:
            yield mark("last", held[0], held[1])

    return run


def _seams(words: int):
    """The study of rows(doc_id, text, following)."""

    def run(batches):
        for b in batches:
            texts, after = b.column("text").to_pylist(), b.column("following").to_pylist()
            rows = [x for t, a in zip(texts, after, strict=True) for x in _study([t], [a], _signed([t, a], words), words)]
            if rows:
                columns = [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STUDY.types[1:9], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=_STUDY.names[:9])

    return run


def edit_study(docs: DataFrame, per_range: int | None = None, words: int = WORDS) -> DataFrame:
    """Fingerprint every text and its edited form, and compare with the next document's.

    The next document is the one of the next smaller doc_id (after the last: of the largest).
    Rows are dealt once, to sorted ranges of doc_id, which are read as a stream: a task holds one
    batch, however large its range. The last row of a range meets the first one of the next range
    in a join of one row a range. Where two signatures share a band, jaccard_edited and
    jaccard_next give the similarity of the full shingle sets, else they are null. Null doc_ids follow all others; rows of equal doc_id are
    ordered by their text. per_range sets the number of ranges; without it Spark sizes them.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 400)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    ranges = docs.repartitionByRange(order) if per_range is None else docs.repartitionByRange(max(1, -(-docs.count() // per_range)), order)
    rows = stash(ranges.sortWithinPartitions(order, "text").mapInArrow(_ranges(words), _STUDY_DDL))
    ends = {place: rows.where(F.col("place") == place).select("range", "doc_id", "text") for place in ("first", "last")}
    # numbers of ranges only, one row each: the window may be read by one task
    by_range = Window.orderBy("range")
    following = ends["first"].select("range").withColumn("next", F.coalesce(F.lead("range").over(by_range), F.min("range").over(by_range)))
    seams = ends["last"].join(following, "range").join(ends["first"].select(F.col("range").alias("next"), F.col("text").alias("following")), "next")
    seams = seams.select("doc_id", "text", "following").mapInArrow(_seams(words), ", ".join(_STUDY_DDL.split(", ")[:9]))
    study = rows.where("place is null").select(seams.columns).unionByName(seams)
    return study.select(*[F.lower(F.hex(c)).alias(c) if t == "binary" else F.col(c) for c, t in study.dtypes])
