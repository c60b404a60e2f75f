"""Repeated passages by content-defined chunking with a gear rolling hash.

The gear hash of a position sums a random value for each of the last bytes, shifted by its
distance; a chunk ends where its low 16 bits are small and no such place lies within the
last `least` bytes. As the rule looks at a short window only, insertions move no later boundary.
Each text starts the hash afresh, so equal texts have equal chunks wherever they stand. Ends
move on to the next character, so no chunk cuts one.
Chunks are compared by digest; neighbouring chunks that also occur in another document merge
into a span. What repeats within one document only is not reported. Spans of at least `min_words` words
whose every chunk occurs again are reported; a span of which half or more of the bytes are
the smallest (doc_id, start) occurrence of their chunk counts as the original.

Null or empty texts, and texts that repeat nothing, give no rows. A text of any length is cut
whole. Of equal smallest places the one of the smallest doc_id counts. Rows that share a doc_id
count as one document of that id each; equal texts are repeated as a whole. A row without
doc_id takes no part. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, stash
from .hashing import U, Words, chunks, mix

#: A chunk ends at one position in 24 on average, at least 8 bytes after the last candidate.
ONE_IN, WINDOW, LEAST = 24, 16, 8
MIN_WORDS = 20
#: A run without any boundary is cut every so many bytes.
LONGEST = 2000
_GEAR = (mix(np.arange(5001, 5257, dtype=U)) >> U(32)).astype(np.uint32)


def boundaries(buffer: np.ndarray, starts: np.ndarray, one_in: int = ONE_IN, least: int = LEAST) -> np.ndarray:
    """Positions at which a chunk ends (the byte belongs to the chunk); no text sees the one before its start."""
    h = _GEAR[buffer]
    step = 1
    while step < WINDOW:  # after each round h sums the last 2 * step bytes, each shifted by its distance
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint32(step)
        before = (starts[:, None] + np.arange(step)).ravel()  # their windows reach over the start
        shifted[before[before < len(h)]] = 0
        h = h + shifted
        step *= 2
    # the low 16 bits depend on the last 16 bytes and on none before
    at = np.flatnonzero((h & np.uint32(0xFFFF)) < 0x10000 // one_in)
    if len(at):
        text = np.searchsorted(starts, at, side="right")
        at = at[np.concatenate(([True], (np.diff(at) >= least) | (np.diff(text) > 0)))]
    return at


def _to_character(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The positions, moved on to the next start of a UTF-8 character."""
    for _ in range(3):
        at = at + ((buffer[np.minimum(at, len(buffer) - 1)] & 0xC0) == 0x80)
    return at


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, start, end (byte offsets in the text) and digest of every chunk of a batch."""
    w = Words(texts, b"")
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
    cut = boundaries(w.buffer, starts) + 1
    cut = cut[~np.isin(cut - 1, ends)]  # the separators belong to no text
    cut = _to_character(w.buffer, cut)
    stop = np.unique(np.concatenate([cut, ends]))
    gaps = np.diff(np.concatenate(([-1], stop)))
    if (gaps > LONGEST).any():  # text without boundaries, such as one byte repeated
        more = np.concatenate([np.arange(stop[i] - gaps[i] + LONGEST, stop[i], LONGEST) for i in np.flatnonzero(gaps > LONGEST)])
        stop = np.unique(np.concatenate([stop, _to_character(w.buffer, more)]))
    doc = np.searchsorted(ends, stop, side="left")
    keep = (doc < len(texts))
    stop, doc = stop[keep], doc[keep]
    begin = np.maximum(np.concatenate(([0], stop[:-1])), starts[doc])
    full = begin < np.minimum(stop, ends[doc])
    doc, begin, stop = doc[full], begin[full], np.minimum(stop, ends[doc])[full]
    return doc, begin - starts[doc], stop - starts[doc], w.span(begin, stop)


#: A chunk's place in one long: start (36 bits), length (16 bits), words begun (11 bits).


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, place (start, length and words of the chunk, see _unpacked), digest."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            for first, texts in chunks(b.column("text").to_pylist()):
                doc, start, end, digest = split(texts)
                if not len(doc):
                    continue
                w = Words(texts)
                base = w.text_start[doc]
                words = np.searchsorted(w.start, base + end) - np.searchsorted(w.start, base + start)
                place = (start.astype(np.int64) << 27) | ((end - start).astype(np.int64) << 11) | words
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)).take(pa.array(doc)), pa.array(place), pa.array(digest.view(np.int64))], ["doc_id", "place", "digest"])

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(run, "doc_id long, place long, digest long")


def _unpacked(place: str = "place"):
    start = F.shiftright(place, 27)
    return start, start + F.shiftright(place, 11).bitwiseAND(0xFFFF), F.col(place).bitwiseAND(0x7FF)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end (bytes of UTF-8), n_chunks, n_words, first_doc_id, original: one row for each repeated span.

    Texts are cut once; the chunks' places are written. They are dealt by digest twice, to count them
    and to find the repeated ones again; both are a sum or a join, so a passage that a third of all
    documents share is split.
    """
    c = stash(chunked(docs))
    met = c.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"), F.min(F.struct("doc_id", "place")).alias("first")).where("n > 1 and last <> first.doc_id").select("digest", "first")
    start, end, words = _unpacked()
    hits = c.join(met, "digest").select("doc_id", start.alias("start"), end.alias("end"), words.alias("words"), F.col("first.doc_id").alias("first_doc_id"), ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.place") == F.col("place"))).alias("own"))
    # islands of neighbouring chunks within a document
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("new", F.when(F.coalesce(seen, F.lit(-1)) >= F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.col("end") - F.col("start")
    runs = hits.groupBy("doc_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.sum("words").alias("n_words"), F.min("first_doc_id").alias("first_doc_id"), (2 * F.sum(F.when(F.col("own"), size).otherwise(0)) >= F.sum(size)).alias("original")
    )
    return runs.where(F.col("n_words") >= min_words).drop("run")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with every repeated span cut out of its text, except the originals; other columns as they were."""
    spans = repeated_spans(docs, min_words).where("not original").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut"))
    out = docs.columns

    @F.pandas_udf("string")
    def without(text: pd.Series, cut: pd.Series) -> pd.Series:
        def one(t, spans):
            if t is None or spans is None:
                return t
            b, at, kept = t.encode("utf-8", "surrogatepass"), 0, []
            for s in spans:
                kept.append(b[at : max(at, s["start"])])
                at = max(at, s["end"])
            return b"".join([*kept, b[at:]]).decode("utf-8", "ignore")

        return pd.Series([one(t, s) for t, s in zip(text, cut, strict=True)], dtype=object)

    spans = spans.withColumnRenamed("cut", "_cut").withColumnRenamed("doc_id", "_id")
    return docs.join(spans, F.col("doc_id") == F.col("_id"), "left").withColumn("text", without("text", "_cut")).select(*out)
