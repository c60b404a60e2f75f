"""Sequence packing as cutting stock by column generation.

Each document (its token ids, then the end id) is cut into full sequences, half a sequence if
that much is left, and one remainder under a half, so that pieces fit together well.
Pieces fall into length classes, exact for short ones and rounded up above. The class
histogram is a cutting-stock problem: a linear program over patterns (how many of each class
share a sequence) whose columns come from a knapsack dynamic program priced with the duals.
The optimal pattern counts are rounded down, the rest is filled first-fit by decreasing
class. Documents are ranked within their class, and rank ranges of the plan name the
sequence. Only the histogram and the plan reach the driver; both are bounded by the number
of classes, not by the data.

Null texts count as empty: such a document is the end id alone. A text of any length is
encoded whole. Repeated rows are packed each; among pieces of one length class the order is
by a hash of their columns, and rows alike in all of them may change places, which changes
nothing. Extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, stash

CAPACITY, END_ID, TOKENIZER = 2048, 1, "byte_bpe_50k.json"


def class_lengths(capacity: int) -> np.ndarray:
    """Upper lengths of the classes: every length to 64, then steps of 8 up to half the capacity."""
    return np.array([*range(1, min(65, capacity // 2)), *range(72, capacity // 2, 8), capacity // 2])


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: Splitter of byte-level vocabularies.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """The token ids that the tokenizers library gives for whole texts.

    With `special`, strings of special tokens such as <|endoftext|> get their one id, as
    Tokenizer.encode does at its defaults; without, they are ordinary text. Where the vocabulary is byte-level and its merges are in order of id, texts go through
    the same ranks in tiktoken, which gives the same ids sooner; any other vocabulary goes
    through tokenizers.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        byte_level = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab = model.get("vocab", {})
        order = [vocab["".join(m)] for m in merges] if byte_level else [1, 0]
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            order = [1, 0]  # such tokens take blanks along, which ranks do not
        if all(x < y for x, y in zip(order, order[1:], strict=False)):
            import tiktoken

            byte, added = _byte_of(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
            encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added if special else {})
            if special:
                self._encode = lambda texts: [array("I", encoding.encode(t, allowed_special="all")).tobytes() for t in texts]
            else:
                self._encode = lambda texts: [array("I", encoding.encode_ordinary(t)).tobytes() for t in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = not special
            self._encode = lambda texts: [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return self._encode(texts)


_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full sequences first, then a half, then the remainder."""
    arrow_batches(docs.sparkSession, 200)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        own = str(path or tokenizer_path())  # resolved where it is read
        encoder = _encoders.get(own) or _encoders.setdefault(own, Encoder(own, special=True))
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            out: list[tuple] = []
            for d, x in zip(ids, encoder.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                x += end
                n = len(x) // 4
                cuts = [*range(0, n, capacity), n]
                if cuts[-1] - cuts[-2] > capacity // 2 and cuts[-1] - cuts[-2] < capacity:
                    cuts.insert(-1, cuts[-2] + capacity // 2)
                out += [(d, s, e - s, zlib.crc32(x[4 * s : 4 * e]), n) for s, e in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of lengths within the capacity of the largest total value."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths, kind="stable")
    sizes, worth = lengths[order], values[order]
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], take[c] = best[c - 1], -1
        if k := fits[c]:
            v = best[c - sizes[:k]] + worth[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], take[c] = v[i], i
    pattern, c = np.zeros(len(lengths), dtype=np.int64), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[order[take[c]]] += 1
            c -= sizes[take[c]]
    return float(best[capacity]), pattern


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Basic solution of min sum x, patterns @ x = demand (revised simplex): patterns as columns, and x."""
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand
    for step in range(rounds):
        value, p = best_pattern(lengths, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        d = inverse @ p
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = p
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            pivot = inverse[out] / d[out]
            inverse = inverse - np.outer(d, pivot)
            inverse[out] = pivot
        x = np.maximum(inverse @ demand, 0)
    return basis, x


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Runs (cls, first, count, per, sequence): from rank `first` on, `count` pieces lie `per` to a sequence."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[n] for n in lengths.tolist()], dtype=float)
    left = demand.astype(np.int64)
    used: list[tuple[np.ndarray, int]] = []
    if len(lengths):
        basis, x = column_generation(lengths, demand, capacity)
        for j in np.argsort(-x, kind="stable"):
            p = basis[:, j].astype(np.int64)
            times = int(min([np.floor(x[j] + 1e-6), *(left[p > 0] // p[p > 0])]))
            if times > 0:
                left -= times * p
                used.append((p, times))
    while left.any():  # first fit by decreasing length, as many sequences at once as stay alike
        p, room = np.zeros(len(lengths), dtype=np.int64), capacity
        for i in range(len(lengths) - 1, -1, -1):
            p[i] = min(left[i], room // lengths[i])
            room -= p[i] * lengths[i]
        times = int((left[p > 0] // p[p > 0]).min())
        left -= times * p
        used.append((p, times))
    rows, rank, sequence = [], np.zeros(len(lengths), dtype=np.int64), 0
    for p, times in used:
        for i in np.flatnonzero(p):
            rows.append((int(lengths[i]), int(rank[i]), int(times * p[i]), int(p[i]), sequence))
            rank[i] += times * p[i]
        sequence += times
    return pd.DataFrame(rows, columns=["cls", "first", "count", "per", "sequence"])


def ranked(rows: DataFrame, by: str, salt: list[str], size: int = 200) -> DataFrame:
    """rows with `rank` (0, 1, ... within each class in `by`): ranks within bounded salted parts, plus the parts' offsets.

    `by` must have a bounded number of values, as length classes have; the columns of salt must tell
    rows apart, or all rows alike in them meet in one part.
    """
    total = rows.groupBy(by).count()
    parts = rows.join(F.broadcast(total.select(by, F.ceil(F.col("count") / size).cast("int").alias("parts"))), by)  # one row a class
    parts = parts.withColumn("part", F.pmod(F.xxhash64(*salt, F.lit(3)), F.col("parts")).cast("int")).drop("parts")
    counts = parts.groupBy(by, "part").count()
    offsets = counts.withColumn("base", F.sum("count").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select(by, "part", F.coalesce("base", F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy(by, "part").orderBy(*salt)) - 1
    return parts.withColumn("own", own).join(offsets, [by, "part"]).withColumn("rank", F.col("own") + F.col("base")).drop("own", "base", "part")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    all_pieces = stash(pieces(docs, path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    bounds = class_lengths(capacity).tolist()
    cls = F.when(F.col("length") <= 64, F.col("length")).otherwise(F.least(F.ceil(F.col("length") / 8) * 8, F.lit(bounds[-1])))
    rest = all_pieces.where(F.col("length") < capacity).withColumn("cls", cls.cast("long"))
    histogram = {r["cls"]: r["count"] for r in rest.groupBy("cls").count().collect()}  # at most one row a class
    runs = plan(histogram, capacity)
    n_short = int((runs["sequence"] + -(-runs["count"] // runs["per"])).max()) if len(runs) else 0
    keys = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    by_class = {c: g for c, g in runs.groupby("cls")}

    def place(batches):
        for p in batches:
            seq = np.zeros(len(p), dtype=np.int64)
            cls, rank = p["cls"].to_numpy(), p["rank"].to_numpy()
            for c in np.unique(cls):
                g, at = by_class[c], np.flatnonzero(cls == c)
                k = np.searchsorted(g["first"].to_numpy(), rank[at], side="right") - 1
                seq[at] = g["sequence"].to_numpy()[k] + (rank[at] - g["first"].to_numpy()[k]) // g["per"].to_numpy()[k]
            yield p.drop(columns=["cls", "rank"]).assign(sequence_id=seq)

    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    short = ranked(rest, "cls", [*keys, "row"]).select(*cols, "cls", "rank").mapInPandas(place, ", ".join(f"{c} long" for c in [*cols, "sequence_id"]))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *keys).rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    full = all_pieces.where(F.col("length") == capacity).select(*cols, (F.monotonically_increasing_id() + n_short).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(full)

