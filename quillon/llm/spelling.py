"""Spelling variants: words that differ by one code point, found by Aho-Corasick automata of their halves.

If two words differ by one inserted, deleted or replaced code point, one half of each stands unchanged
in the other: the first half at its start or the second half at its end. Shards hold both halves of
their words in an automaton; all words are scanned, and a hit counts if it stands at the right end and
the lengths fit. The distance is then verified on what is left beside the half.

A half has three code points at least, and its end of three points stands at the same end of both
words. So halves are dealt to shards by (which half, its three end points, its class of length), and a
word is scanned by the shards of its own two ends. Ends that very many words share are dealt to several
shards, each of which scans the words of that end.

Counts are made per text and task before they are shuffled. Null texts have no words; a null doc_id
deletes nothing (see `counted`). Texts may have any length: they are read by parts that end between
words. Repeated rows count each. Ties go to the smallest word in code-point order. An empty table has
no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, stash

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
_LOW = {x: x + 32 for x in range(ord("A"), ord("Z") + 1)}
LEAST = 6
#: Code points of a text that are cut into words at once; words a task counts before it hands them on.
PART, HELD = 1 << 20, 200_000
#: Halves of one end that a shard holds, and halves that a shard holds about.
HOT, SHARD = 20_000, 5_000


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART and (m := GAP.search(text, at + PART)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def lower(word: str) -> str:
    """A-Z lower-cased, nothing else."""
    return word.lower() if word.isascii() else word.translate(_LOW)


def deleted(word: str, start: int | None, every: int) -> str:
    """word without a code point, where `every` divides the CRC-32 that goes on from start; as it is without start or every."""
    if start is None or not every:
        return word
    h = zlib.crc32(word.encode(), start)
    if h % every:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 0, least: int = LEAST, times: int = 5) -> DataFrame:
    """word, n: the words of at least `least` code points that occur at least `times` times.

    Words are maximal runs of Latin letters, A-Z lower-cased. With every, a code point is deleted
    from a run where every divides the CRC-32 of `<key>:<run>`; which one, the same number tells.
    """
    arrow_batches(docs.sparkSession)

    def run(batches):
        held: Counter[str] = Counter()
        for pdf in batches:
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                start = None if k is None else zlib.crc32(f"{k}:".encode())
                for part in _parts(t or ""):
                    low: Counter[str] = Counter()
                    for w, n in Counter(RUN.findall(part)).items():
                        low[lower(w)] += n
                    for w, n in low.items():
                        if len(w := deleted(w, start, every)) >= least:
                            held[w] += n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())}, columns=["word", "n"]).astype({"word": str, "n": "int64"})

    rows = docs.selectExpr(f"cast(`{key}` as string) as key", f"`{text}` as text").mapInPandas(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def half(word: str) -> int:
    return len(word) // 2


def one_apart(a: str, b: str) -> bool:
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Rests:
    """What stands beside one half in all words of a shard that have it, by length; `near` verifies the distance of many at once."""

    #: Up to so many are compared one by one.
    FEW = 24

    def __init__(self):
        self.by: dict[int, tuple[list[str], list[int]]] = {}
        self.arrays: dict[int, np.ndarray] = {}

    def add(self, rest: str, word: int) -> None:
        rests, words = self.by.setdefault(len(rest), ([], []))
        rests.append(rest)
        words.append(word)

    def _table(self, n: int) -> np.ndarray:
        if n not in self.arrays:
            self.arrays[n] = _points("".join(self.by[n][0])).reshape(-1, n)
        return self.arrays[n]

    def near(self, rest: str) -> Iterator[int]:
        """Words whose rest is one code point apart from this one."""
        for n in (len(rest) - 1, len(rest), len(rest) + 1):
            if n not in self.by:
                continue
            rests, words = self.by[n]
            if len(rests) <= self.FEW or n == 0:
                yield from (w for r, w in zip(rests, words, strict=True) if one_apart(rest, r))
                continue
            table, own = self._table(n), _points(rest)
            if n == len(rest):
                hit = (table != own).sum(axis=1) == 1
            else:
                short = min(n, len(rest))
                head = np.logical_and.accumulate(table[:, :short] == own[:short], axis=1).sum(axis=1)
                tail = np.logical_and.accumulate((table[:, n - short :] == own[len(own) - short :])[:, ::-1], axis=1).sum(axis=1)
                hit = head + tail >= short
            yield from (words[j] for j in np.flatnonzero(hit))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def automaton(held: list[tuple[str, bool]]):
    """The automaton of halves (word, whether the second): each half has the rests of its first-half and of its second-half words."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (w, second) in enumerate(held):
        m = half(w)
        seg = w[m:] if second else w[:m]
        if seg not in a:
            a.add_word(seg, (len(seg), Rests(), Rests()))
        a.get(seg)[1 + second].add(w[:m] if second else w[m:], i)
    if len(a):
        a.make_automaton()
    return a


def hits(a, held: list[tuple[str, bool]], word: str) -> Iterator[int]:
    """Places in held of the words that are near word; each pair comes from one half only, the first if both stand."""
    for end, (m, firsts, seconds) in a.iter(word):
        if end == m - 1:
            yield from firsts.near(word[m:])
        if end == len(word) - 1:
            for j in seconds.near(word[: len(word) - m]):
                w = held[j][0]
                if word[: half(w)] != w[: half(w)]:  # else the first half finds it
                    yield j


def near(words: DataFrame) -> DataFrame:
    """word, n_near, best (n and word of the near word of largest n, the smallest of them) of words(word, n) that have near words."""
    spark = words.sparkSession
    n = words.count()
    if not n:
        return spark.createDataFrame([], "word string, n_near long, best struct<n: long, word: string>")
    count = max(1, -(-2 * n // SHARD))
    length = F.char_length("word")
    ends = F.array(*[F.struct(F.lit(k).alias("half"), F.substring("word", *at).alias("end")) for k, at in ((0, (1, 3)), (1, (-3, 3)))])
    halves = words.select("word", "n", F.inline(ends)).withColumn("size", F.floor(length / 2).cast("int"))
    hot = halves.groupBy("half", "end", "size").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("half", "end", "size", F.ceil(F.col("c") / HOT).cast("int").alias("ways"))
    hot = stash(hot)  # 2 n / HOT rows at most
    by = ["half", "end", "size"]
    shard = lambda way: F.pmod(F.xxhash64(*by, way), F.lit(count)).cast("int")
    ways = F.coalesce("ways", F.lit(1))
    mine = halves.join(hot, by, "left").withColumn("way", F.pmod(F.xxhash64("word"), ways).cast("int"))
    mine = mine.select(shard(F.col("way")).alias("shard"), "half", "word", "n")
    sizes = F.array_distinct(F.transform(F.array(length - 1, length, length + 1), lambda x: F.floor(x / 2).cast("int")))
    scan = words.select("word", "n", F.inline(ends), F.explode(sizes).alias("size")).where(F.col("size") >= LEAST // 2)
    scan = scan.join(hot, by, "left").withColumn("way", F.explode(F.sequence(F.lit(0), ways - 1)))
    scan = scan.select(shard(F.col("way")).alias("shard"), F.lit(2).alias("half"), "word", "n")

    def find(pdf):
        kind = pdf["half"].to_numpy()
        own = pdf[kind < 2]
        held = list(zip(own["word"], own["half"] == 1, strict=True))
        ns = own["n"].to_numpy()
        a = automaton(held)
        out = []
        for w in pdf["word"][kind == 2].unique() if len(held) else []:
            found = list(hits(a, held, w))
            if found:
                top = min(found, key=lambda j: (-ns[j], held[j][0]))
                out.append((w, len(found), int(ns[top]), held[top][0]))
        return pd.DataFrame(out, columns=["word", "c", "n", "form"])

    part = mine.unionByName(scan).groupBy("shard").applyInPandas(find, "word string, c long, n long, form string")
    least = F.min(F.struct((-F.col("n")).alias("n"), "form"))
    out = part.groupBy("word").agg(F.sum("c").alias("n_near"), least.alias("b"))
    return out.select("word", "n_near", F.struct((-F.col("b.n")).alias("n"), F.col("b.form").alias("word")).alias("best"))


def rooted(links: DataFrame) -> DataFrame:
    """word, root: the last word that follows from links(word, form); forms have ever larger counts, so chains end.

    Every round doubles the length that is followed.
    """
    at = stash(links.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stash(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if step.where("moved").isEmpty():
            return at
        at = step.select("word", "root")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n), each word once.

    form is the near word of largest n (ties: the smallest) if it has at least `times` the word's n,
    root is the last of the forms that follow from one another, the word itself where it has none.
    """
    words = stash(words)
    found = words.join(near(words), "word", "left")
    good = F.col("best.n") >= times * F.col("n")
    found = stash(found.select("word", F.when(good, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.n")).alias("form_n")))
    roots = rooted(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
