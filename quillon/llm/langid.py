"""Language identification by compression: the language whose dictionary shortens a text most.

For each language a zstandard raw-content dictionary is cut from a bounded sample of its
labelled texts. A text is encoded whole, piece by piece, with every dictionary; the smallest
total names the language. score is the gain over the runner-up, relative to the gain that
the dictionary gave at all, from 0 (a tie) to 1. A null text or one without a letter gets
`und` and score 0. Ties go to the first language in code-point order. With no labelled
language at all every text is `und`. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches

UND = "und"
LETTER = regex.compile(r"\p{L}")
#: Bound of the sample that the dictionaries are cut from: rows a language, and bytes kept of them.
SAMPLE_ROWS, DICT_BYTES = 120, 32 * 1024
#: Texts are encoded in pieces of so many bytes: a long text's own content must not outweigh the dictionary.
PIECE, LEVEL = 4096, 5
#: A score under this is a narrow margin: filtering callers reject such texts.
MARGIN = 0.01


def train(labelled: DataFrame, lang: str = "lang", rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Raw-content dictionaries from the `rows` texts of smallest hash in each language, all if it has fewer.

    Copies are collapsed by their hash first, so a language has a dictionary however often its
    texts repeat, and copies do not meet in one task. The driver receives about 2 * rows texts a
    language. Rows without text or language are left out; empty input gives no dictionary.
    """
    known = labelled.select(F.col(lang).alias("lang"), "text").where("lang is not null and length(text) > 0")
    known = known.withColumn("h", F.xxhash64("text", F.lit(11)))
    counts = known.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    picked = known.join(F.broadcast(counts), "lang").where(share < 2.0 * rows / F.col("n")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    texts: dict[str, list] = {}
    for r in picked.collect():
        texts.setdefault(r["lang"], []).append((r["h"] % (1 << 40), r["h"], r["text"]))
    return {lang: build(t for *_, t in sorted(found)[:rows]) for lang, found in texts.items()}


def build(texts, size: int = DICT_BYTES) -> bytes:
    """Equal shares of the texts, each a middle run, up to the size of the dictionary."""
    texts = [t.encode("utf-8", "surrogatepass") for t in texts]
    total = sum(map(len, texts))
    share = size if total <= size else max(256, 2 * size // max(1, len(texts)))
    out = b" ".join(t if len(t) <= share else t[(len(t) - share) // 2 : (len(t) + share) // 2] for t in texts)
    return out[-size:]


class Encoder:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self._with = []
        for lang in self.langs:
            raw = dictionaries[lang] or b" "
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            p = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=len(raw), write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=p)
            self._with.append(zstd.ZstdCompressor(compression_params=p, dict_data=d).compress)

    def sizes(self, text: bytes) -> list[int]:
        n = max(1, -(-len(text) // PIECE))
        step = -(-len(text) // n)
        pieces = [text[i : i + step] for i in range(0, len(text), step)]
        return [sum(len(f(p)) for p in pieces) for f in self._with]

    def classify(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return UND, 0.0
        raw = text.lower().encode("utf-8", "surrogatepass")
        sizes = self.sizes(raw)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[best], 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        gain = max(1, max(sizes) - sizes[best])
        return self.langs[best], max(0.0, min(1.0, (second - sizes[best]) / gain))


def teller(spark: SparkSession, dictionaries: dict[str, bytes]):
    """A column function: text -> struct(lang_pred, score)."""
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast({k: v.decode("utf-8", "ignore").lower().encode() for k, v in dictionaries.items()})  # a few dozen KB a language

    @F.pandas_udf("lang_pred string, score double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for texts in batches:
            found = [encoder.classify(t) for t in texts]
            yield pd.DataFrame({"lang_pred": pd.Series([x for x, _ in found], dtype=object), "score": pd.Series([float(x) for _, x in found], dtype="float64")})

    return told


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
