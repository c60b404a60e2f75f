"""Corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last keep the columns
of docs, whatever their names. Between stages the frame is written as Parquet and read again.
Nulls may stand in any column, rows may repeat, the table may be empty (the result is then
empty), texts may have any length; each stage says what becomes of such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, langid, linededup, packing, superminhash
from quillon.llm.common import stash, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: null and empty texts, texts without a letter and narrow margins go; equal texts go or stay alike."""
    dictionaries = langid.train(docs.where(~F.coalesce(langid.held_out(), F.lit(False))))
    told = docs.withColumn("__quillon_told", langid.teller(spark, dictionaries)("text"))
    return told.where((F.col("__quillon_told.lang_pred") != langid.UND) & (F.col("__quillon_told.score") >= langid.MARGIN)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; so do documents whose text is empty or had only such lines. n_chars follows the text.

    A null text stays. Of equal lines that of the smallest (doc_id, place) stays; rows equal in doc_id
    and text are changed alike.
    """
    out = linededup.dedup(docs).where("text is null or text <> ''")
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates stays.

    Null and wordless texts and rows without doc_id are linked with nothing and stay; rows that share
    a doc_id are one document, which stays or goes with all of them.
    """
    groups = superminhash.near_groups(docs, words=5, threshold=0.8)
    gone = groups.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts and rows without doc_id stay, rows of one doc_id go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their places in the sequences; a null text is one end id, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: Compression sizes and token ids cannot be told in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
