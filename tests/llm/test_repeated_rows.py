"""Many rows alike: they are dealt to bounded parts, and each is packed once."""

import zlib

from pyspark.sql import functions as F

from quillon.llm import packing


def test_rows_alike_are_ranked_in_bounded_parts(spark):
    n = 5000
    rows = spark.range(n, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(3).alias("cls"), F.monotonically_increasing_id().alias("row"))
    got = packing.ranked(rows, "cls", ["doc_id", "row"])
    assert sorted(r["rank"] for r in got.collect()) == list(range(n))
    parts = rows.select(F.pmod(F.xxhash64("doc_id", "row", F.lit(3)), F.lit(n // 200)).alias("part")).groupBy("part").count().agg(F.max("count")).first()[0]
    assert parts < 400


def test_repeated_documents_are_packed_each(spark):
    docs = spark.createDataFrame([(None, None)] * 3000 + [(7, "some words here")] * 500, "doc_id long, text string").repartition(4)
    got = packing.pack(docs).collect()
    assert len(got) == 3500 and sum(r["doc_id"] is None for r in got) == 3000
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    end = {}
    for s, o, n in places:
        assert o == end.get(s, 0)
        end[s] = o + n
    assert all(x <= 2048 for x in end.values()) and len(end) <= 5
    assert {r["ids_crc32"] for r in got if r["doc_id"] is None} == {zlib.crc32((1).to_bytes(4, "little"))}
