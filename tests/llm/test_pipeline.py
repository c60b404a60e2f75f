"""The pipeline against a brute-force version of its stages, and every stage on odd tables."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import langid, packing

from .test_native import brute_lines, runs
from .test_near import brute_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables():
    rnd = random.Random(12)
    words = {"aa": "the and of thing with from that have this which were their".split(), "bb": "der und nicht schön mit von das haben dies welche waren ihre".split(), "cc": "que los para señor con desde esto tienen este cual eran sus".split()}
    item = " ".join(f"exam{i}" for i in range(20))
    docs = []
    for i in range(90):
        lang = rnd.choice(list(words))
        lines = [" ".join(rnd.choice(words[lang]) + (str(rnd.randint(0, 9)) if rnd.random() < 0.05 else "") for _ in range(rnd.randint(3, 30))) for _ in range(rnd.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rnd.randint(0, len(lines)), "All rights reserved by them")
        if i % 15 == 0:
            lines.append(item)
        docs.append([i, "\n".join(lines), lang])
    for i in range(90, 120):  # near and exact copies
        t = docs[rnd.randrange(90)][1].split(" ")
        if i % 2 and len(t) > 40:
            t[rnd.randrange(len(t))] = "changed"
        docs.append([i, " ".join(t), rnd.choice(["aa", "bb", "cc", None])])
    docs += [[200, None, "aa"], [201, "", None], [202, "12 34 !", "bb"], [203, "All rights reserved by them", "aa"], [204, " ".join(rnd.choice(words["aa"]) for _ in range(20_000)), "aa"]]
    rows = [(d, t, lang, "s", None if t is None else len(t)) for d, t, lang in docs]
    return rows, [(1, item), (2, None), (3, "the and of thing with from")]


def write(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def brute(spark, rows, items):
    """doc_id -> text of what is left before packing; doc_ids are unique."""
    labelled = spark.createDataFrame([(t, lang) for d, t, lang, *_ in rows if not held_out(d)], "text string, lang string")
    encoder = langid.Encoder({k: v.decode("utf-8", "ignore").lower().encode() for k, v in langid.train(labelled).items()})
    left = {}
    for d, t, *_ in rows:
        lang, score = encoder.classify(t)
        if lang != "und" and score >= langid.MARGIN:
            left[d] = t
    left = {d: t for d, t, _ in brute_lines(list(left.items()), 5) if t != ""}
    roots = {d: root for d, _, root in brute_groups(list(left.items()), 5)}
    left = {d: t for d, t in left.items() if d == roots[d]}
    sets = [runs(t) for _, t in items]
    return {d: t for d, t in left.items() if not any(s and 100 * len(s & runs(t)) >= 80 * len(s) for s in sets)}


def test_run_matches_brute_force(spark, tmp_path):
    rows, items = tables()
    got = corpus_pipeline.run(spark, write(spark, tmp_path, rows, items)).collect()
    want = brute(spark, rows, items)
    assert 40 < len(want) < len(rows) - 20
    tokenizer = Tokenizer.from_file(str(packing.tokenizer_path()))
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for d, t in want.items()}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d])
            assert r["ids_crc32"] == zlib.crc32(ids[d][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[d])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, tmp_path, name):
    """Nulls in any column, empty and repeated rows, clashing names, an empty table."""
    rows, items = tables()
    rows = [*rows[:30], (None, rows[3][1], None, None, None), rows[5], rows[5], (7, None, None, None, None), (8, "", "aa", None, None), (9, " \n ", None, "", -1)]
    d = write(spark, tmp_path, rows, items)
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 as line", "array(2) as keys", "'x' as score", "3 as row", "4 as h", "5 as rep", "6 as cls")
    out = stage(spark, docs, d)
    n = out.count()
    if name == "packing":
        assert out.where("doc_id is null").count() > 0 and n >= len(rows)
    else:
        assert out.columns == docs.columns and 0 < n <= len(rows)
        assert {r["keys"][0] for r in out.collect()} == {2}
    assert stage(spark, docs.limit(0), d).count() == 0


def test_clean_documents_stay(spark, tmp_path):
    name = lambda *x: "".join(chr(97 + i // 26) + chr(97 + i % 26) for i in x)
    rows = [(i, " ".join("word" + name(i, k) for k in range(40)) + " the and of thing with from that", "aa", "s", 1) for i in range(30)]
    rows += [(100 + i, " ".join("wort" + name(i, k) for k in range(40)) + " der und nicht mit von das", "bb", "s", 1) for i in range(30)]
    d = write(spark, tmp_path, rows, [(1, "one two three four five six")])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for which, stage in corpus_pipeline.STAGES[1:4]:
        assert {r["doc_id"] for r in stage(spark, docs, d).collect()} == {r[0] for r in rows}, which
