"""Held-out recall of the registered query on the driver's tables, and the bounds of its training sample."""

import random

import pytest

from quillon.llm import crf, queries


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.75), ("sf0.1", 0.9)])
def test_held_out_rows(spark, sf, least):
    d = f"/root/testdata/{sf}"
    got = queries.op10_crf_toxicity(spark, d)
    rows = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"), "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{d}/documents.parquet").count()
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    # labels are noisy: a toxic row without any offending token has nothing that could be learnt
    toxic = [r for r in held if r["toxic"] == 1]
    clean = [r for r in held if r["toxic"] == 0]
    caught = [r for r in toxic if r["predicted"]]
    assert len(caught) >= least * len(toxic) and sum(bool(r["spans"]) for r in caught) >= 0.9 * len(caught)
    assert sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    for r in caught:
        raw = r["text"].encode()
        assert all(raw[s["start"] : s["end"]].decode() for s in r["spans"])


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(crf, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    docs = spark.createDataFrame([(i % 10, f"text {i} " + "x" * 100) for i in range(500)] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] + [(None, 1), (11, 1), (2, None)], "doc_id long, toxic int")
    crf.train(docs, labels, sample=4)
    assert len(seen[0][0]) == 8 and sum(seen[0][1]) == 4
    crf.train(docs, labels, sample_bytes=300)
    assert len(seen[1][0]) == 6
    crf.train(docs.withColumn("toxic", docs.doc_id).limit(0), labels)
    assert seen[2] == ([], [])


def test_copies_are_one_piece_of_evidence():
    rnd = random.Random(3)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(n))
    base = text(60)
    texts = [text(40) for _ in range(200)] + [base + " " + text(2) for _ in range(30)]
    raw = [t.encode() for t in texts]
    family = crf.families(raw)
    assert (family[:200] == range(200)).all() and (family[200:] == 200).all()
    tok = crf.Tokens([t.encode() for t in texts])
    import numpy as np

    toxic = np.arange(230) >= 200
    assert not crf.label_tokens(tok, toxic, family == np.arange(230)).any()
    assert crf.label_tokens(tok, toxic).any()
