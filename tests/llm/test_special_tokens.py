"""The pieces hold the ids of the contract's call: Tokenizer.encode(text, add_special_tokens=False), nothing else set."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(packing.tokenizer_path()))


def texts():
    rnd = random.Random(11)
    parts = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "a", " b", "\n", "é", "don't", "12", "<|endoftext|> ", "\t"]
    return ["a <|endoftext|> b", "<|endoftext|>", "", "<|endoftext|><|endoftext|>", "x<|endoftext|>y"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(500)]


def test_ids_with_special_tokens(tokenizer):
    got = packing.Encoder(str(packing.tokenizer_path()), special=True).encode(texts())
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts()]


def test_pieces_with_special_tokens(spark, tokenizer):
    rows = list(enumerate(texts()[:40])) + [(900, "<|endoftext|> b " * 3000)]
    want = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for d, t in rows}
    got = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
