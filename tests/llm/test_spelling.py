"""Spelling variants against a comparison of all pairs, on odd tables, and against the SQL."""

import collections
import random
import re
import zlib

import duckdb
import pytest

from quillon.llm import queries
from quillon.llm import spelling as S


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_words(rows, every):
    n = collections.Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 5}


def brute(n):
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def edited(w, rnd):
    k = rnd.randrange(len(w) + 1)
    return rnd.choice([w[:k] + rnd.choice("aeé") + w[k:], w[:k] + w[k + 1 :], w[:k] + rnd.choice("rsÿ") + w[k + 1 :]])


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcàé") for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    bag = []
    for w in words:
        n = rnd.choice([5, 30, 200])
        bag += [w] * n
        for _ in range(rnd.randint(0, 3)):
            v = edited(w, rnd)
            bag += [v] * rnd.choice([4, 5, n // 5 + 1])
            bag += [edited(v, rnd)] * rnd.choice([1, 5])
    bag += ["Banane", "BANANE", "bananÉ", "x" * 300, "x" * 299] * 6
    rnd.shuffle(bag)
    rows = [(i, rnd.choice([" ", ", ", "1", "\n"]).join(bag[k : k + 40])) for i, k in enumerate(range(0, len(bag), 40))]
    return [*rows, (None, rows[0][1]), (None, None), (3, ""), rows[1], rows[1]]


def test_against_all_pairs(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as key").repartition(4)
    for every in (199, 3, 0):
        want = brute_words(texts, every)
        got = S.counted(docs, every=every)
        assert {r["word"]: r["n"] for r in got.collect()} == want
        assert sorted((tuple(r) for r in S.variants(got).collect()), key=str) == brute(want)
    # many small shards, shared ends split, all comparisons by arrays
    monkeypatch.setattr(S, "SHARD", 20)
    monkeypatch.setattr(S, "HOT", 2)
    assert sorted((tuple(r) for r in S.variants(got).collect()), key=str) == brute(want)
    assert S.variants(S.counted(docs.limit(0))).count() == 0


@pytest.mark.parametrize("few", [0, 24])
def test_near_words_of_one_automaton(few, monkeypatch):
    monkeypatch.setattr(S.Rests, "FEW", few)
    rnd = random.Random(7)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 10))) for _ in range(400)})
    held = [(w, second) for w in words for second in (False, True)]
    a = S.automaton(held)
    for w in words:
        found = [held[j][0] for j in S.hits(a, held, w)]
        assert sorted(found) == sorted(v for v in words if v != w and abs(len(v) - len(w)) < 2 and distance(v, w) == 1)


def test_parts_and_deletions(monkeypatch):
    text = "Größe " * 50 + "x" * 500 + " ende."
    monkeypatch.setattr(S, "PART", 37)
    assert [w for p in S._parts(text) for w in S.RUN.findall(p)] == S.RUN.findall(text) and "".join(S._parts(text)) == text
    assert S.lower("ÀBÉ") == "ÀbÉ" and S.deleted("abc", None, 1) == "abc" and len(S.deleted("abc", 5, 1)) == 2


def test_query_matches_its_sql(spark):
    d = "/root/testdata/sf0.001"
    want = duckdb.sql(queries.ORACLE_SQL["op13_spelling_variants"].replace("FROM documents", f"FROM '{d}/documents.parquet'")).fetchall()
    got = [tuple(r) for r in queries.op13_spelling_variants(spark, d).collect()]
    assert len(got) > 100 and sorted(got, key=str) == sorted(want, key=str)
