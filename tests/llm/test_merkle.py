"""The manifest against a direct one, on odd tables and with blocks of few leaves, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest

from quillon.llm import merkle, queries
from quillon.llm.common import table

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def low(x):
    return x and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def up(nodes):
    """Levels of a tree from its leaves."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        a = i // 8 * 8
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return out


def direct(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, h("".join(map(field, r))), r))
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {p: up([x[2] for x in sorted(parts[p], key=lambda x: x[:3])]) for p in order}
    top = up([trees[p][-1][0] for p in order]) if order else []
    out = []
    for k, p in enumerate(order):
        for i, x in enumerate(sorted(parts[p], key=lambda x: x[:3])):
            path = beside(trees[p], i) + beside(top, k)
            r = x[3]
            f = x[2]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                f = h("".join(map(field, (*r[:4], low(r[4])))))
            for a, b in path:
                f = h(a + f + b)
            out.append((r[0], x[2], trees[p][-1][0], top[-1][0], h("".join(a + b for a, b in path)), f, f == top[-1][0]))
    return sorted(out, key=str)


def some(n, langs, seed):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["s", None, ""]), rnd.choice(langs), rnd.choice([None, i]), rnd.choice(["Text Á of " + str(i), "", None, "lower", "LONG é " * 300])) for i in rnd.sample(range(10 * n), n)]


CASES = {
    "one row": [(7, "s", "en", 1, "A")],
    "one part of nine": [(i, "s", "en", 1, "A b") for i in range(9)],
    "parts of many sizes": some(700, ["en"] * 8 + ["de", "fr", "", None], 1),
    "many parts": some(150, [f"l{i}" for i in range(70)], 2),
    "nulls and repeated rows": [(None, None, None, None, None)] * 3 + [(3, "s", "en", 1, "Twice")] * 20 + [(3, "s", "en", 1, "other")],
}


@pytest.mark.parametrize("levels", [1, 2, 4])
@pytest.mark.parametrize("case", sorted(CASES))
def test_against_a_direct_tree(spark, case, levels):
    forged, where = merkle.tampering()
    docs = spark.createDataFrame(CASES[case], KIND).selectExpr("*", "1 as leaf", "2 as g", "3 as i").repartition(3)
    got = merkle.manifest(merkle.leaves(docs, forged=forged, where=where), levels)
    assert sorted((tuple(r) for r in got.collect()), key=str) == direct(CASES[case])


def test_empty_table_and_proofs(spark):
    empty = spark.createDataFrame([], KIND)
    assert merkle.study(empty).count() == 0
    docs = spark.createDataFrame(CASES["one part of nine"], KIND)
    for r in merkle.manifest(merkle.leaves(docs), proofs=True).collect():
        assert r["verified"] and h(r["siblings"]) == r["proof_sha256"] and len(r["siblings"]) == 64 * (1 if r["key"] == 8 else 8)


def test_query_matches_its_sql(spark):
    d = "/root/testdata/sf0.001"
    want = duckdb.sql(queries.ORACLE_SQL["op11_merkle_manifest"].replace("FROM documents", f"FROM '{d}/documents.parquet'")).fetchall()
    got = [tuple(r) for r in queries.op11_merkle_manifest(spark, d).collect()]
    assert sorted(got) == sorted(want) and sorted(got, key=str) == direct([tuple(r) for r in table(spark, d, "documents").select(*merkle.FIELDS).collect()])
