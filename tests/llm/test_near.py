import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import fingerprint, superminhash
from quillon.llm.hashing import Words, shingles

SCHEMA = "doc_id long, text string"


def brute_sets(text, k):
    w = (text or "").encode().translate(bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))).split()
    if len(w) >= k:
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {tuple(w)} if w else set()


def brute_groups(rows, k, t=80):
    sets = [brute_sets(x, k) for _, x in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets, strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab AB\n\té\x1c", max_size=12), max_size=6), st.integers(1, 4))
def test_shingles_match_brute_force(texts, k):
    w = Words([t.encode() for t in texts])
    s, off = shingles(w.hashes(), w.offsets, k)
    got = [set(s[off[i] : off[i + 1]].tolist()) for i in range(len(texts))]
    want = [brute_sets(t, k) for t in texts]
    assert [len(g) for g in got] == [len(x) for x in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        est = []
        for _ in range(20):
            x = rng.integers(0, 2**63, 400).astype(np.uint64)
            n = int(400 * share)
            a, b = x[:n], rng.integers(0, 2**63, 400 - n).astype(np.uint64)
            sig = superminhash.signatures([np.concatenate([a, x[n:]]), np.concatenate([a, b])])
            est.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(est) - n / (800 - n)) < 0.02


def test_small_sets_fill_all_registers():
    sig = superminhash.signatures([np.array([7], dtype=np.uint64), np.array([7, 9], dtype=np.uint64), np.zeros(0, dtype=np.uint64)])
    assert (sig[:2] < 0xFFFFFFFF).all() and (sig[2] == 0xFFFFFFFF).all()
    assert (sig[0] == sig[1]).mean() > 0.3


def corpus(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(60)]
        for c in range(rnd.randint(1, 9)):
            x = list(base)
            for _ in range(rnd.randint(0, 7)):
                x[rnd.randrange(60)] = rnd.choice(vocab)
            rows.append((100 * g + c, " ".join(x)))
    return rows + [(5000, None), (5001, ""), (5002, "  \n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (None, rows[0][1]), (5006, "İ i"), (3, rows[0][1])]


def check(spark, rows, k, **kw):
    got = superminhash.near_groups(spark.createDataFrame(rows, SCHEMA), words=k, **kw).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=key) == sorted(brute_groups(rows, k), key=key)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_groups_match_brute_force(spark):
    check(spark, corpus(), 2)
    check(spark, corpus(4), 5, block=4)


def test_chain_with_one_bucket_of_many(spark):
    rnd = random.Random(9)
    base = [f"a{rnd.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(120):  # a group whose members are often under the threshold with each other
        x = list(base)
        for p in rnd.sample(range(150), rnd.randint(0, 9)):
            x[p] = f"b{rnd.randrange(10**6)}"
        rows.append((i + 1, " ".join(x)))
    check(spark, rows, 2, block=16)


def test_empty_table_and_clashing_columns(spark):
    assert superminhash.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "a b c", 6, "y")], "doc_id long, text string, rep long, digest string")
    assert sorted((r["doc_id"], r["component_id"]) for r in superminhash.near_groups(df).collect()) == [(1, 1), (2, 1)]


def test_edit_study_matches_direct_computation(spark):
    rnd = random.Random(2)
    rows = [(i * 3, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(rnd.randint(0, 40)))) for i in range(57)] + [(500, None), (501, ""), (502, "é" * 10)]
    rnd.shuffle(rows)
    for per in (2000, 10):
        got = {r["doc_id"]: r for r in fingerprint.edit_study(spark.createDataFrame(rows, SCHEMA), per_range=per).collect()}
        order = sorted(rows, key=lambda r: -r[0])
        assert len(got) == len(rows)
        import hashlib

        prints = {}
        for d, t in rows:
            s, n = fingerprint.signatures([(t or "").encode()])
            prints[d] = (s[0] & 255, n[0], fingerprint._hex(s[0], n[0]))
        for i, (d, t) in enumerate(order):
            nd, nt = order[(i + 1) % len(order)]
            t, nt = t or "", nt or ""
            edited = t[: len(t) - len(t) // 3] + nt[: len(t) // 3]
            assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert got[d]["fingerprint"] == prints[d][2]
            assert abs(got[d]["near_next"] - fingerprint.likeness(prints[d][0], prints[d][1], prints[nd][0], prints[nd][1])) < 1e-9
    assert fingerprint.edit_study(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fingerprint.edit_study(spark.createDataFrame([(1, "a b c d e f")], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_near_links_are_verified(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t"), (2, "a b c d e f g h i j k l m n o p q r s t"), (3, "a b c d e f g h i j k l m n o p q r s t u"), (4, "z y x w v u")]
    got = {(r["a"], r["b"]) for r in fingerprint.near_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 3)}
