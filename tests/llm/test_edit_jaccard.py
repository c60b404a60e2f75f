import random

from quillon.llm import fingerprint

from .test_near import brute_sets


def test_likeness_and_verified_jaccard_of_neighbours(spark):
    rnd = random.Random(8)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(40):
        x = list(base) if i % 3 else [f"v{rnd.randrange(10**6)}" for _ in range(150)]
        for _ in range(rnd.randint(0, 6)):
            x[rnd.randrange(len(x))] = f"c{rnd.randrange(10**6)}"
        rows.append((i, " ".join(x)))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "a b")]
    order = sorted(rows, key=lambda r: -r[0])
    for per in (None, 7):
        got = {r["doc_id"]: r for r in fingerprint.edit_study(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), per_range=per).collect()}
        assert len(got) == len(rows)
        for i, (d, t) in enumerate(order):
            t, nt = t or "", order[(i + 1) % len(order)][1] or ""
            edited = t[: len(t) - len(t) // 3] + nt[: len(t) // 3]
            for other, likeness, exact in ((edited, "near_edited", "jaccard_edited"), (nt, "near_next", "jaccard_next")):
                a, b = brute_sets(t, 5), brute_sets(other, 5)
                want = len(a & b) / len(a | b) if a | b else 1.0
                assert abs(got[d][likeness] - want) < 0.2
                if got[d][exact] is not None:
                    assert abs(got[d][exact] - want) < 1e-12
                elif a and b:
                    assert want < 0.75  # a pair this alike shares a band
            (s,), (m,) = fingerprint.signatures([edited.encode()])
            assert got[d]["edited_fingerprint"] == fingerprint._hex(s, m)
