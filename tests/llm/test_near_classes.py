import random

from quillon.llm import fingerprint


def test_links_beside_an_unlike_smaller_document(spark):
    rnd = random.Random(5)
    rows, families = [], []
    for f in range(12):
        core = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        at = len(rows)
        # the smallest document shares half with both others, they share nearly all
        rows.append((at, " ".join(core[:210] + [f"a{f}x{i}" for i in range(90)])))
        rows += [(at + k, " ".join([*core[:285], *(f"b{f}x{k}x{i}" for i in range(8))])) for k in (1, 2)]
        rows.append((at + 3, rows[at + 1][1]))
        families.append(at)
    rows += [(900, None), (901, "")]
    links, members = fingerprint.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["a"], r["b"]) for r in links.collect()} == {(at + 1, at + 2) for at in families}
    cls = {r["doc_id"]: r["class"] for r in members.collect()}
    assert len(cls) == len(rows) and cls[900] == 900 and cls[901] == 901
    assert all(cls[at + k] == at + (1 if k == 3 else k) for at in families for k in range(4))


def test_study_rows_carry_their_class(spark):
    rnd = random.Random(6)
    core = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    rows = [(3, " ".join(core)), (5, " ".join(core).upper()), (9, " ".join([*core[:195], "x", "y"])), (11, " ".join(reversed(core))), (12, None), (12, "a b"), (None, " ".join(core))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class")
    out = fingerprint.with_classes(fingerprint.edit_study(docs), docs).collect()
    assert sorted((str(r["doc_id"]), r["class"], r["n_links"]) for r in out) == sorted([("3", 3, 1), ("5", 3, 1), ("9", 9, 1), ("11", 11, 0), ("12", 12, 0), ("12", 12, 0), ("None", None, 0)])
