import collections
import random
import re

from quillon.llm import decontaminate, linededup

SCHEMA = "doc_id long, text string"


def runs(text, k=5):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if x]
    if len(w) >= k:
        return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {" ".join(w)} if w else set()


def test_leaks_match_brute_force(spark):
    rnd = random.Random(1)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([6, 9, 20, 60])))) for i in range(30)]
    items += [(50, "two words"), (51, None), (52, ""), (53, items[0][1]), (None, items[1][1])]
    docs = []
    for i in range(200):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(0, 150))]
        if i % 3 == 0:
            x = rnd.choice(items[:30])[1].split()
            for _ in range(rnd.randint(0, 2)):
                x[rnd.randrange(len(x))] = "changed"
            at = rnd.randint(0, len(w))
            w[at:at] = x
        docs.append((i, " ".join(w).upper() if i % 2 else "\n".join(w)))
    docs += [(900, None), (901, ""), (902, "two  words"), (903, "a two words b"), (None, items[2][1]), (904, " ".join(rnd.choice(vocab) for _ in range(20_000)) + " " + items[3][1])]
    want = {(a, d): len(runs(x) & runs(t)) / len(runs(x)) for a, x in items if a is not None and runs(x) for d, t in docs if d is not None and 100 * len(runs(x) & runs(t)) >= 80 * len(runs(x))}
    dd, ii = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["item_id"], r["doc_id"]): r["containment"] for r in decontaminate.leaks(dd, ii).collect()}
    assert got == want and len(got) > 30
    shuffled, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, 0
    try:
        assert {(r["item_id"], r["doc_id"]) for r in decontaminate.leaks(dd, ii).collect()} == set(want)
    finally:
        decontaminate.BROADCAST_ROWS = shuffled
    assert {r["doc_id"] for r in decontaminate.clean(dd, ii).collect()} == {d for d, _ in docs} - {d for _, d in want}
    assert decontaminate.leaks(dd, ii.limit(0)).count() == 0 and decontaminate.leaks(dd.limit(0), ii).count() == 0


def brute_lines(rows, least):
    docs = list(dict.fromkeys((d, t) for d, t in rows if t is not None))
    keys = collections.defaultdict(set)
    own = collections.defaultdict(set)
    for d, t in docs:
        for p, line in enumerate(t.split("\n")):
            k = tuple("<*>" if re.search("[0-9]", x) else x for x in re.split(r"[ \t\r]+", line) if x)
            if not k:
                continue
            n, w = len(k), -(-(len(k) - 3) // 4)
            ks = [(n, -1, k)] + [(n, j, k[: 3 + j * w], k[3 + (j + 1) * w :]) for j in range(4) if n - 3 >= 2 and n - 3 > j * w]
            for x in ks:
                keys[x].add((d, t, p))
                own[d, t, p].add(x)
    bad = {x: min((d, p) for d, _, p in v) for x, v in keys.items() if len({(d, t) for d, t, _ in v}) >= least}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        lines = t.split("\n")
        drop = {p for p in range(len(lines)) if any(x in bad and bad[x] != (d, p) for x in own[d, t, p])}
        rest = [x for p, x in enumerate(lines) if p not in drop]
        text = t if not drop else "\n".join(rest) if any(x.strip(" ") for x in rest) else ""
        out.append((d, text, len(drop)))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(2)
    word = lambda: rnd.choice(["a", "b", "c", "dd", "ee"])
    boiler = ["All rights reserved.", "Posted by user {n} on day {n}", "read more about our {w} policy here today", ""]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            lines.append(rnd.choice(boiler).format(n=rnd.randint(1, 99), w=word()) if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randint(1, 9))))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "All rights reserved."), (203, "All rights reserved."), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", place int, keys string")
    got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in linededup.dedup(df, counts=True).collect()), key=str)
    assert got == brute_lines(rows, 5)
    assert linededup.dedup(df).columns == ["doc_id", "text", "place", "keys"]
    assert linededup.dedup(df.limit(0)).count() == 0
