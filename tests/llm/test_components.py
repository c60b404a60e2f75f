import random

from quillon.llm.common import components


def test_one_task_and_rounds_agree_with_a_search(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(150)] + [(7, i) for i in range(2000, 2100)] + [(5, 5), (None, 3), (4, None)]
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for v in sorted(near):
        todo = [v] if v not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = v
                todo += near[x]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for limit in (0, None):
        got = {r["vertex"]: r["component"] for r in components(df, one_task=limit).collect()}
        assert all(got.get(v, v) == root for v, root in want.items()) and set(got) <= set(want)
    assert components(df.limit(0)).count() == 0
