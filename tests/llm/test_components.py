import random

from palimpsest.llm.components import components


def test_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1090)] + [(2000, k) for k in range(2001, 2100)]
    edges += [(7, 7), (5000, 5000), (None, 3), (3, None), *edges[:20]]
    root = {}

    def top(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {n: top(n) for n in list(root)} and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
