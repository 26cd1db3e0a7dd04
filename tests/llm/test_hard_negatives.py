"""Hard negatives against a plain double loop over Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.hard_negatives import mine, products

NAN, INF = float("nan"), float("inf")


def brute(rows, step):
    """rows: (id, label, vector), ids distinct."""
    fit = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a, al, av in fit:
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, l) for i, l, v in fit if i != a and len(v) == len(av))
        for p_score, p, _ in [x for x in scored if x[2] == al][:5]:
            rest = [(s, i) for s, i, l in scored if l != al and 80 * -p_score <= 100 * -s <= 100 * -p_score]
            out |= {(a, p, k + 1, i, -p_score, -s) for k, (s, i) in enumerate(rest[:5])}
    return out


def got(df, step, **more):
    return [tuple(r) for r in mine(df, F.col("vec_id") % step == 0, **more).collect()]


@pytest.mark.parametrize("high", [1, 300, 10**5, 2**20, 2**30, 2**40])
def test_products_are_exact(high):
    rng = np.random.default_rng(high)
    a, r = (rng.integers(-high, high, (n, 7)).astype(float) for n in (5, 23))
    want = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q)), -(2**63)), 2**63 - 1) for q in r] for p in a]
    assert products(a, r).tolist() == want


@pytest.mark.parametrize("cell_bytes", [8 * 4 * 7, 1 << 20])
def test_against_brute_force(spark, cell_bytes):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        v = np.round(rng.normal(size=4) + (3, 0, 0, 0), 1)  # few distinct scores: many ties
        rows.append((i, int(rng.integers(3)) if i > 150 else 0, [float(x) for x in v]))
    rows += [(1000, None, [1.0] * 4), (1010, 1, None), (1020, 1, [1.0, None, 1.0, 1.0]), (1030, 1, [1.0, NAN, 0.0, 0.0]), (1040, 1, [INF, 0.0, 0.0, 0.0])]
    rows += [(1050, 1, [2.0, 1.0]), (1051, 1, [1.5, 1.0]), (1052, 2, [1.5, 1.0]), (1060, 1, []), (1061, 1, []), (1062, 2, []), (2000, 9, [0.5] * 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, rank string, positive_id int")
    found = got(df.union(df.where("vec_id % 3 = 0")), 10, cell_bytes=cell_bytes)
    want = brute([(i, l, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows], 10)
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 500


def test_huge_components_and_empty_tables(spark):
    rows = [(0, 1, [1e200, 1.0]), (1, 1, [1e200, 2.0]), (2, 2, [1e200, 3.0]), (3, 2, [-1e200, 0.0]), (4, 2, [1e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    top = 2**63 - 1
    assert got(df, 100) == [(0, 1, 1, 2, top, top)]
    assert got(df.limit(0), 100) == []
    assert got(df.where("label = 1"), 100) == []


def test_query(spark):
    from palimpsest.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    want = brute([(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows], 100)
    found = [tuple(r) for r in REGISTRY.queries["op12_hard_negatives"](spark, folder).collect()]
    assert len(found) == len(want) and set(found) == want
