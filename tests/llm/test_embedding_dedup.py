"""Links of embeddings against all cosines."""

import numpy as np
import pytest

from palimpsest.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute(rows, least=E.LEAST):
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def usable(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    unit = [np.array(v, np.float32).astype(float) if usable(v, y) else None for _, v, y, *_ in rows]
    unit = [None if v is None else v / np.sqrt(v @ v) for v in unit]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i].size == unit[j].size and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    least_id = {}
    for i in range(n):
        if rows[i][0] is not None:
            least_id[top(i)] = min(rows[i][0], least_id.get(top(i), rows[i][0]))
    out = []
    for i in range(n):
        c = least_id.get(top(i), rows[i][0])
        out.append((rows[i][0], links[i], c, rows[i][0] is not None and rows[i][0] == c))
    return sorted(out, key=repr)


def got(spark, rows, **args):
    return sorted(map(tuple, E.link_near_vectors(spark.createDataFrame([(*r[:3], "x") for r in rows], SCHEMA), **args).collect()), key=repr)


def test_edge_cases(spark):
    a, b = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]
    rows = [
        (1, a, 1), (2, b, 1), (3, a, 2), (4, a, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 0.0], 1), (9, [1.0, float("nan"), 0.0], 1),
        (10, [float("inf"), 0.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [2.0, 0.0], 1), (None, a, 1), (13, [-1.0, 0.0, 0.0], 1), (14, [5.0, 0.0, 0.0], 1), (1, a, 1), (None, [0.0, 1.0, 0.0], 3),
    ]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, [(1, None, None)]) == [(1, 0, 1, True)]


@pytest.mark.parametrize("noise", [0.02, 0.035])
def test_groups_and_recall(spark, noise):
    rng = np.random.default_rng(4)
    rows = []
    for label in range(3):
        for size in (1, 1, 1, 2, 3, 5, 60, 200):
            centre = rng.standard_normal(64)
            centre /= np.sqrt(centre @ centre)
            for _ in range(size):
                rows.append((len(rows), (centre + noise * rng.standard_normal(64)).tolist(), label))
    rows += [(len(rows) + k, rows[k][1], rows[k][2]) for k in range(0, 300, 3)]
    want, have = brute(rows), got(spark, rows)
    total = sum(r[1] for r in want)
    assert total > 20000 and sum(r[1] for r in have) >= 0.99 * total
    assert all(h[1] <= w[1] for h, w in zip(sorted(have), sorted(want)))
    if noise < 0.03:
        assert have == want


@pytest.mark.parametrize("common", [0.76, 0.86])
def test_recall_with_a_common_direction(spark, common):
    rng = np.random.default_rng(6)

    def unit(x):
        return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))

    direction, rows = unit(rng.standard_normal(64)), []
    for family in range(150):
        own = unit(rng.standard_normal(64))
        for _ in range(4):
            # members of a family have a cosine of about 0.95
            share = (0.95 - common) / (1 - common)
            vector = np.sqrt(common) * direction + np.sqrt(1 - common) * (np.sqrt(share) * own + np.sqrt(1 - share) * unit(rng.standard_normal(64)))
            rows.append((len(rows), vector.tolist(), 1))
    want, have = brute(rows), got(spark, rows)
    assert sum(r[1] for r in have) >= 0.9 * sum(r[1] for r in want) > 1000
    assert all(h[1] <= w[1] for h, w in zip(have, want))


def test_query_finds_all_links(spark):
    from palimpsest.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(map(tuple, REGISTRY.queries["op4_near_vectors"](spark, folder).collect()), key=repr) == brute(rows)


def test_rotation_is_balanced():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 32)) * np.linspace(1, 3, 32) + 0.5
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    mean, projection = E.learn_rotation(x, 32)
    assert np.allclose(projection.T @ projection, np.eye(32), atol=1e-9)
    ones = ((x - mean) @ projection >= 0).mean(axis=0)
    assert ones.min() > 0.4 and ones.max() < 0.6
    plain = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    loss = lambda p: np.square(np.sign((x - mean) @ p) - (x - mean) @ p * np.sqrt(32)).sum()
    assert loss(projection) < loss(plain)
