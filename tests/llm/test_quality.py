"""The classifier on held-out rows, and its parts."""

import random
import zlib

import numpy as np

from palimpsest.llm import quality as Q


def made(n, rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 80))]
        good = i % 3 > 0
        out.append((i, " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words), int(good)))
    return out


def test_held_out_accuracy(spark):
    docs = made(600, random.Random(1))
    frame = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs if i % 5], "doc_id long, quality int")
    model = Q.fit(frame, labels, sample=100)
    got = {r.doc_id: r.score for r in Q.score(frame, model).collect()}
    assert all((got[i] >= 0.3) == y for i, _, y in docs if i % 5 == 0)
    assert all(0 <= s <= 1 for s in got.values())


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "text"), (4, "!! " * 50000), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    same = Q.score(docs, Q.fit(docs, none)).collect()
    assert len(same) == 5 and {r.score for r in same} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 1), (77, 0)], "doc_id long, quality int")
    scores = [r.score for r in Q.score(docs, Q.fit(docs, odd)).collect()]
    assert len(scores) == 5 and all(0 < s < 1 for s in scores)
    assert Q.score(docs.limit(0), Q.fit(docs, none)).collect() == []


def test_dual_solution_is_optimal():
    """Coordinate descent against subgradient conditions of the hinge loss."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    values = [rng.standard_normal(8) for _ in rows]
    signs = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    Q_EPOCHS, Q.EPOCHS = Q.EPOCHS, 3000
    try:
        weights, bias = Q.dual_coordinate_descent(rows, values, signs)
    finally:
        Q.EPOCHS = Q_EPOCHS
    x = np.zeros((60, 41))
    for k, (r, v) in enumerate(zip(rows, values)):
        x[k, r] = v
    x[:, 40] = 1

    def objective(w):
        return 0.5 * w @ w + Q.COST * np.maximum(0, 1 - signs * (x @ w)).sum()

    best = np.append(weights[:40], bias)
    assert all(objective(best) <= objective(best + d) + 0.02 for d in rng.standard_normal((200, 41)) * 0.05)


def test_features_do_not_depend_on_order_of_calls():
    known = Q._Tokens()
    a = Q.features("One two THREE!! ***", known)
    Q.features("two other", known)
    assert (a == Q.features("One two THREE!! ***", Q._Tokens())).all() and (np.diff(a) > 0).all()


def test_query(spark):
    from palimpsest.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in REGISTRY.queries["op10_quality"](spark, folder).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [d for d in truth if got[d].held_out]
    assert held and all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert sum(got[d].predicted == truth[d] for d in held) / len(held) > 0.97
