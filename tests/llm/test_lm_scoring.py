"""The n-gram model against dictionaries, the trie against sorted lists, and better scores than the base."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import ngram_trie as T
from palimpsest.llm.lm_scoring import levels, packed, score, unpacked


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**50) | st.integers(0, 300), max_size=300), st.lists(st.integers(0, 2**51) | st.integers(0, 300), max_size=50))
def test_elias_fano(values, asked):
    values = np.unique(np.array(values, np.int64))
    held = T.EliasFano(T.EliasFano.build(values))
    assert held.get(np.arange(values.size)).tolist() == values.tolist()
    where = {x: k for k, x in enumerate(values.tolist())}
    asked = np.array([*asked, *values.tolist()], np.int64)
    assert held.find(asked).tolist() == [where.get(x, -1) for x in asked.tolist()]


def test_growing_pointers_may_repeat():
    values = np.sort(np.random.default_rng(1).integers(0, 40, 500))
    assert T.EliasFano(T.EliasFano.build(values)).get(np.arange(500)).tolist() == values.tolist()


def test_packing():
    for x in (np.zeros(0, np.int64), np.arange(-5, 300), np.array([2**62])):
        assert unpacked(packed(x)).tolist() == x.tolist()


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), None]


def model(rows, frequent, d2, d3):
    """rows: (id, text, training). Per row (n_tokens, n_known, N, base score, score)."""
    c = Counter(t for _, text, train in rows if train for t in tokens(text))
    n, v = sum(c.values()), len(c)
    order = sorted(c, key=lambda t: (-c[t], (t if t is not None else "\n").encode()))
    top = set(order[:frequent])
    mass = sum(c[t] for t in c if t not in top) + 0.1 * (v - len(top) + 1)
    kind = lambda t: t if t in top else ""
    single = lambda k: (mass if k == "" else c[k] + 0.1) / (n + 0.1 * (v + 1))
    pair, triple = defaultdict(Counter), defaultdict(Counter)
    for _, text, train in rows:
        got = ["<", *map(kind, tokens(text))]
        if train:
            for k in range(2, len(got)):
                pair[got[k - 1]][got[k]] += 1
                triple[got[k - 2], got[k - 1]][got[k]] += 1

    def after(table, key, w, d, lower):
        if key not in table:
            return lower
        total, found = sum(table[key].values()), table[key][w]
        return (max(found - d, 0) + d * len(table[key]) * lower) / total

    out = []
    for i, text, _ in rows:
        words = tokens(text)
        got = ["<", *map(kind, words)]
        logs = math.log10(single(got[1]))
        for k in range(2, len(got)):
            lower = after(pair, got[k - 1], got[k], d2, single(got[k]))
            logs += math.log10(after(triple, (got[k - 2], got[k - 1]), got[k], d3, lower))
        logs += sum(math.log10((c[t] + 0.1) / mass) for t in words if t not in top)
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in words)
        out.append((i, len(words), sum(c[t] > 0 for t in words), n, base, logs))
    return out


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(40)] + ["Ünï", "A", "B\x00c", "<unk>", "日本"]
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for i in range(300):
        n = int(rng.integers(0, 40))
        rows.append((i, " ".join(rng.choice(words, n, p=weights / weights.sum())) + " A common end" * (i % 3), bool(i % 5)))
    rows += [(1000, None, True), (1001, "", False), (1002, "never seen words", False), (None, "A b\tc\r\nd\x0be", True), (1003, "the " * 5000, True), (1004, None, False), (1005, "x", None)]
    return rows + rows[:3]


@pytest.mark.parametrize("frequent", [4, 12, 10**5])
@pytest.mark.parametrize("shard_tokens", [300, 10**6])
def test_against_dictionaries(spark, frequent, shard_tokens):
    rows = texts()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, train boolean, score double").repartition(3)
    found = score(df, F.col("train"), frequent=frequent, shard_tokens=shard_tokens, discounts=(0.6, 0.8)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(model(rows, frequent, 0.6, 0.8), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4] == pytest.approx(w[4], abs=1e-9)
        # a frequent and a rare word's logarithms are rounded by up to half a step each, a rest by one more
        assert abs(g[5] - w[5]) <= 2 * T.STEP * w[1]
    held = {r.doc_id: r.held_out for r in found}
    assert held[0] and not held[1] and held[1005]


def test_probabilities_sum_to_one():
    """After contexts of every kind: known, with a known last word only, and unknown."""
    rng = np.random.default_rng(8)
    size = 60
    single = rng.dirichlet(np.ones(size))
    triples, counts = np.unique(
        sum(np.int64(x) << s for x, s in zip(rng.integers(0, (12, 6, 40), (3000, 3)).T, (2 * T.WORD_BITS, T.WORD_BITS, 0))), return_counts=True
    )
    of = triples >> 2 * T.WORD_BITS << T.WORD_BITS | triples & T.WORDS - 1
    pairs, line = np.unique(of, return_inverse=True)
    trie = T.Trie(T.mapped(T.build(triples, counts, pairs, np.bincount(line, counts).astype(np.int64), single)))
    words = np.arange(size)
    for v in (0, 3, 11, 50):
        for u in (0, 5, 30):
            cost = trie.cost(np.int64(v) << 2 * T.WORD_BITS | np.int64(u) << T.WORD_BITS | words, T.steps(single).astype(np.int64))
            assert (10 ** (-T.STEP * cost)).sum() == pytest.approx(1, abs=2e-3)


def test_no_training_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in score(df, F.lit(False)).collect()) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    assert score(df.limit(0), F.lit(True)).collect() == []


def test_levels_are_kept_and_read(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string, train boolean")
    found = levels(df, F.col("train"), shard_tokens=300).collect()
    tries = [T.Trie(r.levels) for r in found]
    assert len(found) > 5 and sum(t.places.n for t in tries) > 500


def test_query(spark):
    from palimpsest.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 10 != 0) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = {r.doc_id: r for r in REGISTRY.queries["op13_lm_scores"](spark, folder).collect()}
    want = model(docs, 10**9, 0.5, 0.5)
    assert len(found) == len(docs)
    for i, n, known, train, base, _ in want:
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train) and r.base_score == pytest.approx(base)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and len(held) > 50
