"""Small literal cases of version, search and core operators."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import core as C
from palimpsest.operators import graph as G
from palimpsest.operators import retrieval as R
from palimpsest.operators import versions as V

D = dt.date


def test_diff_summary(spark):
    versions = spark.createDataFrame(
        [(100, 1, 100, D(2025, 1, 1), True), (200, 1, 200, D(2025, 6, 1), False)], "version_id long, law_id long, ver_id long, date_in_force date, is_current boolean"
    )
    arts = [(100, "1", "a"), (100, "2", "b"), (100, "3", "c"), (200, "1", "a changed"), (200, "2", "b "), (200, "4", "d")]
    articles = spark.createDataFrame([(i, v, n, t, i) for i, (v, n, t) in enumerate(arts)], "article_id long, version_id long, article_number string, full_text string, order_index long")
    row = V.diff_summary(versions, articles).collect()
    assert [(r.version_id, r.modified, r.added, r.removed) for r in row] == [(200, 1, 1, 1)]


def test_merge_history_heals_only_sentinels(spark):
    known = spark.createDataFrame(
        [(1, "a", D(1900, 1, 1), True), (1, "b", D(2020, 1, 1), False)], "law_id long, ver_id string, date_in_force date, is_current boolean"
    )
    versions = spark.createDataFrame([(1, 1, "c")], "version_id long, law_id long, ver_id string")
    history = spark.createDataFrame(
        [(1, 0, "c", "31.03.2026"), (1, 1, "d", "bad"), (1, 2, "a", "2019-05-01"), (1, 3, "b", "01.01.1999")], "law_id long, pos long, ver_id string, date string"
    )
    merged, counts = V.merge_history(known, versions, history)
    got = {r.ver_id: (str(r.date_in_force), r.is_current) for r in merged.collect()}
    assert got == {"a": ("2019-05-01", False), "b": ("2020-01-01", False), "c": ("2026-03-31", True), "d": ("1900-01-01", False)}
    assert [(r.law_id, r.new_count) for r in counts.collect()] == [(1, 1)]


def test_asof_is_exact_on_skewed_keys(spark):
    rng = random.Random(3)
    day = lambda: D(2000, 1, 1) + dt.timedelta(days=rng.randrange(400))
    hist = [(1 if rng.random() < 0.5 else rng.randrange(5), day(), i) for i in range(600)]
    asks = [(i, 1 if rng.random() < 0.5 else rng.randrange(6), day()) for i in range(400)]
    h = spark.createDataFrame(hist, "k long, since date, v long")
    a = spark.createDataFrame(asks, "id long, k long, at date")
    for strict in (False, True):
        got = {r.id: r.v for r in C.asof_join(a, h, ["k"], "at", "since", ["v"], ["v"], strict=strict).collect()}
        for i, k, t in asks:
            fits = [(d, v) for kk, d, v in hist if kk == k and (d < t if strict else d <= t)]
            assert got[i] == (max(fits)[1] if fits else None)


def test_number_rows_equals_row_number(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    got = C.number_rows(rows, ["k"], [F.asc("o")], F.floor(F.col("o") / 100)).collect()
    assert all(r.rn == r.o // 3 + 1 for r in got)


def test_vector_paths_agree(spark):
    rng = np.random.default_rng(1)
    c = spark.createDataFrame([(i, i % 3, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, version_id long, vector array<float>")
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(20)], "question_id long, vector array<float>")
    key = lambda df: sorted((r.question_id, r["rank"], r.vec_id) for r in df.collect())
    assert key(R.vector_topk(q, c, 7)) == key(R.vector_topk(q, c, 7, block_bytes=100))
    assert len(key(R.vector_topk(q, c, 7))) == 140


def test_phrase_counts_only_as_a_whole(spark):
    q = spark.createDataFrame([(1, "srl")], "question_id long, text string")
    corpus = spark.createDataFrame(
        [("article", 1, 1, "o parte din text"), ("article", 2, 1, "partea cu parte sociala"), ("article", 3, 1, "nimic"), ("article", 4, 1, "alt text"), ("article", 5, 1, "inca unul")],
        "doc_type string, doc_id long, version_id long, text string",
    )
    got = {r.doc_id for r in R.bm25_topk(q, corpus, 10).collect()}
    assert got == {2}


def test_exceptions_match_number_beginnings(spark):
    cols = "question_id long, article_id long, version_id long, article_number string, element_id string, order_index long, full_text string, arrival long"
    hits = spark.createDataFrame([(1, 10, 7, "5", None, 1, "text", 0)], cols)
    arts = spark.createDataFrame(
        [(10, 7, "5", None, 1, "text"), (11, 7, "6", None, 2, "Se excepteaza cele de la art. 50 alin. (1)"), (12, 7, "8", None, 3, "fara a aduce atingere art. 5^1"), (13, 7, "9", None, 4, "art. 5 se aplica")],
        "article_id long, version_id long, article_number string, element_id string, order_index long, full_text string",
    )
    loose = {r.article_id for r in G.expand_exceptions(hits, arts).collect()}
    assert loose == {11, 12}
    assert G.expand_exceptions(hits, arts, strict=True).collect() == []


def test_parts_of_words_are_found(spark):
    from palimpsest.operators import library as L

    entries = spark.createDataFrame([(1, "Codul MUNCII, art. 5"), (2, "muncă"), (3, None), (4, "ab c"), (5, "")], "ver_id long, text string")
    asks = ["munc", "MUNCII cod", "b", "c a", "muncii lipsa", "", None, "5", "cii a"]
    q = spark.createDataFrame([(i, 0, t) for i, t in enumerate(asks)], "query_id long, variant int, phrase string")
    found = sorted((r.query_id, r.ver_id) for r in L.entries_holding(q, entries).collect())
    assert found == [(0, 1), (0, 2), (1, 1), (2, 4), (3, 1), (3, 2), (3, 4), (7, 1), (8, 1)]
    assert L.entries_holding(q, entries.limit(0)).collect() == []


def test_note_segments(spark):
    """A change note reaches the last year before a bracket and its full stop; remarks run to the next one."""
    from palimpsest.functions.segments import note_segments

    cases = {
        None: [], "": [], "doar text": [("plain", "doar text")],
        "unu (la 01-02-2020, ceva 2019) si 2020). doi": [("plain", "unu "), ("change", "(la 01-02-2020, ceva 2019) si 2020)."), ("plain", " doi")],
        "(la 01-02-2020, fara capat Nota: x": [("change", "(la 01-02-2020, fara capat Nota: x")],
        "a Nota: unu (la 01-02-2020, 2019). \nNotă... doi ": [("plain", "a "), ("remark", "Nota: unu (la 01-02-2020, 2019)."), ("remark", "Notă... doi")],
        "(la 01-02-2020, a 2019)b(la 03-04-2021, c": [("change", "(la 01-02-2020, a 2019)"), ("plain", "b"), ("change", "(la 03-04-2021, c")],
        "(la 01-02-2020, a 2019).Nota: b Nota: c": [("change", "(la 01-02-2020, a 2019)."), ("remark", "Nota: b"), ("remark", "Nota: c")],
        "\U0001d518 (la 1-2-2020, Not 2019)": [("plain", "\U0001d518 (la 1-2-2020, Not 2019)")],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", note_segments(F.col("t")).alias("s")).collect()
    assert {r.t: [(s.kind, s.text) for s in r.s] for r in rows} == cases
    long = spark.range(1).select(F.concat(F.lit("(la 01-02-2020,"), F.repeat(F.lit("q"), 2_000_000), F.lit("2020). z Nota: "), F.repeat(F.lit("n "), 500_000)).alias("t"))
    assert [(x.kind, x.n) for x in long.select(F.inline(F.transform(note_segments(F.col("t")), lambda x: F.struct(x["kind"].alias("kind"), F.length(x["text"]).alias("n"))))).collect()] == [("change", 2_000_021), ("plain", 3), ("remark", 1_000_005)]
