"""Searches of many queries: a text asked for many times is looked up once."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import library as L


@pytest.fixture
def ranked(monkeypatch):
    """How many rows each ranking got."""
    seen, plain = [], L.top_k
    monkeypatch.setattr(L, "top_k", lambda df, *a, **k: (seen.append(df.count()), plain(df, *a, **k))[1])
    return seen


def test_autocomplete_meets_values_once_per_text(spark, ranked):
    q = spark.range(50).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "LEG").otherwise("x").alias("text"))
    values = spark.range(40).select(F.concat(F.lit("lege "), F.col("id").cast("string")).alias("value"), F.col("id").alias("place"))
    got = L.autocomplete(values, q, 3).collect()
    assert sorted((r.query_id, r.place, r["rank"]) for r in got) == [(i, p, p + 1) for i in range(50) for p in range(3)]
    assert max(ranked) <= 50 * 3


def test_library_search_meets_laws_once_per_text(spark, ranked):
    laws = spark.range(60).select(F.col("id").alias("law_id"), F.col("id").cast("string").alias("law_number"), F.lit(2000).alias("law_year"), F.lit("Legea apelor 9").alias("title"))
    q = spark.range(30).select(F.col("id").alias("query_id"), F.element_at(F.array(F.lit("apelor"), F.lit("9"), F.lit("57/2000")), (F.col("id") % 3 + 1).cast("int")).alias("text"))
    found = {}
    for r in L.library_search(q, laws, 4).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.law_id)
    # the bare number brings its own law first, the others follow
    assert found == {i: [0, 1, 2, 3] if i % 3 == 0 else [9, 0, 1, 2] if i % 3 == 1 else [57] for i in range(30)}
    assert max(ranked) <= 2 * 60 + 30 * 4


def test_counts_of_holding_entries(spark):
    asks = spark.createDataFrame([(1, 0, "apel lege"), (2, 0, "LEGE apel"), (3, 0, "9"), (4, 0, ""), (5, 0, "nimic"), (None, 0, "9")], "query_id long, variant int, phrase string")
    entries = spark.createDataFrame([(i, f"Legea apelor {i}") for i in range(20)], "ver_id long, text string")
    rows = L.entries_holding(asks, entries).groupBy("query_id").agg(F.count(F.lit(1)), F.min("ver_id"), F.max("ver_id")).collect()
    got = L.count_holding(asks, entries).collect()
    key = lambda found: sorted(map(tuple, found), key=str)
    assert key(got) == key(rows) == key([(1, 20, 0, 19), (2, 20, 0, 19), (3, 2, 9, 19), (None, 2, 9, 19)])
