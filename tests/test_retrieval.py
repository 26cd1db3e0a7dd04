"""Order of hits, keys by kind and number, blocks of questions; rules of paging and annotations."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import logs as L
from palimpsest.operators import retrieval as R
from palimpsest.operators.core import top_k
from palimpsest.plans import retrieval as P


def test_more_hits_of_a_common_term_rank_first(spark):
    rows = [("article", i, 0, "termen " * (1 + i % 13) + "alt " * (13 - i % 13)) for i in range(39)]
    corpus = spark.createDataFrame(rows, "doc_type string, doc_id long, version_id long, text string")
    q = spark.createDataFrame([(1, "termen")], "question_id long, text string")
    got = [r.doc_id for r in R.bm25_topk(q, corpus, 5).orderBy("rank").collect()]
    assert got == [12, 25, 38, 11, 24]


def test_stored_postings_give_the_same(spark):
    rows = [("article", 1, 0, "unu doi trei"), ("article", 2, 1, "doi doi"), ("annex", 1, 0, "doi patru"), ("annex", 5, 0, None)]
    corpus = spark.createDataFrame(rows, "doc_type string, doc_id long, version_id long, text string")
    q = spark.createDataFrame([(1, "doi unu"), (2, "patru")], "question_id long, text string")
    take = lambda df: sorted(map(tuple, df.collect()))
    assert take(R.bm25_scores(q, corpus)) == take(R.bm25_scores(q, corpus, postings=R.build_postings(corpus)))


def test_kinds_that_share_numbers_stay_apart(spark):
    vectors = spark.createDataFrame([("article", 7, 0, [1.0, 0.0]), ("annex", 7, 0, [0.0, 1.0])], "doc_type string, vec_id long, version_id long, vector array<double>")
    asks = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, vector array<double>")
    got = [(r.doc_type, r.vec_id, r.distance) for r in R.vector_topk(asks, vectors, 5).orderBy("rank").collect()]
    assert got == [("article", 7, 0.0), ("annex", 7, 1.0)]


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 26])
def test_blocks_of_questions(spark, block_bytes):
    rng = np.random.default_rng(5)
    c, q = rng.standard_normal((90, 4)), rng.standard_normal((11, 4))
    corpus = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(c)], "vec_id long, version_id long, vector array<double>")
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "question_id long, vector array<double>")
    scope = spark.createDataFrame([(i, v) for i in range(11) for v in ((i % 3,) if i % 2 else (0, 2))], "question_id long, version_id long")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    dist = 1 - unit(q) @ unit(c).T
    for s in (None, scope):
        found = {}
        for r in R.vector_topk(asks, corpus, 4, s, block_bytes=block_bytes).orderBy("question_id", "rank").collect():
            found.setdefault(r.question_id, []).append(r.vec_id)
        for i in range(11):
            pool = [j for j in range(90) if s is None or j % 3 in ((i % 3,) if i % 2 else (0, 2))]
            assert found[i] == sorted(pool, key=lambda j: dist[i, j])[:4]


def test_every_given_score_counts(spark):
    rows = [(1, "article", i, float(i), "SECONDARY", None, 0.5) for i in range(80)]
    hits = spark.createDataFrame(rows, "question_id long, doc_type string, doc_id long, arrival double, role string, bm25_rank double, distance double")
    scores = spark.createDataFrame([(1, "article", 79, 0.99)], "question_id long, doc_type string, doc_id long, model_score double")
    assert R.rerank(hits, scores, 1).first().doc_id == 79


def test_pages_have_a_limit(spark):
    runs = spark.createDataFrame([(1, "a", "2020")], "run_id long, module string, started_at string")
    assert L.list_runs(runs, 200).count() == 1
    for bad in ({"limit": 201}, {"limit": -1}, {"offset": -1}):
        with pytest.raises(ValueError):
            L.list_runs(runs, **bad)


def test_notes_close_within_reach(spark):
    note = lambda pad: "a (la 01-02-2020" + "x" * pad + " MONITORUL OFICIAL nr. 5) b"
    fits, beyond = note(1500 - len(" MONITORUL OFICIAL nr. 5)")), note(1501 - len(" MONITORUL OFICIAL nr. 5)"))
    got = spark.createDataFrame([(1, fits), (2, beyond), (3, ""), (4, None)], "i int, t string").select("i", X.strip_annotations(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["a b", beyond, "", None]


def _random_corpus(spark, n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{c}{k}" for k in "abcdefghijkl" for c in "abcde"]
    weight = 1 / np.arange(1, len(words) + 1)
    rows = [("article" if rng.random() < 0.7 else "annex", i, i % 5, " ".join(rng.choice(words, int(rng.integers(0, 60)), p=weight / weight.sum()))) for i in range(n)]
    asks = [(q, " ".join(rng.choice(words, int(rng.integers(1, 9))))) for q in range(25)] + [(99, "waa wab wac"), (100, "nothing")]
    corpus = spark.createDataFrame(rows + [("annex", 10**6, 1, None)], "doc_type string, doc_id long, version_id long, text string")
    return corpus, spark.createDataFrame(asks, "question_id long, text string")


@pytest.mark.parametrize("sent", [0, 10**5])
@pytest.mark.parametrize("scoped", [False, True])
def test_best_blocks_give_the_best_documents(spark, scoped, sent, monkeypatch):
    """The same rows as scoring every document, with phrases, versions, several cells and small blocks."""
    monkeypatch.setattr(R, "SENT_TERMS", sent)
    monkeypatch.setattr(R, "CELL_BLOCKS", 7)
    monkeypatch.setattr(R, "CELL_QUESTIONS", 10)
    corpus, asks = _random_corpus(spark, 500, 3)
    expansions = {"waa": ["wba", "wab wcb"], "wa": ["wdc"]}
    scope = asks.select("question_id", F.explode(F.array(F.col("question_id") % 5, F.lit(3))).alias("version_id")) if scoped else None
    postings = R.build_postings(corpus, block_docs=4)
    full = R.top_k(R.bm25_scores(asks, corpus, expansions, scope), ["question_id", "doc_type"], [F.desc("score"), F.asc("doc_id")], 3)
    want = sorted((r.question_id, r.doc_type, r["rank"], r.doc_id, r.version_id, r.score) for r in full.collect())
    for index in (None, postings):
        got = R.bm25_topk(asks, corpus, 3, expansions, scope, index).collect()
        assert sorted((r.question_id, r.doc_type, r["rank"], r.doc_id, r.version_id, pytest.approx(r.score, abs=1e-9)) for r in got) == want
    assert len(want) > 80


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    """Few blocks hold all good documents: the others are left at the k-th best score."""
    text = lambda i: "rar rar rar comun" if i < 8 else "comun " + "alt " * 6 if i % 2 else "alt " * 7
    corpus = spark.createDataFrame([("article", i, 0, text(i)) for i in range(400)], "doc_type string, doc_id long, version_id long, text string").coalesce(1)
    asks = spark.createDataFrame([(1, "rar comun")], "question_id long, text string")
    rows, ask, _ = R._asked(asks, corpus, {}, R.build_postings(corpus, block_docs=8))
    cell = R._Cell(rows.where("term IS NOT NULL").toArrow(), ask.toArrow(), None)
    scored, plain = [], cell.score
    monkeypatch.setattr(cell, "score", lambda chosen: scored.append(int(chosen.sum())) or plain(chosen))
    question, doc, _ = cell.best(4)
    assert 3 * sum(scored) < int((cell.bounds() > 0).sum())
    assert sorted(np.asarray(cell.hits.field(0))[cell.shown[doc]].tolist()) == [0, 1, 2, 3]


def test_questions_and_vectors_meet_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "CELL_BYTES", 4 * 8 * 7)
    monkeypatch.setattr(R, "HELD_DISTANCES", 14)
    rng = np.random.default_rng(8)
    c, q = rng.standard_normal((60, 4)), rng.standard_normal((40, 4))
    corpus = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(c)], "vec_id long, version_id long, vector array<double>")
    asks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "question_id long, vector array<double>")
    scope = spark.createDataFrame([(i, i % 2) for i in range(40)], "question_id long, version_id long")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    dist = 1 - unit(q) @ unit(c).T
    # no question vector goes to the driver
    monkeypatch.setattr(type(asks), "toLocalIterator", lambda *_: pytest.fail("vectors sent to the driver"))
    for s in (None, scope):
        found = {}
        for r in R.vector_topk(asks, corpus, 3, s).orderBy("question_id", "rank").collect():
            found.setdefault(r.question_id, []).append(r.vec_id)
        for i in range(40):
            assert found[i] == sorted((j for j in range(60) if s is None or j % 2 == i % 2), key=lambda j: dist[i, j])[:3]


def test_pairs_to_sum_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_PAIRS", 100, raising=False)
    corpus = spark.range(2000).select(F.lit("article").alias("doc_type"), F.col("id").alias("doc_id"), (F.col("id") % 4).alias("version_id"), F.lit("termen comun").alias("text"))
    q = spark.createDataFrame([(1, "termen"), (2, "comun")], "question_id long, text string")
    found = R.bm25_scores(q, corpus)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 4000 and found.select("score").distinct().count() == 1
    assert found.rdd.getNumPartitions() >= 40


def test_texts_are_indexed_in_pieces_of_bounded_size(monkeypatch):
    monkeypatch.setattr(R, "HELD_WORDS", 10)
    texts = [["a"] * 4, ["b"] * 6, [], ["c"] * 25, ["d"] * 3, ["e"] * 7, ["f"]]
    batch = pa.record_batch({"_t": pa.array([["x"], *texts]), "doc_id": pa.array(range(8))}).slice(1)
    pieces = [p.column("_t").to_pylist() for p in R._pieces([batch, batch.slice(0, 0)])]
    assert pieces == [texts[:3], texts[3:4], texts[4:6], texts[6:]]


def test_shares_unfolded_in_slices_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"cuvant{'abcdefgh'[i]}" for i in range(8)]
    texts = [" ".join(rng.choice(words, 1 + i % 9)) for i in range(120)]
    corpus = spark.createDataFrame([("article", i, i % 3, t) for i, t in enumerate(texts)], "doc_type string, doc_id long, version_id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, 3))) for i in range(20)], "question_id long, text string")
    scope = spark.createDataFrame([(i, v) for i in range(20) for v in (i % 3, (i + 1) % 3)], "question_id long, version_id long")
    take = lambda: sorted(map(tuple, R.bm25_topk(q, corpus, 4, version_filter=scope).collect()))
    want, sizes, inner = take(), [], R._Cell._score
    monkeypatch.setattr(R, "HELD_SHARES", 40)
    assert take() == want and len(want) == 80
    # in this process too, to see the slices
    rows, ask, _ = R._asked(q, corpus, {}, None)
    monkeypatch.setattr(R._Cell, "_score", lambda self, *pairs: sizes.append(pairs[0].size) or inner(self, *pairs))
    R._Cell(rows.where("term IS NOT NULL").toArrow(), ask.toArrow(), None).best(4)
    assert len(sizes) > 20 and max(sizes) <= 40


def test_candidates_leave_their_cell_as_the_best_of_each_version(spark):
    rng = np.random.default_rng(4)
    words = [f"cuvant{'abcdefgh'[i]}" for i in range(8)]
    rows = [("article" if i % 3 else "annex", i, i % 5 if i % 7 else None, " ".join(rng.choice(words, 1 + i % 9))) for i in range(200)]
    corpus = spark.createDataFrame(rows, "doc_type string, doc_id long, version_id long, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, 3))) for i in range(12)], "question_id long, text string")
    scope = spark.createDataFrame([(i, v) for i in range(12) for v in (i % 5, (i + 1) % 5, None)], "question_id long, version_id long")
    best = lambda df: sorted(map(tuple, top_k(df, ["question_id", "doc_type", "version_id"], [F.desc("score"), F.asc("doc_id")], 3).select("question_id", "doc_type", "doc_id", "version_id", "score").collect()))
    want = best(R.bm25_scores(q, corpus, scope=scope))
    found = R.bm25_candidates(q, corpus, 3, scope)
    assert best(found) == want and len(want) > 100
    # at most three rows a question, version and kind leave a cell
    cells = spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in found.groupBy("question_id", "doc_type", "version_id").count().collect()) <= 3 * cells


def test_reranked_hits_are_found_once(spark, tmp_path):
    docs = [(i, "impozit pe venit " * (1 + i % 3), "en" if i % 2 else "ro") for i in range(60)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string"),
        "benchmark": spark.createDataFrame([(0, "impozit"), (1, "venit")], "item_id long, text string"),
        "embeddings": spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(60)], "vec_id long, embedding array<float>, label int"),
        "labels": spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    out = P.reranked(spark, str(tmp_path))
    assert "CoGroup" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where("rank = 1").count() == 2
