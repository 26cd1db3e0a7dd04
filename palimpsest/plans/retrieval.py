"""Driver queries of the search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.terms import ENTITY_KEYWORDS, EXPANSIONS
from palimpsest.operators import retrieval as R
from palimpsest.operators.core import first_seen, top_k
from palimpsest.plans import standins as S
from palimpsest.plans.registry import REGISTRY
from palimpsest.session import written

add = REGISTRY.add


def sql_fold(e: str) -> str:
    return f"translate(lower({e}), '{X.FOLD_FROM}', '{X.FOLD_TO}')"


def _values(rows) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)


EXPANSION_VALUES = _values((i, k, r) for i, (k, rs) in enumerate(EXPANSIONS.items()) for r in rs)


def bm25_sql(questions: str = "questions", scope: str | None = None, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}scores`` (question_id, doc_type, doc_id, version_id, score)."""
    p = prefix
    where = f"JOIN (SELECT DISTINCT question_id, version_id FROM {scope}) s ON s.question_id = a.question_id AND s.version_id = tf.version_id" if scope else ""
    return f"""{p}words AS (SELECT question_id, unnest(regexp_extract_all(text, '{X.QUERY_WORD}')) AS word FROM {questions}),
 {p}numbered AS (SELECT question_id, word, row_number() OVER () AS wid FROM {p}words),
 {p}keys AS (SELECT wid, min(e.i) AS i FROM {p}numbered JOIN (VALUES {EXPANSION_VALUES}) e(i, k, r) ON starts_with(lower(word), k) GROUP BY wid),
 {p}phrases AS (SELECT question_id, {sql_fold("word")} AS phrase FROM {p}numbered
  UNION ALL SELECT question_id, e.r FROM {p}numbered JOIN {p}keys USING (wid) JOIN (VALUES {EXPANSION_VALUES}) e(i, k, r) ON e.i = {p}keys.i),
 {p}weighted AS (SELECT question_id, phrase, count(*) AS weight FROM {p}phrases GROUP BY ALL),
 {p}terms AS (SELECT DISTINCT question_id, phrase, weight, len(list_distinct(string_split(phrase, ' '))) AS phrase_size,
   unnest(string_split(phrase, ' ')) AS term FROM {p}weighted),
 {p}docs AS (SELECT doc_type, doc_id, version_id, regexp_extract_all({sql_fold("text")}, '{X.TOKEN}') AS toks FROM corpus),
 {p}tf AS (SELECT doc_type, doc_id, version_id, dl, term, count(*) AS tf FROM
   (SELECT doc_type, doc_id, version_id, len(toks) AS dl, unnest(toks) AS term FROM {p}docs) GROUP BY ALL),
 {p}stats AS (SELECT doc_type, count(*) AS n, avg(len(toks)) AS avgdl FROM {p}docs GROUP BY 1),
 {p}idf AS (SELECT doc_type, term, avgdl, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6
   ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM {p}tf JOIN {p}stats USING (doc_type) GROUP BY doc_type, term, n, avgdl),
 {p}grp AS (SELECT a.question_id, tf.doc_type, tf.doc_id, tf.version_id, a.phrase, a.phrase_size, a.weight, count(*) AS n,
   sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
   FROM {p}tf tf JOIN {p}terms a USING (term) JOIN {p}idf i ON i.doc_type = tf.doc_type AND i.term = tf.term {where} GROUP BY ALL),
 {p}scores AS (SELECT question_id, doc_type, doc_id, version_id, round(sum(s * weight), 12) AS score FROM {p}grp WHERE n = phrase_size GROUP BY ALL)"""


def shown(df):
    """Ranked in full, shown with six digits, as the sums differ in the last ones."""
    return df.withColumns({c: F.round(c, 6) for c in ("score", "bm25_rank", "distance", "reranker_score") if c in df.columns})


TOPK = "row_number() OVER (PARTITION BY question_id, doc_type ORDER BY score DESC, doc_id)"


@add("bm25_topk", S.with_(S.QUESTIONS, S.CORPUS, bm25_sql()) + f"""
SELECT * REPLACE (round(score, 6) AS score), round(-score, 6) AS bm25_rank FROM (SELECT question_id, doc_type, doc_id, version_id, score, {TOPK} AS rank FROM scores) WHERE rank <= 10""")
def bm25_topk(spark, d):
    return shown(R.bm25_topk(S.questions(spark, d), S.corpus(spark, d), 10))


SCOPE = "scope AS (SELECT DISTINCT question_id, (question_id + j) % 20 AS version_id FROM questions, range(4) t(j))"


def _scope(spark, d):
    q = S.questions(spark, d)
    return q.select("question_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select(
        "question_id", ((F.col("question_id") + F.col("j")) % 20).alias("version_id")
    )


@add("bm25_topk_versions", S.with_(S.QUESTIONS, S.CORPUS, SCOPE, bm25_sql(scope="scope")) + f"""
SELECT * REPLACE (round(score, 6) AS score), round(-score, 6) AS bm25_rank FROM (SELECT question_id, doc_type, doc_id, version_id, score, {TOPK} AS rank FROM scores) WHERE rank <= 10""")
def bm25_topk_versions(spark, d):
    return shown(R.bm25_topk(S.questions(spark, d), S.corpus(spark, d), 10, version_filter=_scope(spark, d)))


DIST = "round(1 - list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(v.vector AS DOUBLE[])), 12)"


@add("vector_topk", S.with_(S.VECTORS, S.QUERY_VECTORS) + f"""
SELECT * REPLACE (round(distance, 6) AS distance) FROM (SELECT question_id, version_id, vec_id, {DIST} AS distance,
 row_number() OVER (PARTITION BY question_id ORDER BY {DIST}, vec_id) AS rank FROM qvec q, vectors v) WHERE rank <= 10""")
def vector_topk(spark, d):
    return shown(R.vector_topk(S.query_vectors(spark, d), S.vectors(spark, d), 10))


VSCOPE = "vscope AS (SELECT DISTINCT question_id, (question_id + j) % 20 AS version_id FROM qvec, range(5) t(j))"


def _vscope(spark, d):
    return S.query_vectors(spark, d).select("question_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).select(
        "question_id", ((F.col("question_id") + F.col("j")) % 20).alias("version_id")
    )


VECTOR_SCOPED = S.with_(S.VECTORS, S.QUERY_VECTORS, VSCOPE) + f"""
SELECT * REPLACE (round(distance, 6) AS distance) FROM (SELECT q.question_id, v.version_id, vec_id, {DIST} AS distance,
 row_number() OVER (PARTITION BY q.question_id ORDER BY {DIST}, vec_id) AS rank
 FROM qvec q JOIN vscope s ON s.question_id = q.question_id JOIN vectors v ON v.version_id = s.version_id) WHERE rank <= 10"""


@add("vector_topk_versions", VECTOR_SCOPED)
def vector_topk_versions(spark, d):
    return shown(R.vector_topk(S.query_vectors(spark, d), S.vectors(spark, d), 10, _vscope(spark, d)))


@add("vector_topk_blocks", VECTOR_SCOPED)
def vector_topk_blocks(spark, d):
    """The same search with the question vectors in several blocks."""
    return shown(R.vector_topk(S.query_vectors(spark, d), S.vectors(spark, d), 10, _vscope(spark, d), block_bytes=150_000))


# law scope of the questions: two laws in the first tier, one in the second, versions by number
LAW_SCOPE = """lawscope AS (SELECT question_id, CASE WHEN j < 4 THEN 'tier1_primary' ELSE 'tier2_secondary' END AS tier,
 (question_id + j // 2) % 10 AS law_id, j // 2 AS law_order, (question_id * 2 + j) % 20 AS version_id FROM questions, range(6) t(j))"""


def law_scope(spark, d):
    j = F.col("j")
    return (
        S.questions(spark, d)
        .select("question_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
        .select(
            "question_id",
            F.when(j < 4, "tier1_primary").otherwise("tier2_secondary").alias("tier"),
            ((F.col("question_id") + F.floor(j / 2)) % 10).alias("law_id"),
            F.floor(j / 2).alias("law_order"),
            ((F.col("question_id") * 2 + j) % 20).alias("version_id"),
        )
    )


def question_vectors(spark, d):
    """Vectors of the questions: the vector id is the question id."""
    return S.query_vectors(spark, d).join(S.questions(spark, d).select("question_id"), "question_id", "left_semi")


def _hybrid(spark, d):
    q = S.questions(spark, d)
    return R.hybrid_retrieve(q, law_scope(spark, d), S.corpus(spark, d), question_vectors(spark, d), S.doc_vectors(spark, d))


HYBRID = [
    S.QUESTIONS, S.CORPUS, S.DOC_VECTORS, S.QUERY_VECTORS, LAW_SCOPE,
    bm25_sql("questions", "lawscope"),
    """plan AS (SELECT *, greatest(5, CASE tier WHEN 'tier1_primary' THEN 30 ELSE 15 END // (SELECT count(DISTINCT law_id)
 FROM lawscope b WHERE b.question_id = a.question_id AND b.tier = a.tier)) AS budget FROM lawscope a)""",
    """lex AS (SELECT * FROM (SELECT question_id, tier, law_id, law_order, doc_type, doc_id, version_id, -score AS bm25_rank, budget,
 row_number() OVER (PARTITION BY question_id, tier, law_id, doc_type ORDER BY score DESC, doc_id) AS rank
 FROM scores JOIN plan USING (question_id, version_id)) WHERE rank <= budget)""",
    f"""sem AS (SELECT * FROM (SELECT question_id, tier, law_id, law_order, doc_type, vec_id AS doc_id, version_id, budget, distance,
 row_number() OVER (PARTITION BY question_id, tier, law_id ORDER BY distance, vec_id, doc_type) AS rank FROM
 (SELECT q.question_id, p.tier, p.law_id, p.law_order, p.budget, v.doc_type, v.vec_id, v.version_id, {DIST} AS distance
  FROM qvec q JOIN plan p ON p.question_id = q.question_id JOIN docvec v ON v.version_id = p.version_id)) WHERE rank <= budget)""",
    """arrived AS (SELECT question_id, tier, law_id, doc_type, doc_id, version_id, bm25_rank, CAST(NULL AS DOUBLE) AS distance, 'bm25' AS source,
 law_order, CASE WHEN doc_type = 'article' THEN 0 ELSE 1 END AS src, rank FROM lex
 UNION ALL SELECT question_id, tier, law_id, doc_type, doc_id, version_id, NULL, distance, 'semantic', law_order, 2, rank FROM sem)""",
    """hits AS (SELECT * EXCLUDE (rank, src, law_order, seen), CASE WHEN tier = 'tier1_primary' THEN 'PRIMARY' ELSE 'SECONDARY' END AS role,
 row_number() OVER (PARTITION BY question_id ORDER BY tier, law_order, law_id, src, rank) AS arrival FROM
 (SELECT *, row_number() OVER (PARTITION BY question_id, doc_type, doc_id ORDER BY tier, law_order, law_id, src, rank) AS seen FROM arrived) WHERE seen = 1)""",
]
HIT_COLS = "question_id, tier, law_id, doc_type, doc_id, version_id, round(bm25_rank, 6) AS bm25_rank, round(distance, 6) AS distance, source, role"


@add("hybrid_retrieve", S.with_(*HYBRID) + f"SELECT {HIT_COLS} FROM hits")
def hybrid_retrieve(spark, d):
    return shown(_hybrid(spark, d).drop("arrival"))


@add("hybrid_duplicates", S.with_(*HYBRID) + """SELECT question_id, CAST(count(*) AS BIGINT) AS found,
 CAST(count(DISTINCT (doc_type, doc_id)) AS BIGINT) AS kept FROM arrived GROUP BY 1""")
def hybrid_duplicates(spark, d):
    """How many hits the union brought and how many are left once seen twice is removed."""
    q = S.questions(spark, d)
    scope = law_scope(spark, d)
    plan = R.law_budgets(scope, R.FULL_BUDGETS)
    lex = R.bm25_candidates(q, S.corpus(spark, d), 30, scope).join(plan, ["question_id", "version_id"])
    lex = R.top_k_by(lex, ["question_id", "tier", "law_id", "doc_type"], [F.desc("score"), F.asc("doc_id")], F.col("budget"), 30)
    sem = R.vector_candidates(question_vectors(spark, d), S.doc_vectors(spark, d), 30, scope).join(plan, ["question_id", "version_id"])
    sem = R.top_k_by(sem, ["question_id", "tier", "law_id"], [F.asc("distance"), F.asc("vec_id"), F.asc("doc_type")], F.col("budget"), 30)
    both = lex.select("question_id", "doc_type", "doc_id").unionByName(sem.select("question_id", "doc_type", F.col("vec_id").alias("doc_id")))
    return both.groupBy("question_id", "doc_type", "doc_id").count().groupBy("question_id").agg(
        F.sum("count").alias("found"), F.count(F.lit(1)).alias("kept")
    )


ENTITIES = """ents AS (SELECT question_id, entity_order, entity FROM questions, (VALUES (0, 'sa'), (1, 'SRL'), (2, 'none')) e(entity_order, entity))"""
KEYWORDS = _values((e, i, w) for e, ks in ENTITY_KEYWORDS.items() for i, w in enumerate(ks))


@add("entity_retrieve", S.with_(
    S.QUESTIONS, S.CORPUS.replace("text FROM", "'capital social ' || text AS text FROM"),
    S.VECTORS, S.QUERY_VECTORS, LAW_SCOPE, ENTITIES,
    f"derived AS (SELECT ents.*, kw_order, kw, question_id * 10000 + entity_order * 100 + kw_order AS sub FROM ents JOIN (VALUES {KEYWORDS}) k(e, kw_order, kw) ON k.e = upper(ents.entity))",
    "asks AS (SELECT sub AS question_id, kw AS text FROM derived)",
    "subscope AS (SELECT sub AS question_id, version_id FROM derived JOIN lawscope USING (question_id) WHERE tier = 'tier1_primary')",
    bm25_sql("asks", "subscope"),
) + f"""SELECT question_id, doc_type, doc_id, version_id, source, tier, role, bm25_rank FROM (
 SELECT *, row_number() OVER (PARTITION BY question_id, doc_type, doc_id ORDER BY entity_order, kw_order, CASE WHEN doc_type = 'article' THEN 0 ELSE 1 END, rank) AS seen FROM (
  SELECT derived.question_id, doc_type, doc_id, version_id, 'entity:' || entity AS source, 'entity_targeted' AS tier, 'PRIMARY' AS role,
   round(-score, 6) AS bm25_rank, entity_order, kw_order, rank FROM (SELECT *, {TOPK} AS rank FROM scores) s JOIN derived ON derived.sub = s.question_id WHERE rank <= 10)) WHERE seen = 1""")
def entity_retrieve(spark, d):
    corpus = S.corpus(spark, d).withColumn("text", F.concat(F.lit("capital social "), "text"))
    ents = law_scope(spark, d).select("question_id").distinct().select(
        "question_id", F.posexplode(F.array(F.lit("sa"), F.lit("SRL"), F.lit("none"))).alias("entity_order", "entity")
    )
    primary = law_scope(spark, d).where("tier = 'tier1_primary'")
    return shown(R.entity_retrieve(ents, corpus, primary))


@add("cap_hits", S.with_(*HYBRID) + f"""SELECT {HIT_COLS} FROM (SELECT *, row_number() OVER
 (PARTITION BY question_id ORDER BY coalesce(distance, 1.0), arrival) AS r FROM hits) WHERE r <= 30""")
def cap_hits(spark, d):
    return shown(R.cap_hits(_hybrid(spark, d)).drop("arrival"))


RERANKED = """ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY reranker_score DESC, arrival) AS rank FROM
 (SELECT h.*, least(20, 5 + 5 * (h.question_id % 4)) AS k, round(coalesce(CAST(l.quality AS DOUBLE),
   CASE WHEN distance IS NOT NULL THEN greatest(0.0, 1 - distance / 2) WHEN bm25_rank IS NOT NULL THEN greatest(-bm25_rank, 0) / (1 + greatest(-bm25_rank, 0)) ELSE 0.5 END)
   + CASE WHEN role = 'PRIMARY' THEN 0.15 ELSE 0.0 END, 12) AS reranker_score
  FROM hits h LEFT JOIN labels l USING (doc_id))) WHERE rank <= k)"""


def reranked(spark, d):
    scores = (
        S.load(spark, d, "labels")
        .select("doc_id", F.col("quality").cast("double").alias("model_score"))
        .join(S.corpus(spark, d).select("doc_type", "doc_id"), "doc_id")
    )
    # read twice below, so the hits are found and written once
    hits = written(_hybrid(spark, d).withColumn("k", R.dynamic_k(F.col("question_id") % 4)), "hits")
    asked = hits.select("question_id", "doc_type", "doc_id").join(scores, ["doc_type", "doc_id"])
    return R.rerank(hits, asked, F.col("k"))


@add("rerank", S.with_(*HYBRID, RERANKED) + f"SELECT {HIT_COLS}, k, round(reranker_score, 6) AS reranker_score, rank FROM ranked")
def rerank(spark, d):
    return shown(reranked(spark, d).drop("arrival"))


@add("amendment_lines", S.with_(*HYBRID) + """SELECT h.question_id, h.doc_id AS article_id, l_orderkey * 10 + l_linenumber AS note_id,
 '[Amendment: ' || l_returnflag || ' ' || l_linestatus || ']' AS line FROM hits h JOIN
 (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2) ON l_orderkey = h.doc_id
 WHERE h.doc_type = 'article' AND l_returnflag <> 'N'""")
def amendment_lines(spark, d):
    li = S.load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s")
    )
    notes = li.select(
        F.col("l_orderkey").alias("article_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("note_id"),
        F.when(F.col("f") != "N", F.concat_ws(" ", F.lit(" "), "f", "s")).otherwise("  ").alias("text"),
    )
    return R.amendment_lines(_hybrid(spark, d), notes)


@add("union_corpus", S.with_(S.CORPUS) + """SELECT doc_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM corpus GROUP BY 1""")
def union_corpus(spark, d):
    """Articles and annexes as one typed relation."""
    docs = S.load(spark, d, "documents").select("doc_id", "text", "lang")
    art = docs.where("lang = 'en'").select(F.lit("article").alias("doc_type"), "doc_id", "text")
    anx = docs.where("lang <> 'en'").select(F.lit("annex").alias("doc_type"), "doc_id", "text", F.col("lang").alias("annex_title"))
    both = art.unionByName(anx, allowMissingColumns=True)
    return both.groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@add("first_seen", """SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def first_seen_query(spark, d):
    return first_seen(S.load(spark, d, "documents").select("doc_id", "source", "lang"), ["lang", "source"], ["doc_id"])


@add("group_topk", """SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER
 (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def group_topk(spark, d):
    o = S.load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).drop("o_totalprice")


GOVERNING = S.with_(
    S.QUESTIONS, S.CORPUS, S.DOC_VECTORS, S.QUERY_VECTORS,
    "need AS (SELECT * FROM questions)",
    "nvec AS (SELECT * FROM qvec WHERE question_id IN (SELECT question_id FROM need) AND vector[1] > 0)",
    "gscope AS (SELECT DISTINCT question_id, (question_id + j) % 20 AS version_id FROM need, range(6) t(j))",
    "exact AS (SELECT question_id, c.doc_type, c.doc_id FROM need JOIN corpus c ON c.doc_id = question_id * 7 WHERE question_id % 4 = 0)",
    "lastq AS (SELECT * FROM need WHERE question_id NOT IN (SELECT question_id FROM exact) AND question_id NOT IN (SELECT question_id FROM nvec))",
    bm25_sql("lastq", "gscope"),
) + f"""SELECT *, 'exact' AS strategy FROM exact UNION ALL
 SELECT question_id, doc_type, vec_id, 'semantic' FROM (SELECT q.question_id, v.doc_type, vec_id, row_number() OVER (PARTITION BY q.question_id ORDER BY {DIST}, vec_id, doc_type) AS r
  FROM nvec q JOIN gscope s ON s.question_id = q.question_id JOIN docvec v ON v.version_id = s.version_id
  WHERE q.question_id NOT IN (SELECT question_id FROM exact)) WHERE r <= 5 UNION ALL
 SELECT question_id, doc_type, doc_id, 'bm25' FROM (SELECT *, {TOPK} AS r FROM scores) WHERE r <= 5"""


@add("governing_norm", GOVERNING)
def governing_norm(spark, d):
    q = S.questions(spark, d)
    need = q
    corpus = S.corpus(spark, d)
    exact = need.where("question_id % 4 = 0").select("question_id", (F.col("question_id") * 7).alias("doc_id")).join(
        corpus.select("doc_type", "doc_id"), "doc_id"
    )
    scope = need.select("question_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j")).select(
        "question_id", ((F.col("question_id") + F.col("j")) % 20).alias("version_id")
    )
    known = question_vectors(spark, d).where(F.element_at("vector", 1) > 0)
    return R.fetch_governing_norm(need, exact, known, S.doc_vectors(spark, d), need, corpus, scope)
