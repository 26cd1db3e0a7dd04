"""Driver queries of the expansion, gate, citation and context operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.operators import answer as A
from palimpsest.operators import graph as G
from palimpsest.operators import versions as V
from palimpsest.plans import standins as S
from palimpsest.plans.registry import REGISTRY
from palimpsest.plans.versions import FOUND, REFS, SELECT_CTES, TODAY, found, selected
from palimpsest.session import scratch_folder

add = REGISTRY.add
NAMES = {"c.muncii": ("53", 2013)}

# hits of questions: the articles whose line is finished, asked about by the law of their version
HITS = """hits AS (SELECT o_custkey % 40 AS question_id, o_custkey AS law_id, a.*, article_id AS arrival FROM articles a JOIN orders ON o_orderkey = version_id
 WHERE full_text LIKE '%partea F')"""
NOTES = """notes AS (SELECT l_orderkey * 1000 + l_linenumber AS article_id, l_orderkey * 10 + l_linenumber AS note_id,
 'Completat de art. ' || CAST(max(l_suppkey) % 9 AS VARCHAR) AS text FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
INDEX = "idx AS (SELECT version_id, article_number, min(article_id) AS article_id FROM articles GROUP BY 1, 2)"


def hits(spark, d):
    o = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("law_id"))
    a = S.articles(spark, d).where(F.endswith("full_text", F.lit("partea F")))
    return a.join(o, "version_id").withColumn("question_id", F.col("law_id") % 40).withColumn("arrival", F.col("article_id"))


def notes(spark, d):
    li = S.load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"))
    return li.select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("article_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("note_id"),
        F.concat(F.lit("Completat de art. "), (F.col("s") % 9).cast("string")).alias("text"),
    )


NEAR = """near AS (SELECT h.question_id, h.article_id AS src_article_id, a.article_id FROM hits h JOIN articles a ON a.version_id = h.version_id
 AND a.order_index BETWEEN h.order_index - 2 AND h.order_index + 2 AND a.article_id <> h.article_id AND (h.element_id IS NULL OR a.element_id = h.element_id))"""


@add("expand_neighbors", S.with_(S.ARTICLES, HITS, NEAR) + "SELECT * FROM near")
def expand_neighbors(spark, d):
    return G.expand_neighbors(hits(spark, d), S.articles(spark, d))


REF = r"art\.\s*(\d+(?:\^\d+)?)"
XREF = f"""texts AS (SELECT question_id, article_id, version_id, full_text AS t FROM hits UNION ALL SELECT question_id, h.article_id, version_id, text FROM hits h JOIN notes USING (article_id)),
 xrefs AS (SELECT DISTINCT question_id, article_id, version_id, unnest(regexp_extract_all(t, '{REF}', 1)) AS article_number FROM texts),
 cross_ AS (SELECT DISTINCT question_id, x.article_id AS src_article_id, idx.article_id FROM xrefs x JOIN idx USING (version_id, article_number))"""


@add("expand_crossrefs", S.with_(S.ARTICLES, HITS, NOTES, INDEX, XREF) + "SELECT * FROM cross_")
def expand_crossrefs(spark, d):
    return G.expand_crossrefs(hits(spark, d), S.articles(spark, d), notes(spark, d))


DATES = f"""dates AS (SELECT question_id, CAST(least(coalesce(max(CASE WHEN relevant_date <> 'unknown' THEN relevant_date END), '{TODAY}'), '1998-01-01') AS DATE) AS primary_date FROM issues GROUP BY 1)"""
LAWREF = r"art\.\s*(\d+(?:\^\d+)?)\s+din\s+Legea\s+(?:nr\.\s*)?(\d+)/(\d{4})"
CROSSLAW = f"""lrefs AS (SELECT question_id, article_id, regexp_extract(m, '{LAWREF}', 1) AS article_number, regexp_extract(m, '{LAWREF}', 2) AS law_number, CAST(regexp_extract(m, '{LAWREF}', 3) AS INTEGER) AS law_year
  FROM (SELECT question_id, article_id, unnest(regexp_extract_all(t, '{LAWREF}')) AS m FROM texts)
  UNION SELECT question_id, article_id, unnest(regexp_extract_all(t, 'art\\.\\s*(\\d+) C\\.muncii', 1)), '53', 2013 FROM texts),
 named AS (SELECT DISTINCT l.*, laws.law_id, primary_date FROM lrefs l JOIN laws USING (law_number, law_year) LEFT JOIN dates USING (question_id)),
 chosen AS (SELECT question_id, law_id, max(version_id) AS version_id FROM selected GROUP BY 1, 2),
 pairs AS (SELECT DISTINCT question_id, law_id, primary_date FROM named),
 fits AS (SELECT question_id, p.law_id, arg_max(version_id, (date_in_force, version_id)) AS version_id FROM pairs p JOIN versions v ON v.law_id = p.law_id AND v.date_in_force <= p.primary_date GROUP BY 1, 2),
 resolved AS (SELECT p.question_id, p.law_id, coalesce(c.version_id, f.version_id, k.version_id) AS version_id FROM pairs p LEFT JOIN chosen c USING (question_id, law_id)
  LEFT JOIN fits f USING (question_id, law_id) LEFT JOIN (SELECT law_id, version_id FROM versions WHERE is_current) k ON k.law_id = p.law_id),
 crosslaw AS (SELECT DISTINCT n.question_id, n.article_id AS src_article_id, idx.article_id FROM named n JOIN resolved r USING (question_id, law_id) JOIN idx ON idx.version_id = r.version_id AND idx.article_number = n.article_number)"""
CROSSLAW_ALL = (S.ARTICLES, HITS, NOTES, INDEX, XREF, S.LAWS, *SELECT_CTES, DATES, CROSSLAW)


def _dates(spark, d):
    p = V.primary_date(S.issues(spark, d), TODAY)
    return p.select("question_id", F.least("primary_date", F.lit("1998-01-01")).cast("date").alias("primary_date"))


@add("expand_crosslaw", S.with_(*CROSSLAW_ALL) + "SELECT * FROM crosslaw")
def expand_crosslaw(spark, d):
    return G.expand_crosslaw(
        hits(spark, d), S.articles(spark, d), S.laws(spark, d), S.versions(spark, d), selected(spark, d), _dates(spark, d), NAMES, notes(spark, d)
    )


LEAD = r"(?:cu\s+excep[tț]ia\s+(?:prevederilor\s+)?|prin\s+derogare\s+de\s+la\s+(?:prevederile\s+)?)art\.\s*(\d+(?:\^\d+)?)"


def exceptions_sql(hits_name: str) -> str:
    h = hits_name
    return f"""erefs AS (SELECT DISTINCT version_id, article_id, unnest(regexp_extract_all(lower(full_text), '{LEAD}', 1)) AS ref FROM articles),
 efound AS (SELECT h.question_id, e.article_id, 'forward' AS direction, h.article_number AS via, h.arrival FROM {h} h JOIN erefs e ON e.version_id = h.version_id AND starts_with(e.ref, h.article_number)
  UNION ALL SELECT question_id, idx.article_id, 'reverse', own, arrival FROM (SELECT DISTINCT question_id, arrival, version_id, article_number AS own, unnest(regexp_extract_all(full_text, '{REF}', 1)) AS article_number
   FROM {h} WHERE regexp_matches(lower(full_text), 'cu\\s+excep[tț]ia|prin\\s+derogare')) JOIN idx USING (version_id, article_number) WHERE article_number <> own),
 excepted AS (SELECT question_id, article_id, direction, via FROM (SELECT *, row_number() OVER (PARTITION BY question_id, article_id ORDER BY arrival, direction, via) AS r FROM efound e
  WHERE NOT EXISTS (SELECT 1 FROM {h} x WHERE x.question_id = e.question_id AND x.article_id = e.article_id)) WHERE r = 1)"""


@add("expand_exceptions", S.with_(S.ARTICLES, HITS, INDEX, exceptions_sql("hits")) + "SELECT * FROM excepted")
def expand_exceptions(spark, d):
    return G.expand_exceptions(hits(spark, d), S.articles(spark, d))


EXPANDED = """linked AS (SELECT question_id, article_id FROM near UNION SELECT question_id, article_id FROM cross_ UNION SELECT question_id, article_id FROM crosslaw),
 firstnew AS (SELECT question_id, article_id FROM linked EXCEPT SELECT question_id, article_id FROM hits),
 enlarged AS (SELECT question_id, article_id, version_id, article_number, full_text, arrival FROM hits
  UNION ALL SELECT question_id, article_id, version_id, article_number, full_text, CAST(1099511627776 AS BIGINT) + article_id FROM firstnew JOIN articles USING (article_id))"""


@add("graph_expansion", S.with_(*CROSSLAW_ALL, NEAR, EXPANDED, exceptions_sql("enlarged")) + """SELECT question_id, article_id, 'expansion' AS source FROM firstnew
 UNION ALL SELECT question_id, article_id, 'exception' FROM excepted""")
def graph_expansion(spark, d):
    return G.expand(
        hits(spark, d), S.articles(spark, d), S.laws(spark, d), S.versions(spark, d), selected(spark, d), _dates(spark, d), NAMES, notes(spark, d)
    )


@add("expand_stored", REGISTRY.sql["graph_expansion"])
def expand_stored(spark, d):
    """The same expansion from edges stored in buckets."""
    a = S.articles(spark, d)
    edges = G.store_references(a, f"edges_{uuid.uuid4().hex}", path=f"{scratch_folder(spark)}/edges")
    return G.expand(
        hits(spark, d), a, S.laws(spark, d), S.versions(spark, d), selected(spark, d), _dates(spark, d), NAMES, notes(spark, d), references=edges
    )


@add("derive_role", S.with_(S.ARTICLES, HITS, S.ISSUES) + """SELECT h.question_id, h.article_id, CASE WHEN p.law_id IS NOT NULL THEN 'PRIMARY' ELSE 'SECONDARY' END AS role FROM hits h
 LEFT JOIN (SELECT DISTINCT question_id, law_id FROM issues WHERE role = 'PRIMARY') p USING (question_id, law_id)""")
def derive_role(spark, d):
    primary = S.issues(spark, d).where("role = 'PRIMARY'")
    return G.derive_role(hits(spark, d), primary).select("question_id", "article_id", "role")


ASKED = """refasked AS (SELECT o_custkey % 40 AS question_id, o_orderkey AS ref_order, 'Legea ' || o_custkey || '/' || (1990 + o_custkey % 30) || ' art. ' || (o_orderkey % 7 + 1) AS ref FROM orders)"""


@add("fetch_refs", S.with_(S.ARTICLES, INDEX, S.LAWS, *SELECT_CTES, ASKED) + f""", uniq AS (SELECT question_id, ref, min(ref_order) AS ref_order FROM refasked GROUP BY 1, 2),
 five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ref_order) AS r FROM uniq) WHERE r <= 5),
 p AS (SELECT f.*, l.law_id, regexp_extract(ref, 'art\\. (\\d+)', 1) AS article_number FROM five f JOIN laws l ON l.law_number = regexp_extract(ref, '(\\d+)/(\\d{{4}})', 1) AND l.law_year = CAST(regexp_extract(ref, '(\\d+)/(\\d{{4}})', 2) AS INTEGER)),
 v AS (SELECT DISTINCT p.question_id, p.law_id, coalesce((SELECT max(version_id) FROM selected s WHERE s.question_id = p.question_id AND s.law_id = p.law_id),
  (SELECT arg_max(version_id, (date_in_force, version_id)) FROM versions x WHERE x.law_id = p.law_id AND x.date_in_force <= DATE '{TODAY}'),
  (SELECT arg_max(version_id, (coalesce(date_in_force, DATE '0001-01-01'), version_id)) FROM versions x WHERE x.law_id = p.law_id)) AS version_id FROM p)
 SELECT p.question_id, ref_order, ref, p.law_id, v.version_id, idx.article_id FROM p JOIN v USING (question_id, law_id) JOIN idx USING (version_id, article_number)""")
def fetch_refs(spark, d):
    k, v = F.col("o_custkey"), F.col("o_orderkey")
    ref = F.concat(F.lit("Legea "), k.cast("string"), F.lit("/"), (1990 + k % 30).cast("string"), F.lit(" art. "), (v % 7 + 1).cast("string"))
    asked = S.load(spark, d, "orders").select((k % 40).alias("question_id"), v.alias("ref_order"), ref.alias("ref"))
    return G.fetch_refs(asked, S.articles(spark, d), S.laws(spark, d), S.versions(spark, d), selected(spark, d), TODAY)


PARTITIONED = """parted AS (SELECT h.question_id, h.article_id, h.version_id, coalesce(s.issue_id, 'shared') AS issue_id FROM hits h
 LEFT JOIN (SELECT DISTINCT question_id, version_id, issue_id FROM selected) s ON s.question_id = h.question_id AND s.version_id = h.version_id)"""


def partitioned(spark, d):
    return A.partition_by_issue(hits(spark, d), selected(spark, d))


@add("partition_by_issue", S.with_(S.ARTICLES, HITS, *SELECT_CTES, PARTITIONED) + "SELECT question_id, article_id, issue_id FROM parted")
def partition_by_issue(spark, d):
    return partitioned(spark, d).select("question_id", "article_id", "issue_id")


@add("issue_counts", S.with_(S.ARTICLES, HITS, *SELECT_CTES, PARTITIONED) + "SELECT question_id, issue_id, CAST(count(*) AS BIGINT) AS articles FROM parted GROUP BY 1, 2")
def issue_counts(spark, d):
    return A.issue_counts(partitioned(spark, d))


EMPTY = """SELECT DISTINCT i.question_id, i.issue_id, 'ISSUE ' || i.issue_id || ': no articles matched after partitioning' AS flag FROM (SELECT question_id, issue_id FROM issues UNION ALL SELECT c_custkey, 'ISSUE-9' FROM customer) i
 WHERE NOT EXISTS (SELECT 1 FROM parted p WHERE p.question_id = i.question_id AND p.issue_id = i.issue_id)"""


def _more_issues(spark, d):
    extra = S.load(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), F.lit("ISSUE-9").alias("issue_id"))
    return S.issues(spark, d).select("question_id", "issue_id").unionByName(extra)


@add("empty_issues", S.with_(S.ARTICLES, HITS, *SELECT_CTES, PARTITIONED) + EMPTY)
def empty_issues(spark, d):
    return A.empty_issues(_more_issues(spark, d), partitioned(spark, d))


@add("analysis_coverage", S.with_(S.ISSUES) + """SELECT DISTINCT c_custkey AS question_id, 'ISSUE-9' AS issue_id, 'ISSUE-9: not analyzed by reasoning step' AS flag FROM customer""")
def analysis_coverage(spark, d):
    return A.analysis_coverage(_more_issues(spark, d), S.issues(spark, d))


@add("certainty_rollup", """SELECT o_custkey AS question_id, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'LOW' WHEN bool_or(o_orderpriority = '2-HIGH') THEN 'MEDIUM' ELSE 'HIGH' END AS derived_confidence FROM orders GROUP BY 1""")
def certainty_rollup(spark, d):
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "UNCERTAIN").when(F.col("o_orderpriority") == "2-HIGH", "CONDITIONAL").otherwise("CERTAIN")
    return A.certainty_rollup(S.load(spark, d, "orders").select(F.col("o_custkey").alias("question_id"), level.alias("certainty_level")))


# candidates of questions, four each; ranked scores of questions from account balances
CAND = """cand AS (SELECT ref_id % 500 AS question_id, ref_id, law_number, law_year, title, law_id, CASE WHEN ref_id % 2 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role,
 CASE WHEN ref_id % 2 = 0 THEN 'tier1_primary' ELSE 'tier2_secondary' END AS tier FROM found)"""
ASKERS = "askers AS (SELECT DISTINCT c_custkey % 600 AS question_id FROM customer)"
SCORES = "rankedq AS (SELECT c_custkey % 450 AS question_id, round(c_acctbal / 20000, 6) AS reranker_score FROM customer)"


def _cand(spark, d):
    c = found(spark, d)
    even = F.col("ref_id") % 2 == 0
    return c.select(
        (F.col("ref_id") % 500).alias("question_id"), "ref_id", "law_number", "law_year", "title", "law_id", "relevant_date",
        F.when(even, "PRIMARY").otherwise("SECONDARY").alias("role"), F.when(even, "tier1_primary").otherwise("tier2_secondary").alias("tier"),
    )


def _askers(spark, d):
    return S.load(spark, d, "customer").select((F.col("c_custkey") % 600).alias("question_id")).distinct()


@add("relevance_gate", S.with_(S.LAWS, REFS, FOUND, CAND, ASKERS, SCORES) + """, t AS (SELECT question_id, max(reranker_score) AS top, avg(reranker_score) AS av FROM rankedq GROUP BY 1),
 p AS (SELECT question_id, count(*) FILTER (law_id IS NULL) AS missing, count(*) FILTER (law_id IS NOT NULL) AS held FROM cand WHERE tier = 'tier1_primary' GROUP BY 1),
 j AS (SELECT question_id, top, av, least(1.0, greatest(0.0, top)) AS s, coalesce(missing, 0) AS missing, coalesce(held, 0) AS held FROM askers LEFT JOIN t USING (question_id) LEFT JOIN p USING (question_id))
 SELECT question_id, CASE WHEN top IS NOT NULL THEN round(s, 3) END AS relevance_score, round(top, 3) + 0.0 AS top_reranker_score, round(av, 3) + 0.0 AS avg_reranker_score,
 top IS NOT NULL AND s < 0.3 AS gate_triggered, top IS NOT NULL AND s >= 0.3 AND s < 0.5 AS gate_warning,
 CASE WHEN top IS NULL THEN 'skipped' WHEN s >= 0.5 THEN 'ok' WHEN s >= 0.3 THEN 'warning' WHEN held > 0 AND missing = 0 THEN 'proceed' WHEN missing > 0 THEN 'needs_import' ELSE 'clarification' END AS outcome FROM j""")
def relevance_gate(spark, d):
    ranked = S.load(spark, d, "customer").select((F.col("c_custkey") % 450).alias("question_id"), F.round(F.col("c_acctbal") / 20000, 6).alias("reranker_score"))
    return A.relevance_gate(_askers(spark, d), ranked, _cand(spark, d))


# two thirds of the candidates are asked for on a day early in the history
AVAIL = """avail AS (SELECT c.*, CASE WHEN (SELECT count(*) FROM versions v WHERE v.law_id = c.law_id) = 0 THEN 'missing'
  WHEN c.ref_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.law_id = c.law_id AND v.date_in_force <= DATE '1996-06-01') THEN 'wrong_version' ELSE 'available' END AS availability,
 k.ver_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.law_id = k.law_id AND v.ver_id = k.ver_id) AS stale,
 CAST(coalesce((SELECT max(date_in_force) FROM versions v WHERE v.law_id = c.law_id AND c.ref_id % 3 <> 0 AND v.date_in_force <= DATE '1996-06-01'),
  (SELECT min(date_in_force) FROM versions v WHERE v.law_id = c.law_id)) AS VARCHAR) AS have, CAST(k.date_in_force AS VARCHAR) AS official
 FROM cand c LEFT JOIN (SELECT * FROM known WHERE is_current) k ON k.law_id = c.law_id)"""


def _covered(spark, d):
    none = F.lit(None)
    c = _cand(spark, d).withColumn("relevant_date", F.when(F.col("ref_id") % 3 != 0, F.lit("1996-06-01").cast("date")))
    c = V.version_availability(c, S.versions(spark, d))
    return V.version_status(c, S.known(spark, d), S.versions(spark, d)).withColumn("currency_status", none.cast("string"))


@add("coverage_gate", S.with_(S.LAWS, S.VERSIONS, REFS, FOUND, CAND, ASKERS, AVAIL) + """, s AS (SELECT question_id, count(*) FILTER (availability = 'missing') AS missing, count(*) FILTER (availability = 'wrong_version') AS wrong, count(*) FILTER (stale) AS stale FROM avail GROUP BY 1)
 SELECT question_id, CAST(coalesce(missing, 0) AS BIGINT) AS missing, CAST(coalesce(wrong, 0) AS BIGINT) AS wrong_version, CAST(coalesce(s.stale, 0) AS BIGINT) AS stale,
 CASE WHEN missing IS NULL THEN 'clarification' WHEN missing > 0 OR wrong > 0 OR s.stale > 0 THEN 'pause' ELSE 'continue' END AS outcome FROM askers LEFT JOIN s USING (question_id)""")
def coverage_gate(spark, d):
    return A.coverage_gate(_askers(spark, d), _covered(spark, d))


@add("coverage_recheck", S.with_(S.LAWS, S.VERSIONS, REFS, FOUND, CAND, ASKERS, AVAIL) + """, s AS (SELECT question_id, count(*) FILTER (availability = 'missing') AS missing, count(*) FILTER (availability = 'wrong_version') AS wrong FROM avail WHERE role = 'PRIMARY' GROUP BY 1)
 SELECT question_id, CAST(coalesce(missing, 0) AS BIGINT) AS missing, CAST(coalesce(wrong, 0) AS BIGINT) AS wrong_version, CAST(0 AS BIGINT) AS stale, CASE WHEN missing > 0 THEN 'error_missing' WHEN wrong > 0 THEN 'error_wrong_version' ELSE 'continue' END AS outcome FROM askers LEFT JOIN s USING (question_id)""")
def coverage_recheck(spark, d):
    return A.coverage_gate(_askers(spark, d), _covered(spark, d), recheck=True)


@add("coverage_lines", S.with_(S.LAWS, S.VERSIONS, REFS, FOUND, CAND, AVAIL) + """, n AS (SELECT *, coalesce(title, '') || ' (' || law_number || '/' || law_year || ')' AS name FROM avail)
 SELECT question_id, availability AS reason, name AS line FROM n WHERE availability IN ('missing', 'wrong_version') UNION ALL
 SELECT question_id, 'stale', name || ' — ' || coalesce(have, '?') || ' < ' || coalesce(official, '?') FROM n WHERE stale""")
def coverage_lines(spark, d):
    return A.coverage_lines(_covered(spark, d))


@add("missing_law_mentions", S.with_(S.LAWS) + """, t AS (SELECT DISTINCT o_custkey % 40 AS question_id, CAST(o_custkey AS VARCHAR) AS law_number, CAST(1990 + o_custkey % 31 AS INTEGER) AS law_year FROM orders)
 SELECT t.*, l.law_id IS NOT NULL AS in_library FROM t LEFT JOIN laws l USING (law_number, law_year) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 40 = t.question_id AND CAST(c_custkey AS VARCHAR) = t.law_number
 AND 1990 + c_custkey % 30 = t.law_year AND c_mktsegment = 'BUILDING')""")
def missing_law_mentions(spark, d):
    k = F.col("o_custkey")
    text = F.concat(F.lit("vezi Legea "), k.cast("string"), F.lit("/"), (1990 + k % 31).cast("string"), F.lit(" si altele"))
    texts = S.load(spark, d, "orders").select((k % 40).alias("question_id"), text.alias("text"))
    cand = S.laws(spark, d).where("document_type = 'BUILDING'").withColumn("question_id", F.col("law_id") % 40)
    return A.missing_law_mentions(texts, cand, S.laws(spark, d))


# citations of all lines against the finished ones; the law is the order, the year its order's year
CITED = """cited AS (SELECT l_suppkey AS run_id, l_orderkey * 10000000 + l_partkey * 100 + l_linenumber AS cite_id, 'Legea ' || l_orderkey || ' / ' || (1990 + l_orderkey % 20) AS law, 'Art. ' || l_linenumber AS article,
 CASE l_returnflag WHEN 'A' THEN 'DB' WHEN 'R' THEN 'DB' ELSE 'Unverified' END AS label, l_orderkey, l_linenumber FROM lineitem),
 given AS (SELECT DISTINCT l_suppkey AS run_id, l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F'),
 checked AS (SELECT c.*, CASE WHEN label = 'DB' AND g.run_id IS NULL THEN 'Unverified' ELSE label END AS new_label FROM cited c LEFT JOIN given g USING (run_id, l_orderkey, l_linenumber))"""


def _cited(spark, d):
    li = S.load(spark, d, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(
        F.col("l_suppkey").alias("run_id"),
        (k * 10000000 + F.col("l_partkey") * 100 + n).alias("cite_id"),
        F.concat(F.lit("Legea "), k.cast("string"), F.lit(" / "), (1990 + k % 20).cast("string")).alias("law"),
        F.concat(F.lit("Art. "), n.cast("string")).alias("article"),
        F.when(F.col("l_returnflag").isin("A", "R"), "DB").otherwise("Unverified").alias("label"),
    )


def _given(spark, d):
    li = S.load(spark, d, "lineitem").where("l_linestatus = 'F'")
    return li.select(
        F.col("l_suppkey").alias("run_id"), F.col("l_orderkey").cast("string").alias("law_number"),
        (1990 + F.col("l_orderkey") % 20).alias("law_year"), F.col("l_linenumber").cast("string").alias("article_number"),
    )


@add("validate_citations", S.with_(CITED) + "SELECT run_id, cite_id, label AS original_label, new_label AS label FROM checked")
def validate_citations(spark, d):
    return A.validate_citations(_cited(spark, d), _given(spark, d)).select("run_id", "cite_id", "original_label", "label")


@add("citation_counts", S.with_(CITED) + """SELECT *, total_db > 0 AND downgraded > total_db / 2 AS confidence_downgraded FROM (SELECT run_id, CAST(count(*) FILTER (label = 'DB' AND new_label = 'DB') AS BIGINT) AS validated,
 CAST(count(*) FILTER (label = 'DB' AND new_label = 'Unverified') AS BIGINT) AS downgraded, CAST(count(*) AS BIGINT) AS total_db FROM checked GROUP BY 1)""")
def citation_counts(spark, d):
    return A.citation_counts(A.validate_citations(_cited(spark, d), _given(spark, d)))


@add("citation_coverage", S.with_(CITED) + """SELECT run_id, CAST(count(*) AS BIGINT) AS sources_count, CAST(count(DISTINCT article) FILTER (label = 'DB') AS BIGINT) AS articles_cited,
 CAST(coalesce(any_value(n), 0) - count(DISTINCT article) FILTER (label = 'DB') AS BIGINT) AS articles_not_cited, CAST(count(DISTINCT law || article) FILTER (label = 'DB') AS BIGINT) AS law_articles_cited
 FROM cited LEFT JOIN (SELECT l_suppkey AS run_id, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) USING (run_id) GROUP BY 1""")
def citation_coverage(spark, d):
    return A.citation_coverage(_cited(spark, d), _given(spark, d))


@add("retrieval_breakdown", """SELECT o_custkey AS question_id, CAST(count(*) AS BIGINT) AS articles_found,
 CAST(count(*) FILTER (src = 'bm25' OR coalesce(br <> 0, false)) AS BIGINT) AS bm25_count, CAST(count(*) FILTER (dist IS NOT NULL AND coalesce(br = 0, true)) AS BIGINT) AS semantic_count,
 CAST(count(*) FILTER (tier = 'entity_targeted') AS BIGINT) AS entity_count, CAST(count(*) FILTER (src = 'expansion') AS BIGINT) AS expansion_added, CAST(count(*) FILTER (src = 'exception') AS BIGINT) AS exceptions_added
 FROM (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'bm25' WHEN '2-HIGH' THEN 'semantic' WHEN '4-NOT SPECIFIED' THEN 'expansion' WHEN '5-LOW' THEN 'exception' ELSE 'entity:SA' END AS src,
  CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM') THEN -o_totalprice WHEN o_orderstatus = 'F' THEN 0.0 END AS br, CASE WHEN o_orderpriority = '2-HIGH' THEN 0.5 END AS dist,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'entity_targeted' ELSE 'tier1_primary' END AS tier FROM orders) GROUP BY 1""")
def retrieval_breakdown(spark, d):
    p = F.col("o_orderpriority")
    rows = S.load(spark, d, "orders").select(
        F.col("o_custkey").alias("question_id"),
        F.when(p == "1-URGENT", "bm25").when(p == "2-HIGH", "semantic").when(p == "4-NOT SPECIFIED", "expansion").when(p == "5-LOW", "exception").otherwise("entity:SA").alias("source"),
        F.when(p.isin("1-URGENT", "3-MEDIUM"), -F.col("o_totalprice")).when(F.col("o_orderstatus") == "F", 0.0).alias("bm25_rank"),
        F.when(p == "2-HIGH", 0.5).alias("distance"),
        F.when(p == "3-MEDIUM", "entity_targeted").otherwise("tier1_primary").alias("tier"),
    )
    return A.retrieval_breakdown(rows)


@add("top_ranked", """SELECT question_id, doc_type, doc_id, score, rank FROM (SELECT o_custkey AS question_id, o_orderstatus AS doc_type, o_orderkey AS doc_id, round(o_totalprice / 500000, 3) AS score,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10""")
def top_ranked(spark, d):
    from palimpsest.operators.core import top_k

    o = S.load(spark, d, "orders").select(
        F.col("o_custkey").alias("question_id"), F.col("o_orderstatus").alias("doc_type"), F.col("o_orderkey").alias("doc_id"),
        (F.col("o_totalprice") / 500000).alias("reranker_score"), "o_totalprice",
    )
    ranked = top_k(o, ["question_id"], [F.desc("o_totalprice"), F.asc("doc_id")], 20)
    return A.top_ranked(ranked)


CONF = """SELECT o_orderkey AS run_id, CASE WHEN low IS NOT NULL THEN 'LOW' WHEN cap IS NOT NULL AND mc NOT IN ('LOW', 'MEDIUM') THEN 'MEDIUM' ELSE mc END AS confidence,
 CASE WHEN low IS NOT NULL THEN low WHEN cap IS NOT NULL AND mc NOT IN ('LOW', 'MEDIUM') THEN cap ELSE 'Based on model assessment' END AS reason FROM (SELECT o_orderkey,
 CASE o_orderkey % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS mc,
 CASE WHEN o_orderkey % 11 = 0 THEN 'No relevant articles found' WHEN o_orderkey % 4 > 2 THEN 'Most citations could not be verified against provided articles'
  WHEN o_orderpriority = '1-URGENT' THEN 'Legal analysis has uncertain conditions' WHEN o_orderkey % 13 = 0 THEN 'Governing norm for primary issue not found' END AS low,
 CASE WHEN o_orderpriority = '2-HIGH' THEN 'Legal analysis has conditional conclusions' WHEN o_orderkey % 7 = 0 THEN 'Library gap: gap ' || o_orderkey WHEN o_orderkey % 8 > 5 THEN 'Majority of legal conditions could not be evaluated'
  WHEN o_orderstatus = 'P' THEN 'Primary law source not from verified database' WHEN o_orderkey % 3 = 0 THEN 'Primary law not in library' WHEN o_orderkey % 17 = 0 THEN 'Law version may be outdated' END AS cap FROM orders)"""


@add("derive_confidence", CONF)
def derive_confidence(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    level = F.when(p == "1-URGENT", "UNCERTAIN").when(p == "2-HIGH", "CONDITIONAL").otherwise("CERTAIN")
    none = F.array().cast("array<string>")
    rows = S.load(spark, d, "orders").select(
        k.alias("run_id"),
        F.when(k % 5 == 0, "LOW").when(k % 5 == 1, "MEDIUM").otherwise("HIGH").alias("model_confidence"),
        F.array(F.lit("CERTAIN"), level).alias("levels"),
        (k % 11 != 0).alias("has_articles"),
        (F.col("o_orderstatus") != "P").alias("primary_from_db"),
        (k % 3 == 0).alias("missing_primary"),
        (k % 17 == 0).alias("has_stale_versions"),
        (k % 4).alias("downgraded"),
        F.lit(4).alias("total_db"),
        (k % 13 == 0).alias("governing_norm_incomplete"),
        F.when(k % 7 == 0, F.array(F.concat(F.lit("gap "), k.cast("string")))).otherwise(none).alias("gaps"),
        F.array(F.struct(F.lit(10).cast("long").alias("total"), (k % 8).alias("unknown"))).alias("conditions"),
    )
    return A.derive_confidence(rows).select("run_id", "confidence", "reason")


CONTEXT = S.with_(S.ARTICLES, HITS, *SELECT_CTES, PARTITIONED) + """, r AS (SELECT p.*, h.article_number, h.full_text, 'Law ' || h.law_id AS law_title, CAST(h.law_id AS VARCHAR) AS law_number, 1990 + h.law_id % 30 AS law_year, h.article_id AS rank
 FROM parted p JOIN hits h ON h.question_id = p.question_id AND h.article_id = p.article_id),
 heads AS (SELECT question_id, issue_id, min(relevant_date) AS d0, bool_or(relevant_date IS NULL) AS n FROM issues GROUP BY 1, 2),
 f AS (SELECT item_id AS question_id, k.kind, k.sec, k.title FROM benchmark, (VALUES ('stated', 0, 'STATED FACTS:'), ('assumed', 1, 'ASSUMED FACTS:'), ('missing', 2, 'MISSING FACTS (identified by classifier):')) k(kind, sec, title))
 SELECT question_id, sec AS section, '' AS part, CAST(-1 AS BIGINT) AS place, title AS line FROM f
 UNION ALL SELECT question_id, sec, '', 0, '  F' || sec || ': ' || kind || CASE WHEN sec = 0 THEN ' (2000-01-01)' ELSE '' END FROM f
 UNION ALL SELECT question_id, 3, issue_id, -3, issue_id || ': about ' || issue_id FROM heads
 UNION ALL SELECT question_id, 3, issue_id, -2, '  Relevant date: ' || CASE WHEN n THEN 'unknown' ELSE d0 END FROM heads
 UNION ALL SELECT question_id, 3, issue_id, -1, '  Articles:' FROM heads
 UNION ALL SELECT question_id, 3, issue_id, rank * 2, '    [Art. ' || article_number || '] ' || law_title || ' (' || law_number || '/' || law_year || ')' FROM r WHERE issue_id <> 'shared'
 UNION ALL SELECT question_id, 3, issue_id, rank * 2 + 1, '    ' || full_text FROM r WHERE issue_id <> 'shared'
 UNION ALL SELECT DISTINCT question_id, 4, '', -1, 'SHARED CONTEXT (SECONDARY):' FROM r WHERE issue_id = 'shared'
 UNION ALL SELECT question_id, 4, '', rank * 2, '  [Art. ' || article_number || '] ' || law_title || ' (' || law_number || '/' || law_year || ')' FROM r WHERE issue_id = 'shared'
 UNION ALL SELECT question_id, 4, '', rank * 2 + 1, '  ' || full_text FROM r WHERE issue_id = 'shared'
 UNION ALL SELECT question_id, 5, '', -1, 'FLAGS AND WARNINGS:' FROM (SELECT DISTINCT question_id FROM f)
 UNION ALL SELECT question_id, 5, '', 1, '  - flag one' FROM (SELECT DISTINCT question_id FROM f)"""


@add("context_lines", CONTEXT)
def context_lines(spark, d):
    h = partitioned(spark, d).select(
        "question_id", "issue_id", "article_number", F.concat(F.lit("Law "), F.col("law_id").cast("string")).alias("law_title"),
        F.col("law_id").cast("string").alias("law_number"), (1990 + F.col("law_id") % 30).alias("law_year"), F.col("full_text").alias("text"), F.col("article_id").alias("rank"),
    )
    issues = S.issues(spark, d).withColumn("description", F.concat(F.lit("about "), "issue_id"))
    q = S.questions(spark, d)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f"F{i}").alias("fact_id"), F.lit("2000-01-01" if i == 0 else None).alias("date")) for i, k in enumerate(("stated", "assumed", "missing"))])
    facts = q.select("question_id", F.inline(kinds)).withColumn("description", F.col("kind")).withColumn("place", F.lit(0))
    flags = q.select("question_id", F.lit("flag one").alias("flag"), F.lit(1).alias("place"))
    return A.context_lines(issues, h, facts, flags)


@add("operative_first", S.with_(S.ARTICLES, HITS) + """SELECT h.question_id, h.article_id, EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey % 40 = h.question_id AND starts_with(CAST(c.c_nationkey AS VARCHAR), h.article_number)) AS operative FROM hits h""")
def operative_first(spark, d):
    ops = S.load(spark, d, "customer").select(
        (F.col("c_custkey") % 40).alias("question_id"), F.concat(F.lit("Legea 31/1990 art."), F.col("c_nationkey").cast("string"), F.lit(" alin.(3)")).alias("article_ref")
    )
    return A.operative_first(hits(spark, d), ops).select("question_id", "article_id", "operative")


