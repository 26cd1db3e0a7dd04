"""Driver queries of the version operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dates as D
from palimpsest.operators import versions as V
from palimpsest.operators.core import number_rows
from palimpsest.plans import standins as S
from palimpsest.plans.registry import REGISTRY

add = REGISTRY.add
TODAY = S.TODAY


def text_day(c):
    return F.col(c).cast("string")


# references: part keys stand for law numbers, some beyond the library
REFS = """refs AS (SELECT p_partkey AS ref_id, CAST(p_partkey AS VARCHAR) AS law_number, CAST(1990 + p_partkey % 30 AS INTEGER) AS law_year,
 CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE '' END AS title,
 CASE WHEN p_partkey % 3 <> 0 THEN CAST(DATE '1995-06-01' + CAST(p_partkey % 2300 AS INTEGER) AS DATE) END AS relevant_date FROM part)"""


def refs(spark, d):
    p = S.load(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("ref_id"),
        k.cast("string").alias("law_number"),
        (F.lit(1990) + k % 30).cast("int").alias("law_year"),
        F.when(k % 5 == 0, F.col("p_name")).otherwise("").alias("title"),
        F.when(k % 3 != 0, F.date_add(F.lit("1995-06-01").cast("date"), (k % 2300).cast("int"))).alias("relevant_date"),
    )


FOUND = """found AS (SELECT r.ref_id, r.law_number, r.law_year, coalesce(nullif(r.title, ''), l.title) AS title, l.law_id, l.law_id IS NOT NULL AS in_library,
 r.relevant_date FROM refs r LEFT JOIN laws l ON l.law_number = r.law_number AND l.law_year = r.law_year)"""


def found(spark, d):
    return V.lookup_laws(refs(spark, d), S.laws(spark, d))


@add("law_lookup", S.with_(S.LAWS, REFS, FOUND) + "SELECT ref_id, title, coalesce(law_id, -1) AS law_id, in_library FROM found")
def law_lookup(spark, d):
    return found(spark, d).select("ref_id", "title", F.coalesce("law_id", F.lit(-1)).alias("law_id"), "in_library")


@add("version_availability", S.with_(S.LAWS, S.VERSIONS, REFS, FOUND) + """SELECT ref_id,
 CASE WHEN any_id IS NULL THEN 'missing' WHEN relevant_date IS NULL OR hit IS NOT NULL THEN 'available' ELSE 'wrong_version' END AS availability,
 CAST(CASE WHEN relevant_date IS NOT NULL AND hit IS NOT NULL THEN hit ELSE any_date END AS VARCHAR) AS available_version_date FROM (
 SELECT f.ref_id, f.relevant_date, (SELECT max(v.date_in_force) FROM versions v WHERE v.law_id = f.law_id AND v.date_in_force <= f.relevant_date) AS hit,
  (SELECT min(v.date_in_force) FROM versions v WHERE v.law_id = f.law_id) AS any_date,
  (SELECT min(v.version_id) FROM versions v WHERE v.law_id = f.law_id) AS any_id FROM found f)""")
def version_availability(spark, d):
    out = V.version_availability(found(spark, d), S.versions(spark, d))
    return out.select("ref_id", "availability", text_day("available_version_date").alias("available_version_date"))


@add("version_status", S.with_(S.LAWS, S.VERSIONS, REFS, FOUND) + """SELECT ref_id,
 CASE WHEN k.ver_id IS NULL THEN 'not_checked' WHEN v.ver_id IS NOT NULL THEN 'up_to_date' ELSE 'stale' END AS version_status,
 CASE WHEN k.ver_id IS NOT NULL AND v.ver_id IS NULL THEN CAST(k.ver_id AS VARCHAR) END AS official_current_ver_id,
 CASE WHEN k.ver_id IS NOT NULL AND v.ver_id IS NULL THEN CAST(k.date_in_force AS VARCHAR) END AS official_current_date
 FROM found f LEFT JOIN (SELECT * FROM known WHERE is_current) k ON k.law_id = f.law_id LEFT JOIN versions v ON v.law_id = k.law_id AND v.ver_id = k.ver_id""")
def version_status(spark, d):
    out = V.version_status(found(spark, d), S.known(spark, d), S.versions(spark, d))
    return out.select(
        "ref_id", "version_status", text_day("official_current_ver_id").alias("official_current_ver_id"),
        text_day("official_current_date").alias("official_current_date"),
    )


SELECTED = f"""dated AS (SELECT *, coalesce(relevant_date, '{TODAY}') AS g,
 CASE WHEN coalesce(relevant_date, '{TODAY}') = 'unknown' THEN '{TODAY}' ELSE coalesce(relevant_date, '{TODAY}') END AS a FROM issues),
 asked AS (SELECT *, a > '{TODAY}' AS is_future, CAST(least(a, '{TODAY}') AS DATE) AS effective_date FROM dated),
 ranked AS (SELECT a.*, v.version_id, v.date_in_force, v.is_current, v.ver_id, coalesce(v.date_in_force <= a.effective_date, false) AS fits,
  row_number() OVER (PARTITION BY a.question_id, a.issue_id, a.law_id ORDER BY
   coalesce(v.date_in_force <= a.effective_date, false) DESC,
   CASE WHEN v.date_in_force <= a.effective_date THEN v.date_in_force END DESC NULLS LAST,
   CASE WHEN v.date_in_force <= a.effective_date THEN v.version_id END DESC NULLS LAST,
   v.is_current DESC, v.date_in_force DESC NULLS LAST, v.version_id DESC) AS rn
  FROM asked a JOIN versions v ON v.law_id = a.law_id),
 selected AS (SELECT question_id, issue_id, law_id, relevant_date, effective_date, version_id, date_in_force, is_current, ver_id, NOT fits AS is_fallback, is_future
  FROM ranked WHERE rn = 1)"""
SELECT_CTES = (S.VERSIONS, S.ISSUES, SELECTED)


def selected(spark, d):
    return V.select_versions(S.issues(spark, d), S.versions(spark, d), TODAY)


@add("select_versions", S.with_(*SELECT_CTES) + """SELECT question_id, issue_id, law_id, CAST(effective_date AS VARCHAR) AS effective_date, version_id,
 CAST(date_in_force AS VARCHAR) AS date_in_force, is_current, is_fallback FROM selected""")
def select_versions(spark, d):
    return selected(spark, d).select(
        "question_id", "issue_id", "law_id", text_day("effective_date").alias("effective_date"), "version_id",
        text_day("date_in_force").alias("date_in_force"), "is_current", "is_fallback",
    )


@add("latest_selected", S.with_(*SELECT_CTES) + """SELECT question_id, law_id, version_id, CAST(date_in_force AS VARCHAR) AS date_in_force FROM
 (SELECT *, row_number() OVER (PARTITION BY question_id, law_id ORDER BY date_in_force DESC NULLS LAST, version_id DESC) AS r FROM selected) WHERE r = 1""")
def latest_selected(spark, d):
    return V.latest_selected(selected(spark, d)).select("question_id", "law_id", "version_id", text_day("date_in_force").alias("date_in_force"))


@add("selected_set", S.with_(*SELECT_CTES) + "SELECT DISTINCT question_id, law_id, version_id FROM selected")
def selected_set(spark, d):
    return V.selected_set(selected(spark, d))


@add("version_notes", S.with_(*SELECT_CTES) + """SELECT DISTINCT question_id, issue_id || ': Event date ' || relevant_date || ' is in the future — using current law' AS note FROM selected WHERE is_future
 UNION ALL SELECT question_id, issue_id || ':' || law_id || ': No version for ' || effective_date || ', using current' FROM selected WHERE is_fallback
 UNION ALL SELECT question_id, law_id || ': Using version from ' || date_in_force || ' (not the current version)' FROM
 (SELECT *, row_number() OVER (PARTITION BY question_id, law_id ORDER BY date_in_force DESC NULLS LAST, version_id DESC) AS r FROM selected)
 WHERE r = 1 AND date_in_force IS NOT NULL AND NOT is_current""")
def version_notes(spark, d):
    return V.version_notes(selected(spark, d))


@add("law_date_map", S.with_(S.ISSUES) + """SELECT question_id, law_id, max(relevant_date) AS relevant_date FROM issues
 WHERE relevant_date IS NOT NULL AND relevant_date <> 'unknown' GROUP BY 1, 2""")
def law_date_map(spark, d):
    return V.law_date_map(S.issues(spark, d))


@add("primary_date", S.with_(S.ISSUES) + f"""SELECT question_id, coalesce(max(CASE WHEN relevant_date <> 'unknown' THEN relevant_date END), '{TODAY}') AS primary_date
 FROM issues GROUP BY 1""")
def primary_date(spark, d):
    return V.primary_date(S.issues(spark, d), TODAY)


STATE = "CASE state WHEN 'F' THEN 'deprecated' WHEN 'O' THEN 'actual' ELSE 'amended' END"


@add("law_status", S.with_(S.LAWS, S.VERSIONS) + f"""SELECT l.law_id, CASE WHEN l.law_id % 50 = 0 THEN 'manual' WHEN {STATE} = 'deprecated' THEN 'repealed'
 WHEN {STATE} = 'actual' THEN 'in_force' ELSE 'unknown' END AS status FROM laws l LEFT JOIN (SELECT * FROM versions WHERE is_current) v USING (law_id)""")
def law_status(spark, d):
    state = F.when(F.col("state") == "F", "deprecated").when(F.col("state") == "O", "actual").otherwise("amended")
    laws = S.laws(spark, d).withColumn("status_override", F.when(F.col("law_id") % 50 == 0, "manual"))
    return V.law_status(laws, S.versions(spark, d).withColumn("state", state)).select("law_id", "status")


@add("unimported_versions", S.with_(S.VERSIONS) + """SELECT law_id, ver_id, CAST(date_in_force AS VARCHAR) AS date_in_force FROM known k
 WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.law_id = k.law_id AND v.ver_id = k.ver_id)""")
def unimported_versions(spark, d):
    return V.unimported_versions(S.known(spark, d), S.versions(spark, d)).select("law_id", "ver_id", text_day("date_in_force").alias("date_in_force"))


@add("unimported_counts", S.with_(S.LAWS, S.VERSIONS) + """SELECT l.law_id, CAST(count(k.ver_id) AS BIGINT) AS unimported_count FROM laws l
 LEFT JOIN (SELECT * FROM known WHERE ver_id % 3 = 0) k ON k.law_id = l.law_id GROUP BY 1""")
def unimported_counts(spark, d):
    return V.unimported_counts(S.laws(spark, d), S.known(spark, d), S.versions(spark, d))


@add("imported_flags", S.with_(S.VERSIONS) + "SELECT law_id, ver_id, ver_id % 3 <> 0 AS is_imported FROM known")
def imported_flags(spark, d):
    return V.flag_known(S.known(spark, d), S.versions(spark, d)).select("law_id", "ver_id", "is_imported")


@add("newer_versions", S.with_(S.LAWS, S.VERSIONS) + """, newer AS (SELECT k.law_id, k.ver_id, k.date_in_force FROM known k
 JOIN (SELECT law_id, max(date_in_force) AS m FROM versions GROUP BY 1) x ON x.law_id = k.law_id AND k.date_in_force > x.m
 WHERE k.ver_id NOT IN (SELECT ver_id FROM versions) AND k.law_id IN (SELECT law_id FROM laws))
 SELECT law_id, ver_id, CAST(date_in_force AS VARCHAR) AS date_in_force, date_in_force = max(date_in_force) OVER (PARTITION BY law_id) AS is_latest,
 t.n - count(*) OVER (PARTITION BY law_id) AS version_number_offset,
 t.n - count(*) OVER (PARTITION BY law_id) + row_number() OVER (PARTITION BY law_id ORDER BY date_in_force, ver_id) AS version_number
 FROM newer JOIN (SELECT law_id, count(*) AS n FROM known GROUP BY 1) t USING (law_id)""")
def newer_versions(spark, d):
    return V.newer_versions(S.known(spark, d), S.versions(spark, d), S.laws(spark, d)).withColumn("date_in_force", text_day("date_in_force"))


@add("reconcile_current", S.with_(S.VERSIONS) + """SELECT v.version_id, CAST(coalesce(v.date_in_force, k.date_in_force) AS VARCHAR) AS date_in_force,
 coalesce(k.is_current, false) AS is_current FROM versions v JOIN known k ON k.law_id = v.law_id AND k.ver_id = v.ver_id""")
def reconcile_current(spark, d):
    v = S.versions(spark, d).withColumn("is_current", F.lit(False))
    return V.reconcile_current(v, S.known(spark, d)).select("version_id", text_day("date_in_force").alias("date_in_force"), "is_current")


HAS = "versions_c AS (SELECT *, version_id IN (SELECT l_orderkey FROM lineitem) AND version_id % 5 <> 0 AS has_content FROM versions)"


def _with_content(spark, d):
    ids = S.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("version_id")).distinct().withColumn("_h", F.lit(True))
    v = S.versions(spark, d).join(ids, "version_id", "left")
    return v.withColumn("has_content", F.coalesce("_h", F.lit(False)) & (F.col("version_id") % 5 != 0)).drop("_h")


@add("mark_current", S.with_(S.VERSIONS) + """SELECT version_id, row_number() OVER (PARTITION BY law_id ORDER BY date_in_force DESC NULLS LAST, version_id DESC) = 1 AS is_current FROM versions""")
def mark_current(spark, d):
    return V.mark_current(S.versions(spark, d)).select("version_id", "is_current")


@add("mark_current_content", S.with_(S.VERSIONS, HAS) + """SELECT version_id, row_number() OVER (PARTITION BY law_id ORDER BY has_content DESC,
 date_in_force DESC NULLS LAST, version_id DESC) = 1 AS is_current FROM versions_c""")
def mark_current_content(spark, d):
    return V.mark_current(_with_content(spark, d), with_content=True).select("version_id", "is_current")


@add("mark_current_dated", S.with_(S.VERSIONS) + """SELECT version_id, date_in_force IS NOT NULL AND row_number() OVER (PARTITION BY law_id ORDER BY date_in_force DESC NULLS LAST,
 version_id DESC) = 1 AS is_current FROM versions""")
def mark_current_dated(spark, d):
    return V.mark_current(S.versions(spark, d), only_dated=True).select("version_id", "is_current")


PREV = """prev AS (SELECT v.version_id, v.law_id, (SELECT arg_max(p.version_id, (p.date_in_force, p.version_id)) FROM versions p
 WHERE p.law_id = v.law_id AND p.date_in_force < v.date_in_force) AS prev_version_id FROM versions v)"""


@add("predecessors", S.with_(S.VERSIONS, PREV) + "SELECT version_id, coalesce(prev_version_id, -1) AS prev_version_id FROM prev")
def predecessors(spark, d):
    return V.with_predecessor(S.versions(spark, d)).select("version_id", F.coalesce("prev_version_id", F.lit(-1)).alias("prev_version_id"))


@add("diff_summary", S.with_(S.VERSIONS, S.ARTICLES, PREV) + """, pairs AS (SELECT * FROM prev WHERE prev_version_id IS NOT NULL),
 last AS (SELECT version_id, article_number, arg_max(trim(full_text), (order_index, article_id)) AS t FROM articles GROUP BY 1, 2),
 c AS (SELECT p.version_id, l.article_number, l.t FROM pairs p JOIN last l ON l.version_id = p.version_id),
 o AS (SELECT p.version_id, l.article_number, l.t FROM pairs p JOIN last l ON l.version_id = p.prev_version_id),
 j AS (SELECT coalesce(c.version_id, o.version_id) AS version_id, c.t AS n, o.t AS o FROM c FULL JOIN o ON c.version_id = o.version_id AND c.article_number = o.article_number)
 SELECT p.version_id, p.prev_version_id, CAST(count(*) FILTER (n IS NOT NULL AND o IS NOT NULL AND n <> o) AS BIGINT) AS modified,
 CAST(count(*) FILTER (n IS NOT NULL AND o IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (n IS NULL AND o IS NOT NULL) AS BIGINT) AS removed
 FROM pairs p LEFT JOIN j ON j.version_id = p.version_id GROUP BY 1, 2""")
def diff_summary(spark, d):
    return V.diff_summary(S.versions(spark, d), S.articles(spark, d))


# a freshly read history: every known version with its date in two spellings, some broken, some new
HISTORY = """history AS (SELECT o_custkey AS law_id, o_orderkey AS pos, o_orderkey AS ver_id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y')
 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'n/a' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS date FROM orders WHERE o_custkey % 4 <> 0)"""
OLD_KNOWN = """oldknown AS (SELECT law_id, ver_id, CASE WHEN ver_id % 7 = 0 THEN DATE '1900-01-01' ELSE date_in_force END AS date_in_force, is_current FROM known WHERE ver_id % 5 <> 0)"""


def history(spark, d):
    o = S.load(spark, d, "orders").where("o_custkey % 4 <> 0")
    k = F.col("o_orderkey")
    date = F.when(k % 4 == 2, "n/a").when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    return o.select(F.col("o_custkey").alias("law_id"), k.alias("pos"), k.alias("ver_id"), date.alias("date"))


def old_known(spark, d):
    k = S.known(spark, d).where("ver_id % 5 <> 0")
    return k.withColumn("date_in_force", F.when(F.col("ver_id") % 7 == 0, D.sentinel()).otherwise(F.col("date_in_force")))


MERGED = """read AS (SELECT law_id, ver_id, CASE WHEN date = 'n/a' THEN DATE '1900-01-01' WHEN date LIKE '%.%' THEN CAST(strptime(date, '%d.%m.%Y') AS DATE) ELSE CAST(date AS DATE) END AS day FROM history),
 folded AS (SELECT coalesce(k.law_id, r.law_id) AS law_id, coalesce(k.ver_id, r.ver_id) AS ver_id,
  CASE WHEN k.ver_id IS NULL THEN r.day WHEN k.date_in_force = DATE '1900-01-01' AND r.day IS NOT NULL THEN r.day ELSE k.date_in_force END AS date_in_force, k.is_current AS was
  FROM oldknown k FULL JOIN read r ON r.law_id = k.law_id AND r.ver_id = k.ver_id)"""


@add("merge_history", S.with_(S.KNOWN, HISTORY, OLD_KNOWN, MERGED) + """SELECT law_id, ver_id, CAST(date_in_force AS VARCHAR) AS date_in_force,
 CASE WHEN law_id IN (SELECT law_id FROM history) THEN row_number() OVER (PARTITION BY law_id ORDER BY date_in_force DESC, ver_id DESC) = 1 ELSE coalesce(was, false) END AS is_current FROM folded""")
def merge_history(spark, d):
    out, _ = V.merge_history(old_known(spark, d), S.versions(spark, d), history(spark, d))
    return out.withColumn("date_in_force", text_day("date_in_force"))


NEW_COUNTS = """newcounts AS (SELECT law_id, CAST(count(*) FILTER (ver_id % 5 = 0 AND ver_id % 3 = 0) AS BIGINT) AS new_count FROM history GROUP BY 1)"""


@add("history_new_counts", S.with_(S.KNOWN, HISTORY, NEW_COUNTS) + "SELECT * FROM newcounts")
def history_new_counts(spark, d):
    return V.merge_history(old_known(spark, d), S.versions(spark, d), history(spark, d))[1]


@add("discovery_summary", S.with_(S.KNOWN, HISTORY, NEW_COUNTS) + """SELECT CAST(count(*) AS BIGINT) AS checked, CAST(sum(new_count) AS BIGINT) AS discovered, CAST(0 AS BIGINT) AS errors FROM newcounts""")
def discovery_summary(spark, d):
    return V.discovery_summary(history_new_counts(spark, d))


@add("discovery_notices", S.with_(S.LAWS, S.KNOWN, HISTORY, NEW_COUNTS) + """SELECT law_id, 'New version(s) found: ' || title AS title,
 new_count || ' new version(s) discovered for Legea ' || law_number || '/' || law_year || '.' AS message FROM newcounts JOIN laws USING (law_id) WHERE new_count > 0""")
def discovery_notices(spark, d):
    return V.discovery_notices(history_new_counts(spark, d), S.laws(spark, d))


@add("pick_probe", S.with_(S.LAWS, S.VERSIONS) + """SELECT law_id, coalesce(probe, -1) AS probe_ver_id FROM laws LEFT JOIN (SELECT law_id, arg_max(ver_id, (p, coalesce(dd, DATE '0001-01-01'), ver_id)) AS probe FROM (
 SELECT law_id, ver_id, CASE WHEN is_current THEN 4 WHEN date_in_force IS NOT NULL THEN 3 ELSE 2 END AS p, date_in_force AS dd FROM versions
 UNION ALL SELECT law_id, ver_id, 1, date_in_force FROM known) GROUP BY 1) USING (law_id)""")
def pick_probe(spark, d):
    return V.pick_probe(S.laws(spark, d), S.versions(spark, d), S.known(spark, d)).select("law_id", F.coalesce("probe_ver_id", F.lit(-1)).alias("probe_ver_id"))


@add("seed_known", S.with_(S.VERSIONS) + """SELECT law_id, ver_id, CAST(coalesce(date_in_force, DATE '1900-01-01') AS VARCHAR) AS date_in_force, is_current FROM versions WHERE ver_id % 5 = 0""")
def seed_known(spark, d):
    out = V.seed_known(S.versions(spark, d), S.known(spark, d).where("ver_id % 5 <> 0"))
    return out.withColumn("date_in_force", text_day("date_in_force"))


# fetched pages: the page of a version lists its law's known versions newest first
PAGES_H = """cand AS (SELECT l.law_id, v.ver_id FROM laws l LEFT JOIN (SELECT * FROM versions WHERE is_current) v USING (law_id)),
 fetched AS (SELECT ver_id, CASE WHEN ver_id % 4 = 0 THEN ver_id + 1 END AS next_ver FROM versions WHERE is_current AND ver_id % 6 <> 1),
 listed AS (SELECT f.ver_id, k.ver_id AS hist_ver_id, row_number() OVER (PARTITION BY f.ver_id ORDER BY k.date_in_force DESC, k.ver_id DESC) - 1 AS pos,
  CAST(k.date_in_force AS VARCHAR) AS hist_date FROM fetched f JOIN known v ON v.ver_id = f.ver_id JOIN known k ON k.law_id = v.law_id)"""


@add("currency_status", S.with_(S.LAWS, S.VERSIONS, PAGES_H) + """SELECT c.law_id, CASE WHEN c.ver_id IS NULL THEN 'no_current_version' WHEN f.ver_id IS NULL THEN 'source_unavailable'
 WHEN n.next_ver IS NOT NULL OR h.hist_ver_id IS NOT NULL THEN 'stale' ELSE 'current' END AS currency_status,
 CAST(coalesce(n.next_ver, h.hist_ver_id) AS VARCHAR) AS official_latest_ver_id, CASE WHEN n.next_ver IS NULL THEN h.hist_date END AS official_latest_date
 FROM cand c LEFT JOIN fetched f ON f.ver_id = c.ver_id
 LEFT JOIN (SELECT c.law_id, f.next_ver FROM cand c JOIN fetched f USING (ver_id) WHERE f.next_ver IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM versions v WHERE v.law_id = c.law_id AND v.ver_id = f.next_ver)) n ON n.law_id = c.law_id
 LEFT JOIN (SELECT c.law_id, arg_min(hist_ver_id, pos) AS hist_ver_id, arg_min(hist_date, pos) AS hist_date FROM cand c JOIN listed l USING (ver_id)
  WHERE l.hist_ver_id <> c.ver_id AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.law_id = c.law_id AND v.ver_id = l.hist_ver_id) GROUP BY 1) h ON h.law_id = c.law_id""")
def currency_status(spark, d):
    v, k = S.versions(spark, d), S.known(spark, d)
    cur = v.where("is_current")
    cand = S.laws(spark, d).select("law_id").join(cur.select("law_id", "ver_id"), "law_id", "left")
    pages = cur.where("ver_id % 6 <> 1").select("ver_id", F.when(F.col("ver_id") % 4 == 0, F.col("ver_id") + 1).alias("next_ver"), "law_id")
    listed = pages.select("ver_id", "law_id").join(k.select("law_id", F.col("ver_id").alias("hist_ver_id"), "date_in_force"), "law_id")
    newest_first = [F.desc("date_in_force"), F.desc("hist_ver_id")]
    placed = number_rows(listed, ["ver_id"], newest_first, -F.unix_date("date_in_force"))
    hist = placed.select("ver_id", (F.col("rn") - 1).alias("pos"), "hist_ver_id", text_day("date_in_force").alias("hist_date"))
    out = V.currency_status(cand, pages.drop("law_id"), hist, v)
    return out.select("law_id", "currency_status", F.col("official_latest_ver_id").cast("string").alias("official_latest_ver_id"), "official_latest_date")


@add("currency_precheck", S.with_(S.LAWS, S.VERSIONS) + f"""SELECT l.law_id, CASE WHEN l.law_id % 3 = 0 AND CAST(DATE '1999-06-01' + CAST(l.law_id % 400 AS INTEGER) AS DATE) < DATE '{TODAY}' THEN 'not_checked'
 WHEN l.law_id % 7 = 0 THEN 'not_checked' WHEN v.ver_id IS NULL THEN 'no_current_version' WHEN l.law_id % 4 = 0 THEN 'current' ELSE 'to_check' END AS currency_status
 FROM laws l LEFT JOIN (SELECT * FROM versions WHERE is_current) v USING (law_id)""")
def currency_precheck(spark, d):
    k = F.col("law_id")
    cur = S.versions(spark, d).where("is_current").select("law_id", F.col("ver_id").alias("current_ver_id"))
    cand = S.laws(spark, d).select(
        "law_id",
        F.when(k % 3 == 0, "explicit").otherwise("relative").alias("date_type"),
        F.date_add(F.lit("1999-06-01").cast("date"), (k % 400).cast("int")).cast("string").alias("primary_date"),
        F.when(k % 7 == 0, "missing").otherwise("available").alias("availability"),
        F.when(k % 4 == 0, F.lit("2000-01-01 06:00:00")).otherwise("1999-12-01 00:00:00").cast("timestamp").alias("date_imported"),
    )
    out = V.currency_precheck(cand.join(cur, "law_id", "left"), TODAY, F.lit("2000-01-01 12:00:00").cast("timestamp"))
    return out.select("law_id", "currency_status")


REQUESTS = """hist AS (SELECT o_custkey AS law_id, o_orderkey AS ver_id, o_orderkey AS pos, CASE WHEN o_orderkey % 9 <> 0 AND o_custkey % 25 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders),
 req AS (SELECT c_custkey AS law_id, -c_custkey AS base_ver_id, CASE WHEN c_custkey % 3 <> 0 THEN CAST(DATE '1995-06-01' + CAST(c_custkey % 2200 AS INTEGER) AS DATE) END AS primary_date FROM customer WHERE c_custkey > 0)"""


def _hist(spark, d):
    o = S.load(spark, d, "orders")
    return o.select(
        F.col("o_custkey").alias("law_id"), F.col("o_orderkey").alias("ver_id"), F.col("o_orderkey").alias("pos"),
        F.when((F.col("o_orderkey") % 9 != 0) & (F.col("o_custkey") % 25 != 0), F.to_date("o_orderdate")).alias("day"),
    )


@add("versions_to_import", S.with_(REQUESTS) + """, j AS (SELECT r.law_id, r.base_ver_id, r.primary_date,
 (SELECT arg_max(ver_id, (day, ver_id)) FROM hist h WHERE h.law_id = r.law_id AND day IS NOT NULL) AS newest,
 (SELECT arg_min(ver_id, (day, ver_id)) FROM hist h WHERE h.law_id = r.law_id AND day IS NOT NULL) AS oldest,
 (SELECT arg_max(ver_id, (day, ver_id)) FROM hist h WHERE h.law_id = r.law_id AND day <= r.primary_date) AS fits FROM req r),
 p AS (SELECT law_id, coalesce(newest, base_ver_id) AS ver_id FROM j UNION SELECT law_id, coalesce(fits, oldest) FROM j WHERE primary_date IS NOT NULL AND oldest IS NOT NULL),
 allv AS (SELECT h.law_id, h.ver_id FROM hist h JOIN req USING (law_id) UNION SELECT law_id, base_ver_id FROM req)
 SELECT a.law_id, a.ver_id, p.ver_id IS NOT NULL AS picked FROM allv a LEFT JOIN p ON p.law_id = a.law_id AND p.ver_id = a.ver_id""")
def versions_to_import(spark, d):
    k = F.col("c_custkey")
    req = S.load(spark, d, "customer").where("c_custkey > 0").select(
        k.alias("law_id"), (-k).alias("base_ver_id"),
        F.when(k % 3 != 0, F.date_add(F.lit("1995-06-01").cast("date"), (k % 2200).cast("int"))).alias("primary_date"),
    )
    return V.versions_to_import(req, _hist(spark, d))


@add("current_to_import", S.with_(REQUESTS) + """SELECT law_id, ver_id FROM (SELECT *, row_number() OVER (PARTITION BY law_id ORDER BY day IS NOT NULL DESC, day DESC, pos) AS r FROM hist) WHERE r = 1""")
def current_to_import(spark, d):
    return V.current_to_import(_hist(spark, d))


@add("import_worklist", S.with_(S.VERSIONS) + """SELECT law_id, ver_id, CAST(date_in_force AS VARCHAR) AS date_in_force,
 row_number() OVER (PARTITION BY law_id ORDER BY date_in_force, ver_id) AS import_order FROM known WHERE ver_id % 3 = 0""")
def import_worklist(spark, d):
    return V.import_worklist(S.known(spark, d), S.versions(spark, d)).withColumn("date_in_force", text_day("date_in_force"))


@add("import_requested", """SELECT o_custkey + o_orderkey % 2 AS law_id, o_orderkey AS ver_id,
 CASE WHEN o_orderkey % 2 = 1 THEN 'rejected' WHEN o_orderkey % 3 <> 0 THEN 'done' ELSE 'to_import' END AS outcome FROM orders""")
def import_requested(spark, d):
    asked = S.load(spark, d, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 2).alias("law_id"), F.col("o_orderkey").alias("ver_id"))
    return V.import_worklist(S.known(spark, d), S.versions(spark, d), asked)


@add("cross_history", S.with_(REQUESTS) + """SELECT law_id, ver_id, pos FROM hist""")
def cross_history(spark, d):
    h = _hist(spark, d)
    return V.cross_history(h.where("ver_id % 2 = 0"), h).select("law_id", "ver_id", "pos")


@add("known_union", S.with_(S.VERSIONS) + """SELECT k.law_id, CAST(count(*) AS BIGINT) AS pre_known FROM (SELECT law_id, ver_id FROM known WHERE ver_id % 5 <> 0 UNION SELECT law_id, ver_id FROM versions) k GROUP BY 1""")
def known_union(spark, d):
    """Ids known before a discovery run, stored or imported."""
    pre = S.known(spark, d).where("ver_id % 5 <> 0").select("law_id", "ver_id").union(S.versions(spark, d).select("law_id", "ver_id")).distinct()
    return pre.groupBy("law_id").agg(F.count(F.lit(1)).alias("pre_known"))


@add("law_order", S.with_(S.LAWS) + """SELECT law_id, law_year FROM laws ORDER BY law_year DESC, law_number LIMIT 50""")
def law_order(spark, d):
    """Newest year first, then number; the first page of it."""
    return S.laws(spark, d).orderBy(F.desc("law_year"), F.asc("law_number")).limit(50).select("law_id", "law_year")
