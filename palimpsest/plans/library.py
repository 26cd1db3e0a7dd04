"""Driver queries of the library, suggestion and search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.terms import forms_of
from palimpsest.operators import library as L
from palimpsest.plans import standins as S
from palimpsest.plans.registry import REGISTRY
from palimpsest.plans.retrieval import _values, sql_fold

add = REGISTRY.add


def categories(spark, d):
    return S.load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("category_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("group_id"))


def groups(spark, d):
    return S.load(spark, d, "region").select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("group_slug"))


CATS = "cats AS (SELECT CAST(n_nationkey AS BIGINT) AS category_id, r_name AS group_slug FROM nation JOIN region ON r_regionkey = n_regionkey)"
OVERVIEW = """overview AS (SELECT l.*, coalesce(c.n, 0) AS version_count, v.version_id AS current_version_id, v.state AS current_state, cats.group_slug AS category_group_slug FROM laws l
 LEFT JOIN (SELECT law_id, CAST(count(*) AS BIGINT) AS n FROM versions GROUP BY 1) c USING (law_id) LEFT JOIN (SELECT * FROM versions WHERE is_current) v USING (law_id) LEFT JOIN cats USING (category_id))"""
BASE = S.with_(S.LAWS, S.VERSIONS, CATS, OVERVIEW)


def overview(spark, d):
    return L.library_overview(S.laws(spark, d), S.versions(spark, d), categories(spark, d), groups(spark, d))


@add("library_overview", BASE + "SELECT law_id, title, version_count, coalesce(current_version_id, -1) AS current_version_id, current_state, category_group_slug FROM overview")
def library_overview(spark, d):
    return overview(spark, d).select("law_id", "title", "version_count", F.coalesce("current_version_id", F.lit(-1)).alias("current_version_id"), "current_state", "category_group_slug")


@add("law_list", BASE + "SELECT law_id, version_count, (SELECT CAST(count(*) AS BIGINT) FROM known k WHERE k.law_id = o.law_id AND k.ver_id % 3 = 0) AS unimported_count FROM overview o")
def law_list(spark, d):
    return L.law_list(S.laws(spark, d), S.versions(spark, d), S.known(spark, d)).select("law_id", "version_count", "unimported_count")


@add("category_counts", BASE + "SELECT c.category_id, c.group_slug, CAST(count(l.law_id) AS BIGINT) AS law_count FROM cats c LEFT JOIN laws l USING (category_id) GROUP BY 1, 2")
def category_counts(spark, d):
    return L.category_counts(S.laws(spark, d), categories(spark, d), groups(spark, d))


@add("library_totals", BASE + "SELECT (SELECT CAST(count(*) AS BIGINT) FROM laws) AS total_laws, CAST(count(*) AS BIGINT) AS total_versions, CAST(max(date_in_force) AS VARCHAR) AS last_imported FROM versions")
def library_totals(spark, d):
    v = S.versions(spark, d).withColumn("date_imported", F.col("date_in_force").cast("timestamp"))
    return L.library_totals(S.laws(spark, d), v).withColumn("last_imported", F.col("last_imported").cast("string"))


@add("library_filter", BASE + """SELECT CAST(count(*) AS BIGINT) AS total_laws, CAST(coalesce(sum(version_count), 0) AS BIGINT) AS total_versions, CAST(count(*) FILTER (category_id IS NULL) AS BIGINT) AS unclassified,
 CAST(count(*) FILTER (category_id IS NOT NULL) AS BIGINT) AS classified FROM overview WHERE current_state = 'O'""")
def library_filter(spark, d):
    return L.filtered_stats(L.library_filter(overview(spark, d), state="O"))


@add("library_filter_group", BASE + "SELECT law_id, title FROM overview WHERE category_group_slug = 'ASIA' AND current_state = 'F'")
def library_filter_group(spark, d):
    return L.library_filter(overview(spark, d), group="ASIA", state="F").select("law_id", "title")


@add("group_laws", BASE + "SELECT law_id, coalesce(category_group_slug, '__unclassified__') AS bucket FROM overview")
def group_laws(spark, d):
    return L.group_laws(overview(spark, d)).select("law_id", "bucket")


@add("group_sizes", BASE + "SELECT coalesce(category_group_slug, '__unclassified__') AS bucket, CAST(count(*) AS BIGINT) AS laws, CAST(sum(version_count) AS BIGINT) AS versions FROM overview GROUP BY 1")
def group_sizes(spark, d):
    return L.group_sizes(overview(spark, d))


def _favs(spark, d):
    return S.load(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id"), (F.col("event_id") % 1500).alias("law_id"))


@add("favorites", BASE + "SELECT law_id, title FROM laws WHERE law_id IN (SELECT event_id % 1500 FROM events WHERE user_id = 7)")
def favorites(spark, d):
    return L.favorites(S.laws(spark, d), _favs(spark, d), 7).select("law_id", "title")


@add("favorite_counts", BASE + "SELECT category_group_slug, CAST(count(*) AS BIGINT) AS n FROM overview WHERE law_id IN (SELECT event_id % 1500 FROM events WHERE user_id = 7) AND category_group_slug IS NOT NULL GROUP BY 1")
def favorite_counts(spark, d):
    return L.favorite_counts(overview(spark, d), _favs(spark, d), 7)


# --- suggestions: parts ----------------------------------------------------------------------

MAPPINGS = """mappings AS (SELECT p_partkey AS mapping_id, p_name AS title, CASE WHEN p_size % 10 <> 0 THEN CAST(p_partkey * 7 % 1800 AS VARCHAR) END AS law_number,
 CASE WHEN p_size % 4 <> 0 THEN CAST(1990 + (p_partkey * 7 % 1800) % 30 AS INTEGER) END AS law_year, CASE WHEN p_size % 3 <> 0 THEN (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[1 + p_partkey % 5] END AS document_type,
 CASE WHEN p_size % 6 = 0 THEN 'CX' || p_size END AS celex_number, CASE WHEN p_size % 5 = 0 THEN p_partkey * 3 END AS source_ver_id, CAST(p_partkey % 25 AS BIGINT) AS category_id,
 CASE WHEN p_size % 2 = 0 THEN 'system' ELSE 'user' END AS source, CASE WHEN p_brand = 'Brand#3' THEN 'gone' END AS deleted_at FROM part)"""


def mappings(spark, d):
    p = S.load(spark, d, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    n = (k * 7) % 1800
    kinds = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return p.select(
        k.alias("mapping_id"), F.col("p_name").alias("title"), F.when(z % 10 != 0, n.cast("string")).alias("law_number"),
        F.when(z % 4 != 0, (1990 + n % 30).cast("int")).alias("law_year"), F.when(z % 3 != 0, F.element_at(kinds, (k % 5 + 1).cast("int"))).alias("document_type"),
        F.when(z % 6 == 0, F.concat(F.lit("CX"), z.cast("string"))).alias("celex_number"), F.when(z % 5 == 0, k * 3).alias("source_ver_id"), (k % 25).alias("category_id"),
        F.when(z % 2 == 0, "system").otherwise("user").alias("source"), F.when(F.col("p_brand") == "Brand#3", "gone").alias("deleted_at"),
    )


@add("list_suggestions", S.with_(MAPPINGS, CATS) + "SELECT mapping_id, group_slug FROM mappings LEFT JOIN cats USING (category_id) WHERE deleted_at IS NULL AND source = 'user' AND (source_ver_id IS NOT NULL OR celex_number IS NOT NULL) AND title ILIKE '%RING%' AND group_slug = 'EUROPE'")
def list_suggestions(spark, d):
    out = L.list_suggestions(mappings(spark, d), categories(spark, d), groups(spark, d), source="user", pinned=True, title="RING", group="EUROPE")
    return out.select("mapping_id", "group_slug")


@add("list_suggestions_open", S.with_(MAPPINGS, CATS) + "SELECT mapping_id, group_slug FROM mappings LEFT JOIN cats USING (category_id) WHERE deleted_at IS NULL AND source_ver_id IS NULL AND celex_number IS NULL")
def list_suggestions_open(spark, d):
    return L.list_suggestions(mappings(spark, d), categories(spark, d), groups(spark, d), pinned=False).select("mapping_id", "group_slug")


URL = "https://example.org/doc/"


@add("flag_imported", BASE + f"""SELECT r.ver_id, v.law_id IS NOT NULL OR u.law_id IS NOT NULL AS already_imported, coalesce(v.law_id, u.law_id, -1) AS local_law_id FROM (SELECT o_orderkey AS ver_id FROM orders) r
 LEFT JOIN versions v ON v.ver_id = r.ver_id LEFT JOIN (SELECT law_id, law_id * 6 AS vid FROM laws) u ON u.vid = r.ver_id""")
def flag_imported(spark, d):
    laws = S.laws(spark, d).withColumn("source_url", F.concat(F.lit(URL), (F.col("law_id") * 6).cast("string")))
    results = S.load(spark, d, "orders").select(F.col("o_orderkey").alias("ver_id"))
    return L.flag_imported(results, S.versions(spark, d), laws, URL).withColumn("local_law_id", F.coalesce("local_law_id", F.lit(-1)))


@add("flag_imported_eu", "SELECT p_partkey AS result_id, p_size % 6 = 0 AND p_size <= 30 AS already_imported FROM part")
def flag_imported_eu(spark, d):
    laws = S.laws(spark, d).withColumn("celex_number", F.when(F.col("law_id") <= 30, F.concat(F.lit("CX"), F.col("law_id").cast("string"))))
    results = mappings(spark, d).select(F.col("mapping_id").alias("result_id"), "celex_number")
    return L.flag_imported_eu(results, laws).select("result_id", "already_imported")


@add("flag_suggestions", S.with_(S.LAWS, MAPPINGS) + "SELECT mapping_id, coalesce(celex_number IN ('CX6', 'CX12'), false) OR EXISTS (SELECT 1 FROM laws l WHERE l.law_number = m.law_number AND l.law_year IS NOT DISTINCT FROM m.law_year AND l.document_type IS NOT DISTINCT FROM m.document_type) AS is_imported FROM mappings m")
def flag_suggestions(spark, d):
    laws = S.laws(spark, d).withColumn("celex_number", F.when(F.col("law_id") <= 12, F.concat(F.lit("CX"), F.col("law_id").cast("string"))))
    return L.flag_suggestions(mappings(spark, d), laws).select("mapping_id", "is_imported")


@add("pending_suggestions", S.with_(S.LAWS, MAPPINGS) + """SELECT mapping_id FROM (SELECT *, row_number() OVER (PARTITION BY law_number, law_year ORDER BY mapping_id) AS r FROM mappings m WHERE deleted_at IS NULL) m
 WHERE law_number IS NULL OR (r = 1 AND NOT EXISTS (SELECT 1 FROM laws l WHERE l.law_number = m.law_number AND l.law_year IS NOT DISTINCT FROM m.law_year))""")
def pending_suggestions(spark, d):
    return L.pending_suggestions(mappings(spark, d), S.laws(spark, d)).select("mapping_id")


@add("resolve_category", S.with_(S.LAWS, MAPPINGS) + """SELECT law_id, coalesce(CASE WHEN n = 0 THEN NULL WHEN n = 1 THEN any1 WHEN exact_ IS NOT NULL THEN exact_ WHEN year_ IS NOT NULL THEN year_ WHEN nt = 1 THEN type_ END, -1) AS resolved_category_id FROM (SELECT l.law_id,
 (SELECT count(*) FROM mappings m WHERE m.law_number = l.law_number) AS n, (SELECT arg_min(category_id, mapping_id) FROM mappings m WHERE m.law_number = l.law_number) AS any1,
 (SELECT arg_min(category_id, mapping_id) FROM mappings m WHERE m.law_number = l.law_number AND m.law_year = l.law_year AND m.document_type = l.document_type) AS exact_,
 (SELECT arg_min(category_id, mapping_id) FROM mappings m WHERE m.law_number = l.law_number AND m.law_year = l.law_year) AS year_,
 (SELECT count(*) FROM mappings m WHERE m.law_number = l.law_number AND m.document_type = l.document_type) AS nt,
 (SELECT arg_min(category_id, mapping_id) FROM mappings m WHERE m.law_number = l.law_number AND m.document_type = l.document_type) AS type_ FROM laws l)""")
def resolve_category(spark, d):
    return L.resolve_category(S.laws(spark, d), mappings(spark, d)).withColumn("resolved_category_id", F.coalesce("resolved_category_id", F.lit(-1)))


@add("auto_category", S.with_(S.LAWS, MAPPINGS) + "SELECT l.law_id, coalesce((SELECT arg_min(category_id, mapping_id) FROM mappings m WHERE m.law_number = l.law_number AND m.law_year = l.law_year), -1) AS resolved_category_id FROM laws l")
def auto_category(spark, d):
    return L.auto_category(S.laws(spark, d), mappings(spark, d)).withColumn("resolved_category_id", F.coalesce("resolved_category_id", F.lit(-1)))


TRIAGE = """catalog AS (SELECT o_orderkey AS ver_id, CAST(o_custkey AS VARCHAR) AS law_number, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[1 + o_orderkey % 5] AS document_type, CAST(1990 + o_custkey % 30 AS INTEGER) AS law_year FROM orders),
 held AS (SELECT * FROM laws WHERE source = 'eu'),
 t AS (SELECT m.*, EXISTS (SELECT 1 FROM held l WHERE l.law_number = m.law_number AND (m.document_type IS NULL OR l.document_type = m.document_type) AND (m.law_year IS NULL OR l.law_year = m.law_year)) AS there,
  coalesce(source_ver_id, (SELECT min(c.ver_id) FROM catalog c WHERE c.law_number = m.law_number AND (m.document_type IS NULL OR c.document_type = m.document_type) AND (m.law_year IS NULL OR c.law_year = m.law_year))) AS v FROM mappings m),
 o AS (SELECT mapping_id, v, CASE WHEN law_number IS NULL THEN 'error: no law number' WHEN there THEN 'skipped: already imported' WHEN v IS NULL THEN 'error: not found'
  WHEN v IN (SELECT ver_id FROM versions) THEN 'skipped: version already imported' ELSE 'import' END AS outcome FROM t)"""


def _triage(spark, d):
    o = S.load(spark, d, "orders")
    kinds = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    catalog = o.select(
        F.col("o_orderkey").alias("ver_id"), F.col("o_custkey").cast("string").alias("number"), F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("document_type"),
        (1990 + F.col("o_custkey") % 30).cast("int").alias("year"), F.col("o_orderkey").alias("place"),
    )
    return L.import_triage(mappings(spark, d), S.laws(spark, d).where("source = 'eu'"), S.versions(spark, d), catalog)


@add("import_triage", S.with_(S.LAWS, S.VERSIONS, MAPPINGS, TRIAGE) + "SELECT mapping_id, outcome, CASE WHEN outcome = 'import' THEN CAST(v AS VARCHAR) END AS ver_id FROM o")
def import_triage(spark, d):
    return _triage(spark, d)[0].withColumn("ver_id", F.col("ver_id").cast("string"))


@add("import_triage_counts", S.with_(S.LAWS, S.VERSIONS, MAPPINGS, TRIAGE) + "SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY 1")
def import_triage_counts(spark, d):
    return _triage(spark, d)[1]


# --- searches --------------------------------------------------------------------------------

# queries: the ends of part names and of customer names, whole and short
ACQ = "q AS (SELECT p_partkey AS query_id, CASE WHEN p_size % 9 = 0 THEN 'r' ELSE upper(substr(p_name, 1 + p_size % 4, 5)) END AS text FROM part), vals AS (SELECT c_name || ' ' || c_mktsegment || ' ' || c_custkey % 89 AS value, c_custkey AS place FROM customer UNION ALL SELECT p_name || p_partkey, 100000 + p_partkey FROM part)"


@add("autocomplete", S.with_(ACQ) + "SELECT query_id, value, rank FROM (SELECT query_id, value, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM q JOIN vals ON length(text) < 2 OR contains(lower(value), lower(text))) WHERE rank <= 30")
def autocomplete(spark, d):
    p = S.load(spark, d, "part")
    q = p.select(F.col("p_partkey").alias("query_id"), F.when(F.col("p_size") % 9 == 0, "r").otherwise(F.upper(F.substring("p_name", F.col("p_size") % 4 + 1, F.lit(5)))).alias("text"))
    c = S.load(spark, d, "customer").select(F.concat_ws(" ", "c_name", "c_mktsegment", (F.col("c_custkey") % 89).cast("string")).alias("value"), F.col("c_custkey").alias("place"))
    v = c.unionByName(p.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("value"), (F.col("p_partkey") + 100000).alias("place")))
    return L.autocomplete(v, q).select("query_id", "value", "rank")


FORM_VALUES = _values((k, f) for k, fs in forms_of().items() for f in fs)
# catalogue entries: titles built from the nation and part words and some word forms
WORDS = "['legea', 'codul', 'societăților', 'contractele', 'muncii', 'protecția', 'fiscală']"
CATALOG = f"""entries AS (SELECT c_custkey AS ver_id, c_custkey AS place, 'LEGE nr. ' || c_custkey AS title, 'privind ' || ({WORDS})[1 + c_custkey % 7] || ' ' || ({WORDS})[1 + c_custkey // 7 % 7] || ' ' || c_mktsegment AS description, 'Parlamentul' AS issuer,
 (['LEGE', 'OUG', 'HG', 'ORDIN'])[1 + c_custkey % 4] AS doc_type, (['1', '18', '2', '5'])[1 + c_custkey % 4] AS doc_code, CAST(c_custkey % 400 AS VARCHAR) AS number, 1990 + c_custkey % 30 AS year, '16/11/' || (1990 + c_custkey % 30) AS date FROM customer)"""
FORMQ = "(['lege', 'cod', 'societate', 'contract', 'munca', 'protectie', 'fiscal', 'de urgenta', 'hotarare'])"
CQ = f"""cq AS (SELECT p_partkey AS query_id, CASE p_partkey % 6 WHEN 0 THEN 'legea ' || p_partkey % 400 || '/' || (1990 + p_partkey % 30) WHEN 1 THEN {FORMQ}[1 + p_partkey % 9] || ' ' || {FORMQ}[1 + p_partkey // 9 % 7]
 WHEN 2 THEN 'privind ' || {FORMQ}[1 + p_partkey // 6 % 7] || ' building' WHEN 3 THEN CAST(p_partkey % 400 AS VARCHAR) || '/' || (1990 + p_partkey % 400 % 30) WHEN 4 THEN 'Codul muncii' ELSE 'oug ' || {FORMQ}[1 + p_partkey // 6 % 7] END AS text FROM part)"""


def catalog(spark, d):
    c = S.load(spark, d, "customer")
    k = F.col("c_custkey")
    words = F.array(*[F.lit(w) for w in ("legea", "codul", "societăților", "contractele", "muncii", "protecția", "fiscală")])
    pick = lambda xs, i: F.element_at(xs, (i + 1).cast("int"))
    kinds, codes = (F.array(*[F.lit(w) for w in ws]) for ws in (("LEGE", "OUG", "HG", "ORDIN"), ("1", "18", "2", "5")))
    year = 1990 + k % 30
    return c.select(
        k.alias("ver_id"), k.alias("place"), F.concat(F.lit("LEGE nr. "), k.cast("string")).alias("title"),
        F.concat_ws(" ", F.lit("privind"), pick(words, k % 7), pick(words, F.floor(k / 7) % 7), "c_mktsegment").alias("description"), F.lit("Parlamentul").alias("issuer"),
        pick(kinds, k % 4).alias("doc_type"), pick(codes, k % 4).alias("doc_code"), (k % 400).cast("string").alias("number"), year.alias("year"), F.concat(F.lit("16/11/"), year.cast("string")).alias("date"),
    )


def catalog_queries(spark, d):
    k = F.col("p_partkey")
    forms = F.array(*[F.lit(w) for w in ("lege", "cod", "societate", "contract", "munca", "protectie", "fiscal", "de urgenta", "hotarare")])
    pick = lambda i: F.element_at(forms, (i + 1).cast("int"))
    s = lambda c: c.cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("legea "), s(k % 400), F.lit("/"), s(1990 + k % 30)))
        .when(k % 6 == 1, F.concat_ws(" ", pick(k % 9), pick(F.floor(k / 9) % 7)))
        .when(k % 6 == 2, F.concat_ws(" ", F.lit("privind"), pick(F.floor(k / 6) % 7), F.lit("building")))
        .when(k % 6 == 3, F.concat(s(k % 400), F.lit("/"), s(1990 + k % 400 % 30)))
        .when(k % 6 == 4, "Codul muncii")
        .otherwise(F.concat_ws(" ", F.lit("oug"), pick(F.floor(k / 6) % 7)))
    )
    return S.load(spark, d, "part").select(k.alias("query_id"), text.alias("text"))


STOPS = _values((w,) for w in X.STOP_WORDS)
KEYWORDS = f"""kw AS (SELECT DISTINCT query_id, {sql_fold("w")} AS w FROM (SELECT query_id, unnest(CASE WHEN regexp_full_match(w, '\\d+/\\d{{4}}') THEN string_split(w, '/') ELSE [w] END) AS w FROM
  (SELECT query_id, unnest(string_split_regex(text, '\\s+')) AS w FROM cq)) WHERE lower(w) NOT IN (SELECT s FROM (VALUES {STOPS}) x(s)) AND length(w) >= 2),
 kwf AS (SELECT query_id, w, w AS v FROM kw UNION SELECT query_id, w, {sql_fold("f")} FROM kw JOIN (VALUES {FORM_VALUES}) x(k, f) ON k = w),
 hay AS (SELECT ver_id, {sql_fold("concat_ws(' ', title, description, issuer, doc_type, number, date)")} AS hay FROM entries)"""


@add("keyword_filter", S.with_(CATALOG, CQ, KEYWORDS) + """SELECT query_id, ver_id FROM (SELECT p_partkey AS query_id, e.ver_id FROM part JOIN entries e ON e.ver_id = p_partkey % 1500) m
 WHERE NOT EXISTS (SELECT 1 FROM kw WHERE kw.query_id = m.query_id AND NOT EXISTS (SELECT 1 FROM kwf JOIN hay ON hay.ver_id = m.ver_id WHERE kwf.query_id = kw.query_id AND kwf.w = kw.w AND contains(hay, kwf.v)))""")
def keyword_filter(spark, d):
    rows = catalog_queries(spark, d).withColumn("ver_id", F.col("query_id") % 1500).join(catalog(spark, d), "ver_id")
    return L.keyword_filter(rows, "text", ["title", "description", "issuer", "doc_type", "number", "date"]).select("query_id", "ver_id")


@add("word_variants", S.with_(CQ) + f"""SELECT query_id, variant, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i, f) AS rank FROM (SELECT query_id, variant, min(i) AS i, arg_min(f, (i, f)) AS f FROM (
 SELECT query_id, i, f, array_to_string(list_transform(ws, lambda x, j: CASE WHEN j = i THEN f ELSE x END), ' ') AS variant, lower(text) AS q FROM (SELECT query_id, text, string_split_regex(lower(text), '\\s+') AS ws FROM cq) a,
 unnest(range(1, len(ws) + 1)) r(i) JOIN (VALUES {FORM_VALUES}) x(k, f) ON k = ws[i] AND f <> k) WHERE variant <> q GROUP BY 1, 2)) WHERE rank <= 3""")
def word_variants(spark, d):
    return L.word_variants(catalog_queries(spark, d))


# aliases: each nation's first act, some known names
ALIASES = """aliases AS (SELECT CAST(n_nationkey AS INTEGER) AS place, CASE n_nationkey WHEN 0 THEN 'codul muncii' WHEN 1 THEN 'contract' WHEN 2 THEN 'fiscal' WHEN 3 THEN 'legea contractelor' ELSE lower(n_name) END AS alias,
 CASE WHEN n_nationkey % 2 = 0 THEN 'privind muncii' ELSE '' END AS title, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '18' END AS doc_type, CASE WHEN n_nationkey % 3 <> 2 THEN (n_nationkey * 4 + 1) || '-' || (1991 + n_nationkey * 4 % 30) ELSE '' END AS number FROM nation)"""


def aliases(spark, d):
    k = F.col("n_nationkey")
    named = F.when(k == 0, "codul muncii").when(k == 1, "contract").when(k == 2, "fiscal").when(k == 3, "legea contractelor").otherwise(F.lower("n_name"))
    number = F.concat((k * 4 + 1).cast("string"), F.lit("-"), (1991 + k * 4 % 30).cast("string"))
    return S.load(spark, d, "nation").select(
        k.alias("place"), named.alias("alias"), F.when(k % 2 == 0, "privind muncii").otherwise("").alias("title"),
        F.when(k % 2 == 0, "").otherwise("18").alias("doc_type"), F.when(k % 3 != 2, number).otherwise("").alias("number"),
    )


BARE = lambda e: f"array_to_string(list_transform(string_split_regex({sql_fold(e)}, '\\s+'), lambda w: regexp_replace(w, '^(.{{2,}})(?:ul|a|ea|ua|ului|ei|iei|elor)$', '\\1')), ' ')"
CUT = "trim(regexp_replace(lower(text), '^(?:legea |lege |oug |hg |og |ordin |ordinul |hotarare |hotararea |ordonanta |decizie |decizia )', ''))"


@add("expand_aliases", S.with_(CQ, ALIASES) + f"""SELECT query_id, alias, title, doc_type, number FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l, place) AS r FROM (
 SELECT query_id, a.*, CASE WHEN lower(text) = alias THEN 0 WHEN {CUT} = alias THEN 1 WHEN {BARE("lower(text)")} = {BARE("alias")} OR {BARE(CUT)} = {BARE("alias")} THEN 2
  WHEN length(alias) >= 3 AND contains(lower(text), alias) THEN 3 END AS l FROM cq, aliases a) WHERE l IS NOT NULL) WHERE r = 1""")
def expand_aliases(spark, d):
    return L.expand_aliases(catalog_queries(spark, d), aliases(spark, d))


@add("rank_results", """SELECT o_custkey AS query_id, o_orderkey AS ver_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY boosted DESC, CASE WHEN tier = pt THEN 0 ELSE 1 END, tier, o_orderkey) AS rank FROM (
 SELECT *, o_totalprice > 400000 AS boosted, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS tier,
 CASE o_custkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 END AS pt FROM orders)) WHERE rank <= 8""")
def rank_results(spark, d):
    o = S.load(spark, d, "orders")
    k, p = F.col("o_custkey"), F.col("o_orderpriority")
    rows = o.select(
        k.alias("query_id"), F.col("o_orderkey").alias("ver_id"), F.col("o_orderkey").alias("place"), (F.col("o_totalprice") > 400000).alias("boosted"),
        F.when(k % 4 == 0, "ordonanță de urgență").when(k % 4 == 1, "Hotărâre nr. 5").when(k % 4 == 2, "legea muncii").otherwise("nimic").alias("query"),
        F.when(p == "1-URGENT", "Lege").when(p == "2-HIGH", "OUG").when(p == "3-MEDIUM", "HG").otherwise("DECRET").alias("doc_type"),
    )
    return L.rank_results(rows, k=8).select("query_id", "ver_id", "rank")


SEARCH = """sq AS (SELECT p_partkey AS query_id, CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) || '/' || (1990 + p_partkey % 30) WHEN 1 THEN CAST(p_partkey % 1500 AS VARCHAR) WHEN 2 THEN 'Customer build ' || p_partkey % 100
 WHEN 3 THEN 'mach 19' ELSE '7' END AS text FROM part)"""


@add("library_search", S.with_(S.LAWS, SEARCH) + """, e AS (SELECT query_id, law_id, 0 AS p, l.law_year FROM sq JOIN laws l ON (regexp_matches(text, '\\d+/\\d{4}') AND l.law_number = split_part(text, '/', 1) AND l.law_year = CAST(nullif(split_part(text, '/', 2), '') AS INTEGER)) OR (regexp_full_match(text, '\\d+') AND l.law_number = text)),
 t AS (SELECT query_id, law_id, 1 AS p, law_year FROM sq JOIN laws l ON len(list_filter(string_split(lower(text), ' '), lambda w: NOT contains(lower(title || ' ' || document_type || ' ' || law_number || ' ' || law_year), w))) = 0),
 m AS (SELECT query_id, law_id, min(p) AS p, any_value(law_year) AS law_year FROM (SELECT * FROM e UNION ALL SELECT * FROM t) GROUP BY 1, 2)
 SELECT query_id, law_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, law_year DESC, law_id) AS rank FROM m) WHERE rank <= 10""")
def library_search(spark, d):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(s(k), F.lit("/"), s(1990 + k % 30)))
        .when(k % 5 == 1, s(k % 1500))
        .when(k % 5 == 2, F.concat(F.lit("Customer build "), s(k % 100)))
        .when(k % 5 == 3, "mach 19")
        .otherwise("7")
    )
    q = S.load(spark, d, "part").select(k.alias("query_id"), text.alias("text"))
    return L.library_search(q, S.laws(spark, d).withColumn("description", F.col("document_type")))


STEMS = ("munc", "societ", "rotecti", "iscal", "ul", "codu uil", "nr 1", "a", "xyz", "LEGE contractel", "")
_STEMS = ", ".join(f"'{w}'" for w in STEMS)


@add("catalog_parts", f"""WITH cat AS (SELECT c_custkey AS ver_id, {sql_fold("""'LEGE nr. ' || c_custkey || ' privind ' || ['legea', 'codul', 'societăților', 'contractele', 'muncii', 'protecția', 'fiscală'][1 + c_custkey % 7] || ' '
  || ['legea', 'codul', 'societăților', 'contractele', 'muncii', 'protecția', 'fiscală'][1 + c_custkey // 7 % 7] || ' ' || c_mktsegment""")} AS hay FROM customer),
 asks AS (SELECT s_suppkey AS query_id, string_split(lower([{_STEMS}][1 + s_suppkey % {len(STEMS)}]), ' ') AS ws FROM supplier)
SELECT query_id, count(*) AS n_entries, min(ver_id) AS first_id, max(ver_id) AS last_id FROM asks JOIN cat ON ws[1] <> '' AND len(list_filter(ws, lambda w: NOT contains(hay, w))) = 0 GROUP BY 1""")
def catalog_parts(spark, d):
    """Parts of words: 'munc' finds 'muncii'."""
    stems = F.array(*[F.lit(w) for w in STEMS])
    asks = S.load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("query_id"), F.lit(0).alias("variant"), F.element_at(stems, (1 + F.col("s_suppkey") % len(STEMS)).cast("int")).alias("phrase")
    )
    entries = catalog(spark, d).select("ver_id", F.concat_ws(" ", "title", "description").alias("text"))
    return L.count_holding(asks, entries)


@add("search_catalog")
def search_catalog(spark, d):
    return L.search_catalog(catalog_queries(spark, d), catalog(spark, d), aliases(spark, d))


@add("parse_query", S.with_(CQ) + """SELECT query_id, CASE WHEN query_id % 6 IN (0, 3) THEN '' ELSE text END AS title, CASE WHEN query_id % 6 = 0 THEN '1' ELSE '' END AS doc_type,
 CASE WHEN query_id % 6 = 0 THEN replace(substr(text, 7), '/', '-') WHEN query_id % 6 = 3 THEN replace(text, '/', '-') ELSE '' END AS number FROM cq""")
def parse_query(spark, d):
    return catalog_queries(spark, d).select("query_id", F.inline(F.array(X.parse_query(F.col("text")))))


@add("significant_words", f"""SELECT p_partkey AS part_id, array_to_string(list_filter(string_split(lower(p_name || ' de la ' || p_type || ' o x ' || p_brand), ' '), lambda w: NOT list_contains([{", ".join("'" + w + "'" for w in X.STOP_WORDS)}], w) AND length(w) >= 2)[1:4], ' ') AS words FROM part""")
def significant_words(spark, d):
    text = F.concat("p_name", F.lit(" de la "), "p_type", F.lit(" o x "), "p_brand")
    return S.load(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.array_join(X.significant(text), " ").alias("words"))


@add("fold_text", f"SELECT doc_id, md5({sql_fold('text')}) AS folded FROM documents")
def fold_text(spark, d):
    return S.load(spark, d, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))
