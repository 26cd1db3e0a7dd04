"""Stand-in relations over the driver tables, once for Spark and once as SQL text.

The library works on tables of laws, versions, articles and so on. The driver's tables hold other
things, so each relation is a plain projection of one of them. Both forms must stay equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TODAY = "2000-01-01"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def laws(spark, d):
    c = load(spark, d, "customer")
    return c.select(
        F.col("c_custkey").alias("law_id"),
        F.col("c_custkey").cast("string").alias("law_number"),
        (F.lit(1990) + F.col("c_custkey") % 30).cast("int").alias("law_year"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("document_type"),
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_nationkey")).cast("long").alias("category_id"),
        F.when(F.col("c_custkey") % 4 == 0, "eu").otherwise("ro").alias("source"),
    )


LAWS = """laws AS (SELECT c_custkey AS law_id, CAST(c_custkey AS VARCHAR) AS law_number,
 CAST(1990 + c_custkey % 30 AS INTEGER) AS law_year, c_name AS title, c_mktsegment AS document_type,
 CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS category_id,
 CASE WHEN c_custkey % 4 = 0 THEN 'eu' ELSE 'ro' END AS source FROM customer)"""


def known(spark, d):
    """Known versions; the newest of each law (highest id on ties) is current."""
    o = load(spark, d, "orders").select(
        F.col("o_custkey").alias("law_id"),
        F.col("o_orderkey").alias("ver_id"),
        F.to_date("o_orderdate").alias("date_in_force"),
    )
    newest = o.groupBy("law_id").agg(F.max_by("ver_id", F.struct("date_in_force", "ver_id")).alias("_cur"))
    return o.join(newest, "law_id").select(
        "law_id", "ver_id", "date_in_force", (F.col("ver_id") == F.col("_cur")).alias("is_current")
    )


KNOWN = """known AS (SELECT o_custkey AS law_id, o_orderkey AS ver_id, CAST(o_orderdate AS DATE) AS date_in_force,
 row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1 AS is_current
 FROM orders)"""


def versions(spark, d):
    """Imported versions: two thirds of the known ones, some without a date."""
    k = known(spark, d).where(F.col("ver_id") % 3 != 0)
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("ver_id"), F.col("o_orderstatus").alias("state"))
    return k.join(o, "ver_id").select(
        F.col("ver_id").alias("version_id"),
        "law_id",
        "ver_id",
        F.when(F.col("ver_id") % 17 != 0, F.col("date_in_force")).alias("date_in_force"),
        "state",
        "is_current",
    )


VERSIONS = (
    KNOWN
    + """, versions AS (SELECT k.ver_id AS version_id, k.law_id, k.ver_id,
 CASE WHEN k.ver_id % 17 <> 0 THEN k.date_in_force END AS date_in_force, o.o_orderstatus AS state, k.is_current
 FROM known k JOIN orders o ON o.o_orderkey = k.ver_id WHERE k.ver_id % 3 <> 0)"""
)

ARTICLE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def articles(spark, d):
    li = load(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*ARTICLE_ORDER)
    n = F.col("l_quantity").cast("long")
    lead = (
        F.when(F.col("l_returnflag") == "A", "cu exceptia prevederilor art. ")
        .when(F.col("l_returnflag") == "R", "prin derogare de la prevederile art. ")
        .otherwise("potrivit art. ")
    )
    text = F.concat(
        F.lit("Prevederile art. "), (F.col("l_linenumber") + 1).cast("string"), F.lit(" se aplica, "), lead,
        n.cast("string"), F.lit("; vezi art. "), F.col("l_linenumber").cast("string"), F.lit(" din Legea nr. "),
        F.col("l_suppkey").cast("string"), F.lit("/"), (F.lit(1990) + F.col("l_suppkey") % 30).cast("string"),
        F.lit(" si art. 2 C.muncii, partea "), F.col("l_linestatus"),
    )
    return li.withColumn("order_index", F.row_number().over(w).cast("long")).select(
        (F.col("l_orderkey") * 1000 + F.col("order_index")).alias("article_id"),
        F.col("l_orderkey").alias("version_id"),
        F.col("l_linenumber").cast("string").alias("article_number"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("element_id"),
        "order_index",
        text.alias("full_text"),
    )


ARTICLES = """articles AS (SELECT l_orderkey * 1000 + rn AS article_id, l_orderkey AS version_id,
 CAST(l_linenumber AS VARCHAR) AS article_number,
 CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS element_id, rn AS order_index,
 'Prevederile art. ' || (l_linenumber + 1) || ' se aplica, ' ||
 CASE l_returnflag WHEN 'A' THEN 'cu exceptia prevederilor art. ' WHEN 'R' THEN 'prin derogare de la prevederile art. '
   ELSE 'potrivit art. ' END || CAST(floor(l_quantity) AS BIGINT) ||
 '; vezi art. ' || l_linenumber || ' din Legea nr. ' || l_suppkey || '/' || (1990 + l_suppkey % 30) ||
 ' si art. 2 C.muncii, partea ' || l_linestatus AS full_text
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
 l_extendedprice) AS rn FROM lineitem))"""


def issues(spark, d):
    """Issues of questions, one row per (question, issue, law), with dates kept as given."""
    c = load(spark, d, "customer")
    k = F.col("c_custkey")
    day = F.date_add(F.lit("1995-06-01").cast("date"), (k % 2200).cast("int")).cast("string")
    return c.select(
        (k % 40).alias("question_id"),
        F.concat(F.lit("ISSUE-"), (k % 3 + 1).cast("string")).alias("issue_id"),
        k.alias("law_id"),
        F.when(k % 11 == 0, "unknown").when(k % 13 == 0, "2030-01-01").when(k % 29 != 0, day).alias("relevant_date"),
        F.when(k % 2 == 0, "PRIMARY").otherwise("SECONDARY").alias("role"),
    )


ISSUES = """issues AS (SELECT c_custkey % 40 AS question_id, 'ISSUE-' || (c_custkey % 3 + 1) AS issue_id,
 c_custkey AS law_id, CASE WHEN c_custkey % 11 = 0 THEN 'unknown' WHEN c_custkey % 13 = 0 THEN '2030-01-01'
 WHEN c_custkey % 29 <> 0 THEN CAST(CAST(DATE '1995-06-01' + CAST(c_custkey % 2200 AS INTEGER) AS DATE) AS VARCHAR) END AS relevant_date,
 CASE WHEN c_custkey % 2 = 0 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role FROM customer)"""


def corpus(spark, d):
    """Search corpus: English documents stand for articles, the others for annexes. Annexes are numbered
    one up, so that many share a number with an article."""
    article = F.col("lang") == "en"
    return load(spark, d, "documents").select(
        F.when(article, "article").otherwise("annex").alias("doc_type"),
        F.when(article, F.col("doc_id")).otherwise(F.col("doc_id") + 1).alias("doc_id"),
        (F.col("doc_id") % 20).alias("version_id"),
        "text",
    )


CORPUS = """corpus AS (SELECT CASE WHEN lang = 'en' THEN 'article' ELSE 'annex' END AS doc_type,
 CASE WHEN lang = 'en' THEN doc_id ELSE doc_id + 1 END AS doc_id, doc_id % 20 AS version_id, text FROM documents)"""


def doc_vectors(spark, d):
    """Vectors of the corpus, keyed by kind and number as it is."""
    article = F.col("lang") == "en"
    kinds = load(spark, d, "documents").select(
        F.col("doc_id").alias("_id"),
        F.when(article, "article").otherwise("annex").alias("doc_type"),
        F.when(article, F.col("doc_id")).otherwise(F.col("doc_id") + 1).alias("_number"),
    )
    found = vectors(spark, d).withColumnRenamed("vec_id", "_id").join(kinds, "_id")
    return found.select("doc_type", F.col("_number").alias("vec_id"), "vector", "version_id")


DOC_VECTORS = """docvec AS (SELECT CASE WHEN lang = 'en' THEN 'article' ELSE 'annex' END AS doc_type,
 CASE WHEN lang = 'en' THEN vec_id ELSE vec_id + 1 END AS vec_id, vec_id % 20 AS version_id, embedding AS vector
 FROM embeddings JOIN documents ON doc_id = vec_id)"""


def questions(spark, d):
    return load(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")


QUESTIONS = "questions AS (SELECT item_id AS question_id, text FROM benchmark)"


def vectors(spark, d):
    return load(spark, d, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector"), (F.col("vec_id") % 20).alias("version_id"), "label"
    )


VECTORS = "vectors AS (SELECT vec_id, embedding AS vector, vec_id % 20 AS version_id, label FROM embeddings)"


def query_vectors(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))


QUERY_VECTORS = "qvec AS (SELECT vec_id AS question_id, embedding AS vector FROM embeddings)"


def fx(spark, d):
    return load(spark, d, "events").groupBy(F.to_date("ts").alias("date"), F.upper("event_type").alias("currency")).agg(
        F.min("value").alias("rate")
    )


FX = """fx AS (SELECT CAST(ts AS DATE) AS date, upper(event_type) AS currency, min(value) AS rate FROM events GROUP BY 1, 2)"""


def interest(spark, d):
    o = load(spark, d, "orders")
    series = o.groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("tenor")).agg(
        F.min("o_totalprice").alias("rate")
    )
    sparse = (F.col("tenor") == "5-LOW") & (F.datediff("date", F.lit("1995-01-01")) % 9 != 0)
    return series.where(~sparse).select(
        "date",
        F.when(F.col("tenor") < "3", "ROBOR").otherwise("EURIBOR").alias("rate_type"),
        "tenor",
        "rate",
    )


INTEREST = """interest AS (SELECT date, CASE WHEN tenor < '3' THEN 'ROBOR' ELSE 'EURIBOR' END AS rate_type, tenor, rate FROM
 (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS tenor, min(o_totalprice) AS rate FROM orders GROUP BY 1, 2)
 WHERE NOT (tenor = '5-LOW' AND (date - DATE '1995-01-01') % 9 <> 0))"""


def runs(spark, d):
    e = load(spark, d, "events")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("module"),
        F.when(F.col("event_type") == "click", "ok")
        .when(F.col("event_type") == "view", "warning")
        .when(F.col("event_type") == "purchase", "partial")
        .when(F.col("event_type") == "error", "error")
        .otherwise("running")
        .alias("overall_status"),
        F.element_at(F.array(*[F.lit(v) for v in ("HIGH", "MEDIUM", "LOW")]), (F.col("event_id") % 3 + 1).cast("int")).alias(
            "overall_confidence"
        ),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).otherwise(0.0).alias("total_duration_seconds"),
        F.col("ts").alias("started_at"),
        F.concat(F.lit('["flag-'), F.get_json_object("props", "$.k"), F.lit('", "all"]')).alias("flags"),
    )


RUNS = """runs AS (SELECT event_id AS run_id, 'user-' || user_id AS module,
 CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'warning' WHEN 'purchase' THEN 'partial' WHEN 'error' THEN 'error'
 ELSE 'running' END AS overall_status,
 CASE event_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS overall_confidence,
 CASE WHEN event_id % 7 <> 0 THEN value ELSE 0.0 END AS total_duration_seconds, ts AS started_at,
 '["flag-' || json_extract_string(props, '$.k') || '", "all"]' AS flags FROM events)"""


def messages(spark, d):
    return load(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("turn"), "role", F.col("text").alias("content")
    )


MESSAGES = "messages AS (SELECT conv_id AS session_id, turn, role, text AS content FROM conversations)"


def with_(*parts: str) -> str:
    """Join relation texts into one WITH clause, each relation once."""
    return "WITH " + ", ".join(dict.fromkeys(parts)) + " "
