"""Driver queries of the run, session, job and notice operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import modeltext as M
from palimpsest.operators import logs as L
from palimpsest.plans import standins as S
from palimpsest.plans.registry import REGISTRY

add = REGISTRY.add


@add("list_runs", S.with_(S.RUNS) + "SELECT run_id, module, overall_status FROM runs WHERE overall_status = 'error' AND overall_confidence = 'HIGH' ORDER BY started_at DESC, run_id DESC LIMIT 50 OFFSET 20")
def list_runs(spark, d):
    return L.list_runs(S.runs(spark, d), 50, 20, overall_status="error", overall_confidence="HIGH", module=None).select("run_id", "module", "overall_status")


@add("run_health", S.with_(S.RUNS) + """SELECT CAST(count(*) AS BIGINT) AS total_runs, CAST(count(*) FILTER (overall_status = 'ok') AS BIGINT) AS ok_count, CAST(count(*) FILTER (overall_status = 'warning') AS BIGINT) AS warning_count,
 CAST(count(*) FILTER (overall_status = 'error') AS BIGINT) AS error_count, CAST(count(*) FILTER (overall_status = 'partial') AS BIGINT) AS partial_count, round(count(*) FILTER (overall_status = 'ok') / count(*) * 100, 1) AS ok_pct,
 round(count(*) FILTER (overall_status = 'warning') / count(*) * 100, 1) AS warning_pct, round(count(*) FILTER (overall_status = 'error') / count(*) * 100, 1) AS error_pct,
 round(count(*) FILTER (overall_confidence = 'HIGH') / count(*) * 100, 1) AS high_pct, round(avg(CASE WHEN total_duration_seconds <> 0 THEN total_duration_seconds END), 1) AS avg_duration,
 round(avg(CASE WHEN total_duration_seconds <> 0 THEN total_duration_seconds / 100 END), 4) AS avg_cost FROM runs WHERE overall_status <> 'running'""")
def run_health(spark, d):
    return L.run_health(S.runs(spark, d).withColumn("estimated_cost", F.col("total_duration_seconds") / 100))


@add("common_flags", S.with_(S.RUNS) + """SELECT flag, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(from_json(flags, '["VARCHAR"]')) AS flag FROM runs WHERE overall_status <> 'running') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def common_flags(spark, d):
    return L.common_flags(S.runs(spark, d))


def _calls(spark, d):
    li = S.load(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"), F.concat(F.lit("model-"), F.col("l_linenumber").cast("string")).alias("model"),
        F.floor("l_extendedprice").alias("tokens_in"), F.floor("l_quantity").alias("tokens_out"), F.col("l_partkey").alias("call_no"),
    )


@add("run_costs", """SELECT o_orderkey AS run_id, coalesce(i, 0) AS tokens_in, coalesce(o, 0) AS tokens_out, round(coalesce(i, 0) * 3e-6 + coalesce(o, 0) * 15e-6, 6) AS estimated_cost, round(o_totalprice / 1000, 3) AS total_duration_seconds
 FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS i, CAST(sum(floor(l_quantity)) AS BIGINT) AS o FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def run_costs(spark, d):
    o = S.load(spark, d, "orders")
    start = F.col("o_orderdate").cast("timestamp")
    millis = F.round(F.col("o_totalprice") / 1000, 3) * 1_000_000
    runs = o.select(F.col("o_orderkey").alias("run_id"), start.alias("started_at"), F.timestamp_micros(F.unix_micros(start) + F.round(millis).cast("long")).alias("completed_at"))
    return L.run_costs(runs, _calls(spark, d))


def _prices(spark, d):
    p = S.load(spark, d, "region")
    k = F.col("r_regionkey")
    return p.select(
        F.concat(F.lit("model-"), (k + 1).cast("string")).alias("model"), F.when(k == 0, 0.002).alias("per_page"),
        (k * 0.5).alias("price_in"), (k * 2.0).alias("price_out"),
    )


PRICES = "prices AS (SELECT 'model-' || (r_regionkey + 1) AS model, CASE WHEN r_regionkey = 0 THEN 0.002 END AS per_page, r_regionkey * 0.5 AS price_in, r_regionkey * 2.0 AS price_out FROM region)"
CALLS = "calls AS (SELECT l_orderkey AS run_id, 'model-' || l_linenumber AS model, CAST(floor(l_extendedprice) AS BIGINT) AS tokens_in, CAST(floor(l_quantity) AS BIGINT) AS tokens_out, l_partkey AS call_no FROM lineitem)"


@add("model_costs", S.with_(PRICES, CALLS) + """SELECT c.run_id, c.model, c.call_no, c.tokens_in, c.tokens_out, round(CAST(CASE WHEN per_page IS NOT NULL THEN per_page * tokens_in ELSE tokens_in / 1000000 * CAST(price_in AS DOUBLE) + tokens_out / 1000000 * CAST(price_out AS DOUBLE) END AS DOUBLE), 9) AS cost,
 p.model IS NULL AS unknown_model FROM calls c LEFT JOIN prices p ON p.model = c.model""")
def model_costs(spark, d):
    return L.model_costs(_calls(spark, d), _prices(spark, d))


@add("unknown_models", S.with_(PRICES, CALLS) + "SELECT model, CAST(count(*) AS BIGINT) AS calls FROM calls WHERE model NOT IN (SELECT model FROM prices) GROUP BY 1")
def unknown_models(spark, d):
    return L.unknown_models(_calls(spark, d), _prices(spark, d))


@add("session_summary", S.with_(S.MESSAGES) + r"""SELECT session_id, CAST(count(*) AS BIGINT) AS message_count, max(turn) AS last_active, regexp_replace(arg_min(substr(content, 1, 100), turn) FILTER (role = 'user'), '^\s+|\s+$', '', 'g') AS title FROM messages GROUP BY 1""")
def session_summary(spark, d):
    return L.session_summary(S.messages(spark, d))


@add("conversation_context", S.with_(S.MESSAGES) + """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS place, role, content FROM
 (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS r FROM messages) WHERE r <= 4""")
def conversation_context(spark, d):
    return L.conversation_context(S.messages(spark, d), 4)


@add("dedupe_steps", """SELECT run_id, step_name, id, step_number FROM (SELECT user_id AS run_id, event_type AS step_name, event_id AS id, CAST(event_id % 9 AS INTEGER) AS step_number,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 9 IN (1, 2, 3) DESC, (CASE WHEN event_id % 5 <> 0 THEN value ELSE 0 END) <> 0 DESC, event_id) AS r FROM events) WHERE r = 1""")
def dedupe_steps(spark, d):
    e = S.load(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("step_name"), F.col("event_id").alias("id"), (F.col("event_id") % 9).cast("int").alias("step_number"),
        F.when(F.col("event_id") % 5 != 0, F.col("value")).otherwise(0.0).alias("duration_seconds"),
    )
    return L.dedupe_steps(e, [1, 2, 3]).select("run_id", "step_name", "id", "step_number")


def _notices(spark, d):
    return S.load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("event_type") == "view").alias("is_read"), F.col("event_type").alias("title"))


@add("notifications", "SELECT event_id AS id, event_type AS title FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 50")
def notifications(spark, d):
    return L.notifications(_notices(spark, d), unread_only=True).select("id", "title")


@add("unread_count", "SELECT CAST(count(*) FILTER (event_type <> 'view') AS BIGINT) AS unread FROM events")
def unread_count(spark, d):
    return L.unread_count(_notices(spark, d))


def _jobs(spark, d):
    o = S.load(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.lit("law").alias("entity_kind"),
        F.col("o_custkey").cast("string").alias("entity_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
    )


@add("list_jobs", "SELECT o_orderkey AS id, o_custkey || '' AS entity_id FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus NOT IN ('P', 'O') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def list_jobs(spark, d):
    return L.list_jobs(_jobs(spark, d), kind="2-HIGH", active=False).select("id", "entity_id")


@add("has_active", "SELECT count(*) > 0 AS active FROM orders WHERE o_custkey = 7 AND o_orderstatus IN ('P', 'O')")
def has_active(spark, d):
    return L.has_active(_jobs(spark, d), entity_kind="law", entity_id=7)


@add("check_feed", S.with_(S.LAWS) + """SELECT e.event_id AS id, l.law_id, l.title || ' (' || l.law_number || '/' || l.law_year || ')' AS law_label, u.s_name AS user_email, e.event_type AS status FROM events e JOIN laws l ON l.law_id = e.user_id * 3
 LEFT JOIN supplier u ON u.s_suppkey = e.user_id ORDER BY e.ts DESC, e.event_id DESC LIMIT 100""")
def check_feed(spark, d):
    logs = S.load(spark, d, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") * 3).alias("law_id"), F.col("user_id"), F.col("ts").alias("checked_at"), F.lit(0).alias("new_versions"), F.col("event_type").alias("status")
    )
    users = S.load(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("email"))
    return L.check_feed(logs, S.laws(spark, d), users, 100).select("id", "law_id", "law_label", "user_email", "status")


# --- text written by a model -----------------------------------------------------------------


def _outputs(spark, d):
    """Model output built from the orders: clean, fenced, commented, with chatter around, or none."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"issues": [{"issue_id": "I-'), k.cast("string"), F.lit('", "certainty_level": "'), F.col("o_orderstatus"), F.lit('"}]}'))
    commented = F.concat(F.lit('{"issues": [{"issue_id": "I-'), k.cast("string"), F.lit('", // the id, with "quotes"\n"certainty_level": "'), F.col("o_orderstatus"), F.lit('"}]} '))
    raw = (
        F.when(k % 5 == 0, body)
        .when(k % 5 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(k % 5 == 2, commented)
        .when(k % 5 == 3, F.concat(F.lit("I think "), body, F.lit(" is right }")))
        .otherwise("no object { here")
    )
    return S.load(spark, d, "orders").select(k.alias("run_id"), raw.alias("raw"))


@add("analysis_issues", "SELECT o_orderkey AS run_id, 'I-' || o_orderkey AS issue_id, o_orderstatus AS certainty_level, 'PRESENT' AS norm_status FROM orders WHERE o_orderkey % 5 <> 4")
def analysis_issues(spark, d):
    out = _outputs(spark, d).select("run_id", F.inline(M.analysis_issues(F.col("raw"))))
    return out.select("run_id", "issue_id", "certainty_level", "norm_status")


@add("scorer_scores", """SELECT o_orderkey AS question_id, CAST(i AS INTEGER) AS idx, CASE i WHEN 0 THEN o_totalprice ELSE 0.5 END AS score FROM orders, range(2) r(i)""")
def scorer_scores(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit('Sure: {"scores": [{"idx": 0, "score": '), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit('}, {"idx": 1, "score": 0.5}]} ok'))
    return M.scorer_scores(S.load(spark, d, "orders").select(k.alias("question_id"), text.alias("content")), "content")


@add("check_candidates", """SELECT p_partkey AS ref_id, p_size % 7 = 0 AS malformed, CASE WHEN p_type = 'ECONOMY' THEN 'PRIMARY' ELSE 'SECONDARY' END AS role FROM part""")
def check_candidates(spark, d):
    p = S.load(spark, d, "part").select(
        F.col("p_partkey").alias("ref_id"), F.when(F.col("p_size") % 7 != 0, F.col("p_partkey").cast("string")).otherwise(" ").alias("law_number"),
        F.lit(2000).alias("law_year"), F.when(F.col("p_type") == "ECONOMY", "PRIMARY").otherwise(F.col("p_type")).alias("role"),
    )
    return M.check_candidates(p).select("ref_id", "malformed", "role")
