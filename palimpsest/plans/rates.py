"""Driver queries of the rate readers and rate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dates as D
from palimpsest.operators import rates as R
from palimpsest.sources import rates as P
from palimpsest.plans import standins as S
from palimpsest.plans.registry import REGISTRY

add = REGISTRY.add
TODAY = "2001-08-01"


def day_text(df, *cols):
    for c in cols or ("date",):
        df = df.withColumn(c, F.col(c).cast("string"))
    return df


# --- readers: documents are written out of the stored series, read back, and compared -------

TENOR_HEADS = (("1-URGENT", "1 luna", "1M"), ("2-HIGH", "3 luni", "3M"), ("3-MEDIUM", "6 luni", "6M"), ("4-NOT SPECIFIED", "12 luni", "12M"))


@add("read_fx_xml", S.with_(S.FX) + """SELECT CAST(date AS VARCHAR) AS date, currency, rate, CASE WHEN currency = 'VIEW' THEN 100 ELSE 1 END AS multiplier FROM fx WHERE currency <> 'ERROR'""")
def read_fx_xml(spark, d):
    mult = F.when(F.col("currency") == "VIEW", ' multiplier="100"').when(F.col("currency") == "CLICK", ' multiplier="x"').otherwise("")
    value = F.when(F.col("currency") == "ERROR", "n/a").otherwise(F.col("rate").cast("string"))
    rate = F.concat(F.lit('<Rate currency="'), "currency", F.lit('"'), mult, F.lit(">"), value, F.lit("</Rate>"))
    days = S.fx(spark, d).groupBy("date").agg(F.array_join(F.sort_array(F.collect_list(rate)), "").alias("r"))
    xml = F.concat(F.lit('<?xml version="1.0"?><DataSet><Body><Cube date="'), F.col("date").cast("string"), F.lit('">'), "r", F.lit("</Cube></Body></DataSet>"))
    return day_text(P.parse_fx_xml(days.select(F.col("date").cast("string").alias("doc_id"), xml.alias("value"))))


def _wide(spark, d):
    rows = S.interest(spark, d).where(F.col("tenor") != "5-LOW")
    return rows.groupBy("date").pivot("tenor", [t for t, _, _ in TENOR_HEADS]).agg(F.min("rate"))


WIDE_SQL = "SELECT CAST(date AS VARCHAR) AS date, '{type}' AS rate_type, CASE tenor WHEN '1-URGENT' THEN '1M' WHEN '2-HIGH' THEN '3M' WHEN '3-MEDIUM' THEN '6M' ELSE '12M' END AS tenor, round(rate, 2) AS rate FROM interest WHERE tenor <> '5-LOW'"


def _cells(tag, cols):
    return F.concat(*[F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>")) for c in cols])


def _comma(c):
    return F.coalesce(F.replace(c.cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.lit("-"))


@add("read_rate_table_down", S.with_(S.INTEREST) + WIDE_SQL.format(type="ROBOR"))
def read_rate_table_down(spark, d):
    """One page per month, dates down, tenors across, comma decimals, an unknown column."""
    wide = _wide(spark, d)
    line = F.concat(F.lit("<tr>"), _cells("td", [F.date_format("date", "dd MMM yyyy"), F.lit("9,99"), *[_comma(F.col(t)) for t, _, _ in TENOR_HEADS]]), F.lit("</tr>"))
    pages = wide.groupBy(F.trunc("date", "month").alias("m")).agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("body"))
    head = "<html><table><tr><td>x</td></tr><tr><th>Data</th><th>T/N</th>" + "".join(f"<th>{h}</th>" for _, h, _ in TENOR_HEADS) + "</tr>"
    docs = pages.select(F.col("m").cast("string").alias("doc_id"), F.concat(F.lit(head), "body", F.lit("</table></html>")).alias("value"))
    return day_text(P.parse_rate_tables(docs, "ROBOR"))


@add("read_rate_table_auto", S.with_(S.INTEREST) + WIDE_SQL.format(type="EURIBOR"))
def read_rate_table_auto(spark, d):
    """S3: even months as tenor columns, odd months as date columns."""
    heads = {"1-URGENT": "Euribor 1 month", "2-HIGH": "Euribor 3 months", "3-MEDIUM": "Euribor 6 months", "4-NOT SPECIFIED": "Euribor 12 months"}
    us = F.concat_ws("/", F.month("date").cast("string"), F.dayofmonth("date").cast("string"), F.year("date").cast("string"))
    pct = lambda c: F.coalesce(F.concat(c.cast("decimal(18,2)").cast("string"), F.lit(" %")), F.lit("-"))
    wide = _wide(spark, d).withColumn("m", F.trunc("date", "month"))
    line = F.concat(F.lit("<tr><th>"), us, F.lit("</th>"), _cells("td", [pct(F.col(t)) for t in heads]), F.lit("</tr>"))
    down = wide.where("month(m) % 2 = 0").groupBy("m").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("b"))
    head = "<table><tr><th></th>" + "".join(f"<th>{h}</th>" for h in heads.values()) + "</tr>"
    down = down.select(F.col("m").cast("string").alias("doc_id"), F.concat(F.lit(head), "b", F.lit("</table>")).alias("value"))
    odd = wide.where("month(m) % 2 = 1").groupBy("m").agg(F.sort_array(F.collect_list(F.struct("date", us.alias("us"), *[pct(F.col(t)).alias(f"c{i}") for i, t in enumerate(heads)]))).alias("a"))
    row = lambda i, h: F.concat(F.lit(f"<tr><th>{h}</th>"), F.array_join(F.transform("a", lambda x: F.concat(F.lit("<td>"), x[f"c{i}"], F.lit("</td>"))), ""), F.lit("</tr>"))
    top = F.concat(F.lit("<table><tr><th></th>"), F.array_join(F.transform("a", lambda x: F.concat(F.lit("<th>"), x["us"], F.lit("</th>"))), ""), F.lit("</tr>"))
    across = odd.select(F.col("m").cast("string").alias("doc_id"), F.concat(top, *[row(i, h) for i, h in enumerate(heads.values())], F.lit("</table>")).alias("value"))
    return day_text(P.parse_rate_tables(down.unionByName(across), "EURIBOR", layout="auto"))


@add("read_rate_series_json", S.with_(S.INTEREST) + "SELECT CAST(date AS VARCHAR) AS date, 'EURIBOR' AS rate_type, CASE tenor WHEN '1-URGENT' THEN '1M' WHEN '2-HIGH' THEN '3M' WHEN '3-MEDIUM' THEN '6M' ELSE '12M' END AS tenor, rate FROM interest WHERE tenor <> '5-LOW' AND tenor <> '4-NOT SPECIFIED' OR tenor = '4-NOT SPECIFIED' AND rate > 1000000")
def read_rate_series_json(spark, d):
    """One payload per month; series 9 is unknown, and its series' neighbours hold junk points."""
    ids = F.when(F.col("tenor") == "1-URGENT", "1").when(F.col("tenor") == "2-HIGH", "2").when(F.col("tenor") == "3-MEDIUM", "3").otherwise("9")
    point = F.concat(F.lit("["), (F.unix_seconds(F.col("date").cast("timestamp")) * 1000).cast("string"), F.lit(","), F.col("rate").cast("decimal(18,4)").cast("string"), F.lit("]"))
    rows = S.interest(spark, d).groupBy(F.trunc("date", "month").alias("m"), ids.alias("id")).agg(F.array_join(F.collect_list(point), ",").alias("p"))
    series = F.concat(F.lit('{"Id":'), "id", F.lit(',"Data":[["x",1],[5],[6,true],[7,"8"],'), "p", F.lit("]}"))
    docs = rows.groupBy("m").agg(F.array_join(F.collect_list(series), ",").alias("s")).select(F.col("m").cast("string").alias("doc_id"), F.concat(F.lit('[{"Id":"q"},'), "s", F.lit("]")).alias("value"))
    broken = docs.select("doc_id", F.lit('{"Id": 1').alias("value"))
    return day_text(P.parse_rate_series(docs.unionByName(broken)))


@add("read_rate_grid", S.with_(S.INTEREST) + WIDE_SQL.format(type="ROBOR"))
def read_rate_grid(spark, d):
    """One export per month with title lines, units under the heads, '-' for missing."""
    heads = ("Data", "ROBOR 1 lună", "ROBOR 3 luni", "ROBOR 6 luni", "ROBOR 12 luni")
    num = lambda c: F.coalesce(F.concat(F.lit('"'), _comma(F.col(c)), F.lit('"')), F.lit("-"))
    line = F.concat_ws(",", F.col("date").cast("string"), *[num(t) for t, _, _ in TENOR_HEADS])
    docs = _wide(spark, d).groupBy(F.trunc("date", "month").alias("m")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("b"))
    top = "Dobanzi,,,\n\n" + ",".join(heads) + "\nunit,%,%,%,%\n"
    return day_text(P.parse_rate_grid(docs.select(F.col("m").cast("string").alias("doc_id"), F.concat(F.lit(top), "b").alias("value"))))


@add("seed_rows", S.with_(S.INTEREST) + "SELECT CAST(date AS VARCHAR) AS date, CASE WHEN tenor = '5-LOW' THEN 'ROBOR' ELSE rate_type END AS rate_type, CASE WHEN tenor = '5-LOW' THEN '' ELSE tenor END AS tenor, rate FROM interest WHERE tenor NOT IN ('1-URGENT', '2-HIGH')")
def seed_rows(spark, d):
    t = F.col("tenor")
    raw = S.interest(spark, d).select(
        F.when(t == "1-URGENT", "31/12/1999").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(t != "5-LOW", F.col("rate_type")).alias("rate_type"),
        F.when(t != "5-LOW", t).alias("tenor"),
        F.when(t == "2-HIGH", "-").otherwise(F.concat(F.replace(F.col("rate").cast("decimal(18,4)").cast("string"), F.lit("."), F.lit(",")), F.lit(" %"))).alias("rate"),
    )
    return day_text(P.seed_rows(raw))


# --- operators -------------------------------------------------------------------------------


@add("fx_range", S.with_(S.FX) + "SELECT CAST(date AS VARCHAR) AS date, currency, rate FROM fx WHERE currency = 'CLICK' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' ORDER BY date DESC LIMIT 30")
def fx_range(spark, d):
    return day_text(R.rates_range(S.fx(spark, d), {"currency": "click"}, "2024-01-05", "2024-01-25"))


@add("interest_range", S.with_(S.INTEREST) + "SELECT CAST(date AS VARCHAR) AS date, rate_type, tenor, rate FROM interest WHERE rate_type = 'EURIBOR' AND date >= DATE '1999-01-01' ORDER BY date DESC, rate_type, tenor LIMIT 500")
def interest_range(spark, d):
    return day_text(R.rates_range(S.interest(spark, d), {"rate_type": "euribor", "tenor": None}, "1999-01-01", None, 500))


@add("rates_health", S.with_(S.FX, S.INTEREST) + f"""SELECT series, tenor, n AS row_count, CAST(m AS VARCHAR) AS latest_date, CAST(DATE '{TODAY}' - m AS DOUBLE) AS age_days FROM (
 SELECT 'fx' AS series, '' AS tenor, CAST(count(*) AS BIGINT) AS n, max(date) AS m FROM fx
 UNION ALL SELECT lower(t), '', CAST(count(rate) AS BIGINT), max(date) FROM (VALUES ('ROBOR'), ('EURIBOR'), ('SOFR')) x(t) LEFT JOIN interest ON rate_type = t GROUP BY 1
 UNION ALL SELECT 'euribor', tenor, CAST(count(*) AS BIGINT), max(date) FROM interest WHERE rate_type = 'EURIBOR' GROUP BY 2)""")
def rates_health(spark, d):
    out = R.rates_health(S.fx(spark, d), S.interest(spark, d), TODAY, ("ROBOR", "EURIBOR", "SOFR"))
    return day_text(out, "latest_date").withColumn("age_days", F.col("age_days").cast("double"))


def _windows(spark, d):
    one = S.load(spark, d, "orders").agg(F.year(F.min("o_orderdate")).alias("y"), F.to_date(F.max("o_orderdate")).alias("t"))
    return one.select(F.inline(D.history_windows(F.col("y"), F.col("t"))))


WINDOWS = """w AS (SELECT make_date(y + 2 * i, 1, 1) AS "start", least(make_date(y + 2 * i + 1, 12, 31), t) AS "end" FROM (SELECT min(year(o_orderdate)) AS y, CAST(max(o_orderdate) AS DATE) AS t FROM orders), range(50) r(i) WHERE make_date(y + 2 * i, 1, 1) <= t)"""


@add("history_windows", S.with_(WINDOWS) + 'SELECT CAST("start" AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end" FROM w')
def history_windows(spark, d):
    return day_text(_windows(spark, d), "start", "end")


TENORS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")


@add("density_check", S.with_(S.INTEREST, WINDOWS) + f"""SELECT CAST("start" AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", tenor, n AS points, ("end" - "start" + 1) >= 60 AND n < 0.4 * ("end" - "start" + 1) * 5 / 7 AS sparse FROM (
 SELECT "start", "end", t AS tenor, CAST(count(date) AS BIGINT) AS n FROM w, (VALUES {", ".join(f"('{t}')" for t in TENORS)}) x(t) LEFT JOIN interest i ON i.tenor = t AND i.date BETWEEN "start" AND "end"
 WHERE NOT (t = '1-URGENT' AND "start" = (SELECT min("start") FROM w)) GROUP BY 1, 2, 3)""")
def density_check(spark, d):
    w = _windows(spark, d)
    failed = w.agg(F.min("start").alias("start")).withColumn("tenor", F.lit("1-URGENT"))
    return day_text(R.density_check(S.interest(spark, d), w, TENORS, failed), "start", "end")


# half of the series is stored already, with other values
STORED = "stored AS (SELECT date, rate_type, tenor, 0.0 AS rate FROM interest WHERE year(date) % 2 = 0)"


def _stored(spark, d):
    return S.interest(spark, d).where(F.year("date") % 2 == 0).withColumn("rate", F.lit(0.0))


@add("insert_if_absent", S.with_(S.INTEREST, STORED) + "SELECT CAST(date AS VARCHAR) AS date, rate_type, tenor, rate FROM interest i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.date = i.date AND s.rate_type = i.rate_type AND s.tenor = i.tenor)")
def insert_if_absent(spark, d):
    twice = S.interest(spark, d).unionByName(S.interest(spark, d))
    return day_text(R.load_rates(_stored(spark, d), twice, ["date", "rate_type", "tenor"]))


@add("load_summary", S.with_(S.INTEREST, STORED) + """SELECT tenor, CAST(count(*) AS BIGINT) AS fetched, CAST(count(*) FILTER (year(date) % 2 = 1) AS BIGINT) AS inserted, CAST(min(date) AS VARCHAR) AS from_date, CAST(max(date) AS VARCHAR) AS to_date FROM interest GROUP BY 1""")
def load_summary(spark, d):
    rows = S.interest(spark, d)
    new = R.load_rates(_stored(spark, d), rows, ["date", "rate_type", "tenor"])
    return day_text(R.load_summary(rows, new), "from_date", "to_date")


@add("rate_asof", S.with_(S.INTEREST) + """, req AS (SELECT o_orderkey AS request_id, o_orderpriority AS tenor, CAST(o_orderdate AS DATE) - 3 AS date FROM orders)
 SELECT request_id, tenor, CAST(date AS VARCHAR) AS date, CASE WHEN date - h <= 7 THEN CAST(h AS VARCHAR) END AS rate_date, CASE WHEN date - h <= 7 THEN r END AS rate FROM (SELECT q.*,
 (SELECT max(i.date) FROM interest i WHERE i.tenor = q.tenor AND i.date <= q.date) AS h, (SELECT arg_max(i.rate, i.date) FROM interest i WHERE i.tenor = q.tenor AND i.date <= q.date) AS r FROM req q)""")
def rate_asof(spark, d):
    req = S.load(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("tenor"), F.date_sub(F.to_date("o_orderdate"), 3).alias("date")
    )
    return day_text(R.rate_asof(req, S.interest(spark, d), ["tenor"]), "date", "rate_date")
