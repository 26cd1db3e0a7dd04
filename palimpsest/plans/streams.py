"""Driver queries of the incremental jobs: the tables' rows arrive as files, in several batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.plans import standins as S
from palimpsest.plans import versions as PV
from palimpsest.plans.logs import run_health
from palimpsest.plans.rates import day_text
from palimpsest.plans.registry import REGISTRY
from palimpsest.session import scratch_folder
from palimpsest.streaming import jobs as J

add = REGISTRY.add

FILES = 4


@add("stream_run_logs", REGISTRY.sql[run_health.__name__])
def stream_run_logs(spark, d):
    """Counts kept over batches of files; the same row as over all runs at once."""
    at = scratch_folder(spark)
    runs = S.runs(spark, d).withColumn("estimated_cost", F.col("total_duration_seconds") / 100)
    runs.select("run_id", "overall_status", "overall_confidence", "total_duration_seconds", "estimated_cost").repartition(FILES, "run_id").write.json(f"{at}/in")
    J.stream_run_logs(spark, f"{at}/in", f"{at}/out", f"{at}/check", FILES // 2).awaitTermination()
    return J.health_from_counts(J.run_log_counts(spark, f"{at}/out"))


@add("stream_rates", S.with_(S.INTEREST) + """SELECT CAST(date AS VARCHAR) AS date, rate_type, tenor, CAST(CAST(rate AS DECIMAL(18,4)) + CASE WHEN day(date) % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS rate FROM interest""")
def stream_rates(spark, d):
    """The odd days arrive first; files with all days, at other rates, only fill the gaps."""
    at = scratch_folder(spark)
    text = lambda rate: F.concat(F.replace(rate.cast("string"), F.lit("."), F.lit(",")), F.lit(" %"))
    rate = F.col("rate").cast("decimal(18,4)")
    rows = S.interest(spark, d)
    for late in (False, True):
        part = rows if late else rows.where(F.day("date") % 2 == 1)
        part = part.select(F.col("date").cast("string").alias("date"), "rate_type", "tenor", text(rate + 1 if late else rate).alias("rate"))
        part.repartition(FILES).write.mode("append").option("header", True).csv(f"{at}/in")
        J.stream_rates(spark, f"{at}/in", f"{at}/out", f"{at}/check", FILES // 2).awaitTermination()
    return day_text(spark.read.parquet(f"{at}/out").drop("batch"))


@add("stream_history", REGISTRY.sql[PV.merge_history.__name__])
def stream_history(spark, d):
    """The history of a law comes in several batches; the same table as from one merge."""
    at = scratch_folder(spark)
    PV.old_known(spark, d).select("law_id", "ver_id", "date_in_force", "is_current").write.parquet(f"{at}/known/start")
    PV.history(spark, d).repartition(FILES, "ver_id").write.json(f"{at}/in")
    J.stream_history(spark, f"{at}/in", f"{at}/known", S.versions(spark, d), S.laws(spark, d), f"{at}/notices", f"{at}/check", FILES // 2).awaitTermination()
    return J.known_history(spark, f"{at}/known").withColumn("date_in_force", PV.text_day("date_in_force"))
