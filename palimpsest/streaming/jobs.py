"""Incremental forms of the batch jobs: each new file is folded in by the same operators.

A target is a folder of parquet parts, one per micro-batch id, so a batch that is run again after a
failure overwrites its own part and adds nothing twice. Parts hold what their batch changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.core import best_row, insert_if_absent
from palimpsest.operators.versions import discovery_notices, merge_history
from palimpsest.sources.rates import seed_rows

SEED = "date string, rate_type string, tenor string, rate string"
HISTORY = "law_id long, pos long, ver_id long, date string"
KNOWN = "law_id long, ver_id long, date_in_force date, is_current boolean"
RUN_LOG = "run_id long, overall_status string, overall_confidence string, total_duration_seconds double, estimated_cost double, started_at timestamp"
FILES_PER_BATCH = 1000


def _parts_before(spark: SparkSession, target: str, schema, batch_id: int) -> DataFrame:
    """What earlier batches wrote."""
    seen = spark.read.schema(schema).option("basePath", target).parquet(target) if _exists(spark, target) else None
    if seen is None or "batch" not in seen.columns:
        return spark.createDataFrame([], schema)
    return seen.where(F.col("batch") < batch_id).drop("batch")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether anything fits the path, which may hold a ``*``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def stream_rates(spark: SparkSession, landing: str, target: str, checkpoint: str, per_batch: int = FILES_PER_BATCH) -> StreamingQuery:
    """New seed files only add (date, rate_type, tenor) the target does not hold; a late file
    fills gaps and changes nothing."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        rows = seed_rows(batch)
        held = _parts_before(batch.sparkSession, target, rows.schema, batch_id)
        fresh = insert_if_absent(held, rows, ["date", "rate_type", "tenor"])
        fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    source = spark.readStream.schema(SEED).option("header", True).option("maxFilesPerTrigger", per_batch).csv(landing)
    return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_history(
    spark: SparkSession, landing: str, known: str, versions: DataFrame, laws: DataFrame, notices: str, checkpoint: str, per_batch: int = FILES_PER_BATCH
) -> StreamingQuery:
    """New history files are merged into the known versions. A batch writes the laws it read, whole, as
    its own part of ``known``, and a notice per law with new versions. ``known/start`` may hold the
    versions known before the first batch. Read the table by ``known_history``."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        read = batch.where("ver_id IS NOT NULL").select("law_id").distinct()
        before = known_history(batch.sparkSession, known, batch_id, read)
        merged, counts = merge_history(before, versions, batch)
        merged.write.mode("overwrite").parquet(f"{known}/batch={batch_id}")
        discovery_notices(counts, laws).write.mode("overwrite").parquet(f"{notices}/batch={batch_id}")

    source = spark.readStream.schema(HISTORY).option("maxFilesPerTrigger", per_batch).json(landing)
    return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known_history(spark: SparkSession, known: str, before: int | None = None, laws: DataFrame | None = None) -> DataFrame:
    """The known versions after all batches, or after those earlier than ``before``, of ``laws`` (law_id)
    only where given: each law as the latest part that holds it has it."""
    parts = []
    if _exists(spark, f"{known}/start"):
        parts.append(spark.read.schema(KNOWN).parquet(f"{known}/start").withColumn("batch", F.lit(-1).cast("long")))
    if _exists(spark, f"{known}/batch=*"):
        parts.append(spark.read.schema(f"{KNOWN}, batch long").option("basePath", known).parquet(f"{known}/batch=*"))
    if not parts:
        return spark.createDataFrame([], KNOWN)
    rows = reduce(DataFrame.unionByName, parts)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    rows = rows if laws is None else rows.join(laws, "law_id", "left_semi")
    latest = rows.groupBy("law_id").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["law_id", "batch"]).drop("batch")


def stream_run_logs(spark: SparkSession, landing: str, target: str, checkpoint: str, per_batch: int = FILES_PER_BATCH) -> StreamingQuery:
    """Running counts by status. A batch writes the statuses it changed as its own part of
    ``target``; a batch run again overwrites it with the same rows. Read them by ``run_log_counts``."""
    runs = spark.readStream.schema(RUN_LOG).option("maxFilesPerTrigger", per_batch).json(landing).where("overall_status <> 'running'")
    given = lambda c: F.when(F.col(c) != 0, F.col(c))
    counts = runs.groupBy("overall_status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("overall_confidence") == "HIGH").alias("high"),
        F.count(given("total_duration_seconds")).alias("timed"),
        F.sum(given("total_duration_seconds")).alias("seconds"),
        F.count(given("estimated_cost")).alias("priced"),
        F.sum(given("estimated_cost")).alias("cost"),
    )

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(keep)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_log_counts(spark: SparkSession, target: str) -> DataFrame:
    """The latest counts of each status."""
    return best_row(spark.read.option("basePath", target).parquet(target), ["overall_status"], ["batch"]).drop("batch")


def health_from_counts(counts: DataFrame) -> DataFrame:
    """A3 from the running counts: the same row as ``run_health`` over all runs."""
    n, status = F.sum("runs"), F.col("overall_status")
    of = lambda s: F.coalesce(F.sum(F.when(status == s, F.col("runs"))), F.lit(0))
    share = lambda c: F.coalesce(F.round(c / n * 100, 1), F.lit(0.0))
    mean = lambda total, k, digits: F.coalesce(F.round(F.try_divide(F.sum(total), F.sum(k)), digits), F.lit(0.0))
    return counts.agg(
        F.coalesce(n, F.lit(0)).alias("total_runs"),
        *[of(s).alias(f"{s}_count") for s in ("ok", "warning", "error", "partial")],
        *[share(of(s)).alias(f"{s}_pct") for s in ("ok", "warning", "error")],
        share(F.sum("high")).alias("high_pct"),
        mean("seconds", "timed", 1).alias("avg_duration"),
        mean("cost", "priced", 4).alias("avg_cost"),
    )
