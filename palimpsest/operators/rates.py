"""Rate series: range reads, freshness, density, load summaries, as-of lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dates import age_days
from palimpsest.operators.core import asof_join, insert_if_absent

MOST = 10_000


def rates_range(df: DataFrame, dims: dict[str, str | None], start: str | None = None, end: str | None = None, limit: int = 30) -> DataFrame:
    """newest first; dimension values in any case, inclusive bounds, 1 to 10 000 rows."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be 1 to {MOST}")
    out = df
    for name, value in dims.items():
        if value:
            out = out.where(F.col(name) == value.upper())
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out.orderBy(F.desc("date"), *[F.asc(d) for d in dims]).limit(limit)


def rates_health(fx: DataFrame, interest: DataFrame, today: str, types: Sequence[str] = ("ROBOR", "EURIBOR"), detailed: str = "EURIBOR") -> DataFrame:
    """A2: row count, latest date and age for FX, each rate type and each tenor of one type; series
    without rows show zero and NULL."""
    stats = [F.count(F.lit(1)).alias("row_count"), F.max("date").alias("latest_date")]
    day = F.lit(today).cast("date")
    fx_part = fx.agg(*stats).select(F.lit("fx").alias("series"), F.lit("").alias("tenor"), "row_count", "latest_date")
    by_tenor = interest.groupBy("rate_type", "tenor").agg(*stats)
    total = by_tenor.groupBy("rate_type").agg(F.sum("row_count").alias("row_count"), F.max("latest_date").alias("latest_date"))
    listed = fx_part.select(F.explode(F.array(*[F.lit(t) for t in types])).alias("rate_type"))
    type_part = listed.join(total, "rate_type", "left").select(
        F.lower("rate_type").alias("series"), F.lit("").alias("tenor"), F.coalesce("row_count", F.lit(0)).alias("row_count"), "latest_date"
    )
    tenor_part = by_tenor.where(F.col("rate_type") == detailed).select(F.lower("rate_type").alias("series"), "tenor", "row_count", "latest_date")
    out = fx_part.unionByName(type_part).unionByName(tenor_part)
    return out.withColumn("age_days", age_days(F.col("latest_date"), day))


SPARSE_SHARE, SPARSE_MIN_DAYS = 0.4, 60


def density_check(rates: DataFrame, windows: DataFrame, tenors: Sequence[str], failed: DataFrame | None = None) -> DataFrame:
    """Per window (start, end) and tenor the number of points and whether the series looks
    thinned out: under 40 % of the business days of a window of at least 60 days. Tenors without any
    point count as zero; (start, tenor) in ``failed`` are left out.

    Windows are laid out by day, so rates meet them on the day they have: no range join.
    """
    slots = windows.withColumn("tenor", F.explode(F.array(*[F.lit(t) for t in tenors])))
    days = windows.select("start", F.explode(F.sequence("start", "end")).alias("date"))
    per_day = rates.groupBy("date", "tenor").agg(F.count(F.lit(1)).alias("_n"))
    counts = per_day.join(days, "date").groupBy("start", "tenor").agg(F.sum("_n").alias("_n"))
    out = slots.join(counts, ["start", "tenor"], "left")
    if failed is not None:
        out = out.join(failed.select("start", "tenor"), ["start", "tenor"], "left_anti")
    size = F.datediff("end", "start") + 1
    n = F.coalesce("_n", F.lit(0))
    sparse = (size >= SPARSE_MIN_DAYS) & (n < SPARSE_SHARE * size * 5 / 7)
    return out.select("start", "end", "tenor", n.alias("points"), sparse.alias("sparse"))


def load_rates(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """S11 on rates: rows to append; what is stored stays, whatever the new value says."""
    return insert_if_absent(target, incoming, keys)


def load_summary(incoming: DataFrame, inserted: DataFrame) -> DataFrame:
    """Per tenor rows fetched, rows inserted, first and last day."""
    got = incoming.groupBy("tenor").agg(F.count(F.lit(1)).alias("fetched"), F.min("date").alias("from_date"), F.max("date").alias("to_date"))
    new = inserted.groupBy("tenor").agg(F.count(F.lit(1)).alias("_n"))
    return got.join(new, "tenor", "left").select("tenor", "fetched", F.coalesce("_n", F.lit(0)).alias("inserted"), "from_date", "to_date")


def rate_asof(requests: DataFrame, rates: DataFrame, on: Sequence[str], max_days: int = 7) -> DataFrame:
    """The rate of the day asked for, else of the nearest earlier day at most ``max_days`` back;
    requests without one keep NULL."""
    hit = asof_join(requests, rates, on, "date", "date", ["date", "rate"], ["rate"], prefix="_hit_")
    near = F.datediff(F.col("date"), F.col("_hit_date")) <= max_days
    return hit.select(
        *requests.columns, F.when(near, F.col("_hit_date")).alias("rate_date"), F.when(near, F.col("_hit_rate")).alias("rate")
    )
