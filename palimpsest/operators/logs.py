"""Runs, steps, calls, sessions, jobs and notices: listings and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import strip_space
from palimpsest.operators.core import best_row, top_k

ACTIVE = ("pending", "running")
# Rows of a page at most; asking for more is an error.
PAGE = 200


def list_runs(df: DataFrame, limit: int = 50, offset: int = 0, **equal: str | None) -> DataFrame:
    """newest runs first, filters by equality where given, one page of 200 rows at most."""
    if not 0 <= limit <= PAGE or offset < 0:
        raise ValueError(f"a page has 0 to {PAGE} rows and a non-negative offset")
    out = df
    for name, value in equal.items():
        if value:
            out = out.where(F.col(name) == value)
    return out.orderBy(F.desc("started_at"), F.desc("run_id")).offset(offset).limit(limit)


def notifications(df: DataFrame, unread_only: bool = False, limit: int = 50) -> DataFrame:
    """newest notices first."""
    out = df.where("NOT is_read") if unread_only else df
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def unread_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(~F.col("is_read")).alias("unread"))


def _jobs(df: DataFrame, kind: str | None, entity_kind: str | None, entity_id: str | None) -> DataFrame:
    for name, value in (("kind", kind), ("entity_kind", entity_kind), ("entity_id", entity_id)):
        if value is not None:
            df = df.where(F.col(name) == str(value))
    return df


def list_jobs(df: DataFrame, kind=None, entity_kind=None, entity_id=None, active: bool | None = None, limit: int = 50) -> DataFrame:
    """newest jobs first; active means pending or running."""
    out = _jobs(df, kind, entity_kind, entity_id)
    if active is not None:
        is_active = F.col("status").isin(*ACTIVE)
        out = out.where(is_active if active else ~is_active)
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def has_active(df: DataFrame, kind=None, entity_kind=None, entity_id=None) -> DataFrame:
    """one row telling whether such a job is active."""
    return _jobs(df, kind, entity_kind, entity_id).where(F.col("status").isin(*ACTIVE)).limit(1).agg((F.count(F.lit(1)) > 0).alias("active"))


def check_feed(logs: DataFrame, laws: DataFrame, users: DataFrame, limit: int = 20, most: int = PAGE) -> DataFrame:
    """Newest checks with the law they were about and who asked; a ``limit`` outside 1 to ``most``
    is taken as the nearer of both, as the feed's rule has it.

    The page is cut before the lookups: laws are checked for existence first, names come after.
    """
    page = logs.join(laws.select("law_id"), "law_id", "left_semi").orderBy(F.desc("checked_at"), F.desc("id")).limit(max(1, min(limit, most)))
    label = F.concat("title", F.lit(" ("), "law_number", F.lit("/"), F.col("law_year").cast("string"), F.lit(")"))
    return (
        page.join(laws.select("law_id", label.alias("law_label")), "law_id")
        .join(users.select("user_id", "email"), "user_id", "left")
        .select("id", "law_id", "law_label", "checked_at", F.col("email").alias("user_email"), "new_versions", "status")
        .orderBy(F.desc("checked_at"), F.desc("id"))
    )


def run_health(runs: DataFrame) -> DataFrame:
    """A3: counts and shares by status, share of HIGH, mean duration and cost over non-zero values;
    running ones are left out, statuses without a column count in the total only."""
    status, n = F.col("overall_status"), F.count(F.lit(1))
    share = lambda c: F.coalesce(F.round(F.count_if(c) / n * 100, 1), F.lit(0.0))
    mean = lambda c, d: F.coalesce(F.round(F.avg(F.when(F.col(c) != 0, F.col(c))), d), F.lit(0.0))
    return runs.where("overall_status <> 'running'").agg(
        n.alias("total_runs"),
        *[F.count_if(status == s).alias(f"{s}_count") for s in ("ok", "warning", "error", "partial")],
        *[share(status == s).alias(f"{s}_pct") for s in ("ok", "warning", "error")],
        share(F.col("overall_confidence") == "HIGH").alias("high_pct"),
        mean("total_duration_seconds", 1).alias("avg_duration"),
        mean("estimated_cost", 4).alias("avg_cost"),
    )


def common_flags(runs: DataFrame, n: int = 5) -> DataFrame:
    """A3: the most frequent flags; unreadable flag lists are skipped."""
    flags = F.explode(F.from_json("flags", "array<string>")).alias("flag")
    counted = runs.where("overall_status <> 'running'").select(flags).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), F.asc("flag")).limit(n)


IN_PRICE, OUT_PRICE = 3.0 / 1_000_000, 15.0 / 1_000_000


def run_costs(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """A4: tokens and relative cost per run, duration from start to end."""
    sums = calls.groupBy("run_id").agg(F.sum("tokens_in").alias("_i"), F.sum("tokens_out").alias("_o"))
    out = runs.join(sums, "run_id", "left")
    i, o = F.coalesce("_i", F.lit(0)), F.coalesce("_o", F.lit(0))
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return out.select(
        "run_id", i.alias("tokens_in"), o.alias("tokens_out"), F.round(i * IN_PRICE + o * OUT_PRICE, 6).alias("estimated_cost"),
        F.round(seconds, 3).alias("total_duration_seconds"),
    )


def model_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """A5: cost of each call by the model's price (per page, or per million tokens in and out);
    models without a price are flagged."""
    p = prices.select("model", "per_page", "price_in", "price_out", F.lit(True).alias("_p"))
    out = calls.join(p, "model", "left")
    cost = F.when(F.col("per_page").isNotNull(), F.col("per_page") * F.col("tokens_in")).otherwise(
        F.col("tokens_in") / 1_000_000 * F.col("price_in") + F.col("tokens_out") / 1_000_000 * F.col("price_out")
    )
    return out.select(*[out[c] for c in calls.columns], F.round(cost, 9).alias("cost"), F.col("_p").isNull().alias("unknown_model"))


def unknown_models(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """A5: models used without a price, with their number of calls."""
    return calls.join(prices.select("model"), "model", "left_anti").groupBy("model").agg(F.count(F.lit(1)).alias("calls"))


def session_summary(messages: DataFrame, at: str = "turn") -> DataFrame:
    """Message count, last activity and title (first user message, 100 characters)."""
    mine = F.when(F.col("role") == "user", F.col(at))
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.max(at).alias("last_active"),
        F.min_by(strip_space(F.substring("content", 1, 100)), mine).alias("title"),
    )


def conversation_context(messages: DataFrame, n: int = 20, at: str = "turn") -> DataFrame:
    """The last ``n`` messages of each session with their place, oldest first."""
    last = top_k(messages, ["session_id"], [F.desc(at)], n, "_r")
    # at most n rows per session are left
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("_r"))).cast("long")
    return last.select("session_id", place.alias("place"), "role", "content")


def dedupe_steps(steps: DataFrame, known_numbers: Sequence[int]) -> DataFrame:
    """One step per (run, name): a known number beats an unknown one, then a duration, then the
    first one logged."""
    known = F.col("step_number").isin(*known_numbers)
    timed = F.coalesce(F.col("duration_seconds") != 0, F.lit(False))
    return best_row(steps, ["run_id", "step_name"], [known, timed, -F.col("id")])
