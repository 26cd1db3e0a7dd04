"""Building blocks shared by all operators.

Every block is written for keys of any size: a key may hold a third of all rows. Picks of one row
per key are aggregates (combined before the shuffle), top-k is a ranked limit that Spark prunes
before the shuffle, and as-of lookups first reduce each key to one row per day.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = Sequence[str]


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where an input comes in fewer partitions than that (a small table in one
    file, whose single row group one task would read); larger inputs stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def best_row(df: DataFrame, keys: Cols, order: Sequence[Column | str], *, lowest: bool = False) -> DataFrame:
    """One row per key: the highest (or lowest) by ``order``; NULL sorts below every value."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    pick = (F.min_by if lowest else F.max_by)(F.struct(*rest), rank)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


def first_seen(df: DataFrame, keys: Cols, order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row per key in arrival order; NULL keys count as equal."""
    return best_row(df, keys, order, lowest=True).select(*df.columns)


def top_k(df: DataFrame, keys: Cols, order: Sequence[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank.

    With a plain number Spark limits each group before the shuffle (ranked group limit). A column
    ``k`` must come with a plain upper bound applied first, see ``top_k_by``.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    limit = F.lit(k) if isinstance(k, int) else k
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= limit)


def top_k_by(df: DataFrame, keys: Cols, order: Sequence[Column], k: Column, ceiling: int, rank: str = "rank") -> DataFrame:
    """Top-k where ``k`` differs per row but never passes ``ceiling`` (a rule, not a cap on results)."""
    return top_k(df, keys, order, ceiling, rank).where(F.col(rank) <= k)


def null_safe(left: DataFrame, right: DataFrame, keys: Cols) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def asof_join(
    requests: DataFrame,
    history: DataFrame,
    on: Cols,
    at: str,
    since: str,
    payload: Cols,
    tie: Cols,
    *,
    strict: bool = False,
    prefix: str = "",
) -> DataFrame:
    """Left as-of join: newest ``history`` row with ``since <= at`` (``<`` when ``strict``).

    History is reduced to one row per (key, day) and requests to distinct (key, day), so a key's
    timeline holds at most two rows per calendar day however many rows share the key. The timeline
    is walked once with a running last value: no pairs are formed. The answer then goes back to
    the requests by an equi join on (key, day), which adaptive execution can split when skewed.
    """
    names = [f"{prefix}{c}" for c in payload]
    carried = F.struct(*[F.col(c).alias(n) for c, n in zip(payload, names)])
    days = (
        history.where(F.col(since).isNotNull())
        .groupBy(*on, F.col(since).cast("date").alias("_day"))
        .agg(F.max_by(carried, F.struct(*tie)).alias("_hit"))
    )
    asks = requests.select(*on, F.col(at).cast("date").alias("_day")).where(F.col("_day").isNotNull()).distinct()
    first, second = (1, 0) if strict else (0, 1)
    line = days.withColumn("_kind", F.lit(first)).unionByName(
        asks.withColumn("_hit", F.lit(None).cast(days.schema["_hit"].dataType)).withColumn("_kind", F.lit(second))
    )
    w = Window.partitionBy(*on).orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    answers = (
        line.withColumn("_found", F.last("_hit", ignorenulls=True).over(w))
        .where(F.col("_kind") == second)
        .select(*on, "_day", "_found")
    )
    out = requests.withColumn("_day", F.col(at).cast("date")).join(answers, [*on, "_day"], "left")
    return out.select(*[out[c] for c in requests.columns], *[F.col(f"_found.{n}").alias(n) for n in names])


def number_rows(df: DataFrame, keys: Cols, order: Sequence[Column], block: Column, name: str = "rn") -> DataFrame:
    """Exact ``row_number`` per key without sending a whole key to one task.

    ``block`` must not decrease along ``order``. Rows are numbered inside (key, block); the counts
    of earlier blocks, one small row per block, are added on top.
    """
    marked = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    numbered = marked.withColumn("_i", F.row_number().over(inner))
    cond = null_safe(numbered, offsets, [*keys, "_block"])
    return numbered.join(offsets, cond, "left").select(
        *[numbered[c] for c in df.columns], (F.col("_before") + F.col("_i")).cast("long").alias(name)
    )


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: Cols, order: Sequence[Column | str] = ()) -> DataFrame:
    """Rows of ``incoming`` to append: the first per key whose key ``target`` does not hold yet.

    NULL keys never conflict, as with a unique index. Append the result; count it for the number
    of new rows. Where the table format has MERGE, use ``merge_if_absent``.
    """
    order = list(order) or [c for c in incoming.columns if c not in keys] or list(keys)
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    fresh = first_seen(incoming.where(keyed), keys, order).join(target.select(*keys), list(keys), "left_anti")
    return fresh.select(*incoming.columns).unionByName(incoming.where(~keyed))


def merge_if_absent(target_table: str, incoming: DataFrame, keys: Cols) -> None:
    """The same rule as one MERGE, for catalog tables whose format supports it."""
    first = first_seen(incoming, keys, [c for c in incoming.columns if c not in keys] or list(keys))
    cond = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys])
    first.alias("s").mergeInto(target_table, cond).whenNotMatched().insertAll().merge()
