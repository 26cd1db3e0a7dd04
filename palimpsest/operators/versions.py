"""Versions of laws: which holds on a date, which are missing, stale, new, or to be imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import dates as D
from palimpsest.functions.text import strip_space
from palimpsest.operators.core import asof_join, best_row, first_seen, number_rows


def _day(value: str | Column) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


def lookup_laws(refs: DataFrame, laws: DataFrame) -> DataFrame:
    """Find each (law_number, law_year) in the library; the given title wins over the stored."""
    one = best_row(laws.select("law_number", "law_year", "law_id", F.col("title").alias("_title")), ["law_number", "law_year"], ["law_id"], lowest=True)
    out = refs.join(one, ["law_number", "law_year"], "left")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("_title")) if "title" in refs.columns else F.col("_title")
    return out.withColumn("title", title).withColumn("in_library", F.col("law_id").isNotNull()).drop("_title")


def _any_version(versions: DataFrame) -> DataFrame:
    """An arbitrary version per law, made definite: earliest date, then lowest id."""
    order = [F.col("date_in_force").isNull(), "date_in_force", "version_id"]
    return best_row(versions.select("law_id", "version_id", "date_in_force"), ["law_id"], order, lowest=True).select(
        "law_id", F.col("date_in_force").alias("_any_date"), F.lit(True).alias("_any")
    )


def version_availability(refs: DataFrame, versions: DataFrame) -> DataFrame:
    """Refs (…, law_id NULL when not in the library, relevant_date NULL when none) get
    ``availability`` and ``available_version_date``."""
    dated = asof_join(
        refs, versions, ["law_id"], "relevant_date", "date_in_force", ["date_in_force", "version_id"], ["version_id"], prefix="_hit_"
    )
    out = dated.join(_any_version(versions), "law_id", "left")
    some = F.coalesce(F.col("_any"), F.lit(False))
    asked = F.col("relevant_date").isNotNull()
    hit = F.col("_hit_version_id").isNotNull()
    status = (
        F.when(~some, "missing").when(~asked | hit, "available").otherwise("wrong_version")
    )
    day = F.when(asked & hit, F.col("_hit_date_in_force")).otherwise(F.col("_any_date"))
    return out.select(*[out[c] for c in refs.columns], status.alias("availability"), day.alias("available_version_date"))


def version_status(refs: DataFrame, known: DataFrame, versions: DataFrame) -> DataFrame:
    """up_to_date, stale or not_checked against the version known to be current."""
    current = best_row(
        known.where("is_current").select("law_id", F.col("ver_id").alias("official_current_ver_id"), F.col("date_in_force").alias("official_current_date")),
        ["law_id"], ["official_current_date", "official_current_ver_id"],
    )
    stored = versions.select("law_id", F.col("ver_id").alias("official_current_ver_id"), F.lit(True).alias("_stored")).distinct()
    state = current.join(stored, ["law_id", "official_current_ver_id"], "left")
    out = refs.join(state, "law_id", "left")
    status = (
        F.when(F.col("official_current_ver_id").isNull(), "not_checked").when(F.col("_stored"), "up_to_date").otherwise("stale")
    )
    stale = status == "stale"
    return out.select(
        *[out[c] for c in refs.columns],
        status.alias("version_status"),
        F.when(stale, F.col("official_current_ver_id")).alias("official_current_ver_id"),
        F.when(stale, F.col("official_current_date")).alias("official_current_date"),
    )


def select_versions(issues: DataFrame, versions: DataFrame, today: str) -> DataFrame:
    """The version each (question, issue, law) is judged by.

    Newest version in force on the issue's date, no later than today; where none was yet in force,
    the current version, else the newest. Laws without versions drop out.
    """
    given = F.coalesce(F.col("relevant_date"), F.lit(today))
    asked = F.when(given == "unknown", F.lit(today)).otherwise(given)
    future = asked > today
    dated = issues.withColumn("_future", future).withColumn("effective_date", _day(F.when(future, F.lit(today)).otherwise(asked).cast("date")))
    cols = ["version_id", "date_in_force", "is_current", "ver_id"]
    hit = asof_join(dated, versions, ["law_id"], "effective_date", "date_in_force", cols, ["version_id"], prefix="_a_")
    back = best_row(versions.select("law_id", *cols), ["law_id"], ["is_current", "date_in_force", "version_id"])
    back = back.select("law_id", *[F.col(c).alias(f"_f_{c}") for c in cols])
    out = hit.join(back, "law_id")
    found = F.col("_a_version_id").isNotNull()
    picked = [F.when(found, F.col(f"_a_{c}")).otherwise(F.col(f"_f_{c}")).alias(c) for c in cols]
    return out.select(
        *[out[c] for c in issues.columns], "effective_date", *picked, (~found).alias("is_fallback"), F.col("_future").alias("is_future")
    )


def latest_selected(selected: DataFrame) -> DataFrame:
    """The newest selected version per law over all issues of a question."""
    rest = selected.select("question_id", "law_id", "version_id", "date_in_force", "is_current", "ver_id")
    return best_row(rest, ["question_id", "law_id"], ["date_in_force", "version_id"])


def selected_set(selected: DataFrame) -> DataFrame:
    """The distinct versions of each law a question needs, one per row."""
    return selected.select("question_id", "law_id", "version_id").distinct()


def version_notes(selected: DataFrame) -> DataFrame:
    """One note per row: date in the future, no version for the date, historical version used."""
    future = selected.where("is_future").select(
        "question_id",
        F.concat("issue_id", F.lit(": Event date "), "relevant_date", F.lit(" is in the future — using current law")).alias("note"),
    )
    fallback = selected.where("is_fallback").select(
        "question_id",
        F.concat("issue_id", F.lit(":"), F.col("law_id").cast("string"), F.lit(": No version for "), F.col("effective_date").cast("string"), F.lit(", using current")).alias("note"),
    )
    old = latest_selected(selected).where("date_in_force IS NOT NULL AND NOT is_current").select(
        "question_id",
        F.concat(F.col("law_id").cast("string"), F.lit(": Using version from "), F.col("date_in_force").cast("string"), F.lit(" (not the current version)")).alias("note"),
    )
    return future.distinct().unionByName(fallback).unionByName(old)


def law_date_map(issues: DataFrame) -> DataFrame:
    """Latest known date per (question, law); unknown and blank dates do not count."""
    known = issues.where("relevant_date IS NOT NULL AND relevant_date NOT IN ('', 'unknown')")
    return known.groupBy("question_id", "law_id").agg(F.max("relevant_date").alias("relevant_date"))


def primary_date(issues: DataFrame, today: str) -> DataFrame:
    """Latest of those dates per question, else today."""
    latest = law_date_map(issues).groupBy("question_id").agg(F.max("relevant_date").alias("_d"))
    return issues.select("question_id").distinct().join(latest, "question_id", "left").select(
        "question_id", F.coalesce("_d", F.lit(today)).alias("primary_date")
    )


def law_status(laws: DataFrame, versions: DataFrame) -> DataFrame:
    """in_force, repealed or unknown from the current version's state; an override wins."""
    current = best_row(versions.where("is_current").select("law_id", "version_id", "state"), ["law_id"], ["version_id"], lowest=True)
    out = laws.join(current.select("law_id", "state"), "law_id", "left")
    found = F.when(F.col("state") == "deprecated", "repealed").when(F.col("state") == "actual", "in_force").otherwise("unknown")
    if "status_override" in laws.columns:
        found = F.coalesce("status_override", found)
    return out.withColumn("status", found).drop("state")


def unimported_versions(known: DataFrame, versions: DataFrame) -> DataFrame:
    """Known versions the library does not hold."""
    return known.join(versions.select("law_id", "ver_id").distinct(), ["law_id", "ver_id"], "left_anti")


def unimported_counts(laws: DataFrame, known: DataFrame, versions: DataFrame) -> DataFrame:
    """Count per law, zero where nothing is missing."""
    n = unimported_versions(known, versions).groupBy("law_id").agg(F.count(F.lit(1)).alias("_n"))
    return laws.select("law_id").join(n, "law_id", "left").select("law_id", F.coalesce("_n", F.lit(0)).alias("unimported_count"))


def flag_known(known: DataFrame, versions: DataFrame) -> DataFrame:
    """Known versions with an ``is_imported`` flag."""
    stored = versions.select("law_id", "ver_id", F.lit(True).alias("_s")).distinct()
    return known.join(stored, ["law_id", "ver_id"], "left").withColumn("is_imported", F.coalesce("_s", F.lit(False))).drop("_s")


def newer_versions(known: DataFrame, versions: DataFrame, laws: DataFrame) -> DataFrame:
    """Known versions younger than everything imported of their law and imported nowhere,
    numbered in the law's whole history; ``is_latest`` marks the newest date."""
    newest = versions.groupBy("law_id").agg(F.max("date_in_force").alias("_max"))
    newer = (
        known.join(newest, "law_id")
        .where(F.col("date_in_force") > F.col("_max"))
        .join(versions.select("ver_id").distinct(), "ver_id", "left_anti")
        .join(laws.select("law_id").distinct(), "law_id", "left_semi")
        .select("law_id", "ver_id", "date_in_force")
    )
    totals = known.groupBy("law_id").agg(F.count(F.lit(1)).alias("_total"))
    span = newer.groupBy("law_id").agg(F.count(F.lit(1)).alias("_new"), F.max("date_in_force").alias("_latest"))
    numbered = number_rows(newer, ["law_id"], [F.asc("date_in_force"), F.asc("ver_id")], F.col("date_in_force"), "_i")
    out = numbered.join(span.join(totals, "law_id"), "law_id")
    offset = F.col("_total") - F.col("_new")
    return out.select(
        "law_id", "ver_id", "date_in_force",
        (F.col("date_in_force") == F.col("_latest")).alias("is_latest"),
        offset.alias("version_number_offset"),
        (offset + F.col("_i")).alias("version_number"),
    )


def reconcile_current(versions: DataFrame, known: DataFrame) -> DataFrame:
    """An imported version is current only if it is the one known to be; missing or sentinel
    dates are filled from the known ones. Laws the known table does not hold lose their mark."""
    cur = best_row(known.where("is_current").select("law_id", F.col("ver_id").alias("_cur"), "date_in_force"), ["law_id"], ["date_in_force", "_cur"])
    dates = known.groupBy("law_id", "ver_id").agg(F.max("date_in_force").alias("_date"))
    out = versions.join(dates, ["law_id", "ver_id"], "left").join(cur.select("law_id", "_cur"), "law_id", "left")
    empty = F.col("date_in_force").isNull() | (F.col("date_in_force") == D.sentinel())
    usable = F.col("_date").isNotNull() & (F.col("_date") != D.sentinel())
    fixed = {
        "date_in_force": F.when(empty & usable, F.col("_date")).otherwise(F.col("date_in_force")),
        "is_current": F.coalesce(F.col("ver_id") == F.col("_cur"), F.lit(False)),
    }
    return out.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in versions.columns])


def mark_current(versions: DataFrame, with_content: bool = False, only_dated: bool = False) -> DataFrame:
    """The newest version of each law is current (highest id on ties).

    ``with_content`` prefers versions whose ``has_content`` holds; ``only_dated`` marks none where a
    law has no dated version.
    """
    order = (["has_content"] if with_content else []) + ["date_in_force", "version_id"]
    pool = versions.where("date_in_force IS NOT NULL") if only_dated else versions
    keep = ["law_id", "version_id", "date_in_force"] + (["has_content"] if with_content else [])
    best = best_row(pool.select(*keep), ["law_id"], order).select("law_id", F.col("version_id").alias("_best"))
    cols = [c for c in versions.columns if c != "is_current"]
    return versions.select(*cols).join(best, "law_id", "left").select(
        *cols, F.coalesce(F.col("version_id") == F.col("_best"), F.lit(False)).alias("is_current")
    )


def with_predecessor(versions: DataFrame) -> DataFrame:
    """``prev_version_id`` and ``prev_date``: the newest version of a strictly earlier day.

    Each law is first reduced to one row per day, so the walk over a law's days stays short.
    """
    days = (
        versions.where("date_in_force IS NOT NULL")
        .groupBy("law_id", "date_in_force")
        .agg(F.max("version_id").alias("_top"))
    )
    w = Window.partitionBy("law_id").orderBy("date_in_force")
    prev = days.select(
        "law_id", "date_in_force", F.lag("_top").over(w).alias("prev_version_id"), F.lag("date_in_force").over(w).alias("prev_date")
    )
    return versions.join(prev, ["law_id", "date_in_force"], "left").select(*versions.columns, "prev_version_id", "prev_date")


def diff_summary(versions: DataFrame, articles: DataFrame) -> DataFrame:
    """Modified, added and removed article numbers of each version against the one before.

    Of a repeated number the last article counts. Texts are compared by digest, so only its 64 digits per
    article travel; an article goes to the versions that it is compared for, its own and the next, and both
    sides meet in one grouping. Versions in no pair end at the join.
    """
    pairs = with_predecessor(versions).where("prev_version_id IS NOT NULL").select("version_id", "prev_version_id").distinct()
    sides = pairs.select(F.col("version_id").alias("_of"), "version_id", F.lit(True).alias("_new")).unionByName(
        pairs.select(F.col("prev_version_id").alias("_of"), "version_id", F.lit(False).alias("_new"))
    )
    digest = F.sha2(strip_space(F.coalesce(F.col("full_text"), F.lit(""))), 256)
    texts = articles.select(F.col("version_id").alias("_of"), "article_number", digest.alias("_d"), F.struct("order_index", "article_id").alias("_at"))
    last = lambda side: F.max_by(F.when(side, F.col("_d")), F.when(side, F.col("_at")))
    both = texts.join(sides, "_of").groupBy("version_id", "article_number").agg(last(F.col("_new")).alias("n"), last(~F.col("_new")).alias("o"))
    counts = both.groupBy("version_id").agg(
        F.count_if(F.col("n").isNotNull() & F.col("o").isNotNull() & (F.col("n") != F.col("o"))).alias("modified"),
        F.count_if(F.col("o").isNull()).alias("added"),
        F.count_if(F.col("n").isNull()).alias("removed"),
    )
    zero = {"modified": 0, "added": 0, "removed": 0}
    return pairs.join(counts, "version_id", "left").na.fill(zero)


def merge_history(known: DataFrame, versions: DataFrame, history: DataFrame, probes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fold freshly read history (law_id, pos, ver_id, date text) into the known versions.

    Unknown ids are added with their first date; a stored sentinel date is healed by the first real
    one; then the newest version of every law read becomes current. ``probes`` (law_id, ver_id,
    date) are added where the history lacks them. Returns (known, new_counts); ids already imported
    do not count as new.
    """
    read = history.where("ver_id IS NOT NULL AND ver_id <> ''" if dict(history.dtypes)["ver_id"] == "string" else "ver_id IS NOT NULL")
    read = read.select("law_id", "ver_id", "pos", D.history_day(F.col("date")).alias("day"))
    if probes is not None:
        extra = probes.join(read.select("law_id", "ver_id").distinct(), ["law_id", "ver_id"], "left_anti")
        extra = extra.join(read.select("law_id").distinct(), "law_id", "left_semi")
        read = read.unionByName(extra.select("law_id", "ver_id", F.lit(2**31 - 1).cast(read.schema["pos"].dataType).alias("pos"), F.coalesce("date", D.sentinel()).alias("day")))
    real = F.col("day") != D.sentinel()
    seen = read.groupBy("law_id", "ver_id").agg(
        F.min_by("day", "pos").alias("_first"), F.min_by(F.when(real, F.col("day")), F.when(real, F.col("pos"))).alias("_real")
    )
    old = known.select("law_id", "ver_id", F.col("date_in_force").alias("_old"), F.col("is_current").alias("_was"), F.lit(True).alias("_known"))
    both = old.join(seen, ["law_id", "ver_id"], "full_outer")
    healed = F.when(F.col("_known") & (F.col("_old") == D.sentinel()) & F.col("_real").isNotNull(), F.col("_real"))
    merged = both.select(
        "law_id", "ver_id", F.when(F.col("_known"), F.coalesce(healed, F.col("_old"))).otherwise(F.col("_first")).alias("date_in_force"),
        "_was", "_known",
    )
    newest = merged.groupBy("law_id").agg(
        F.max_by("ver_id", F.struct(F.coalesce("date_in_force", D.sentinel()), "ver_id")).alias("_cur")
    )
    touched = read.select("law_id", F.lit(True).alias("_read")).distinct()
    out = merged.join(newest, "law_id").join(touched, "law_id", "left").select(
        "law_id", "ver_id", "date_in_force",
        F.when(F.col("_read"), F.col("ver_id") == F.col("_cur")).otherwise(F.coalesce("_was", F.lit(False))).alias("is_current"),
    )
    fresh = seen.join(known.select("law_id", "ver_id"), ["law_id", "ver_id"], "left_anti").join(
        versions.select("law_id", "ver_id").distinct(), ["law_id", "ver_id"], "left_anti"
    )
    n = fresh.groupBy("law_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = touched.select("law_id").join(n, "law_id", "left").select("law_id", F.coalesce("_n", F.lit(0)).alias("new_count"))
    return out, counts


def pick_probe(laws: DataFrame, versions: DataFrame, known: DataFrame) -> DataFrame:
    """The version to ask the source about: current, newest dated, any, newest known, none."""
    level = F.when(F.col("is_current"), 4).when(F.col("date_in_force").isNotNull(), 3).otherwise(2)
    own = versions.select("law_id", "ver_id", level.alias("_p"), F.when(level != 2, F.col("date_in_force")).alias("_d"))
    other = known.select("law_id", "ver_id", F.lit(1).alias("_p"), F.col("date_in_force").alias("_d"))
    best = best_row(own.unionByName(other), ["law_id"], ["_p", "_d", "ver_id"])
    return laws.select("law_id").join(best.select("law_id", F.col("ver_id").alias("probe_ver_id"), F.col("_p").alias("probe_level")), "law_id", "left")


def seed_known(versions: DataFrame, known: DataFrame) -> DataFrame:
    """Known-version rows to add for imported versions no law knows by id."""
    one = best_row(versions.select("ver_id", "law_id", "date_in_force", "is_current", "version_id"), ["ver_id"], ["version_id"], lowest=True)
    return one.join(known.select("ver_id").distinct(), "ver_id", "left_anti").select(
        "law_id", "ver_id", F.coalesce("date_in_force", D.sentinel()).alias("date_in_force"), "is_current"
    )


FRESH_HOURS = 24


def currency_precheck(candidates: DataFrame, today: str, now: Column) -> DataFrame:
    """which candidates need the remote check. A question about the past needs none; only laws
    available in the library are checked; one imported within a day counts as current."""
    past = (F.col("date_type") == "explicit") & (F.col("primary_date") < F.lit(today))
    usable = (F.col("availability") == "available") & F.col("law_id").isNotNull()
    young = F.col("date_imported") > now - F.expr(f"INTERVAL {FRESH_HOURS} HOURS")
    status = (
        F.when(F.coalesce(past, F.lit(False)), "not_checked")
        .when(~F.coalesce(usable, F.lit(False)), "not_checked")
        .when(F.col("current_ver_id").isNull(), "no_current_version")
        .when(F.coalesce(young, F.lit(False)), "current")
        .otherwise("to_check")
    )
    return candidates.withColumn("currency_status", status)


def currency_status(candidates: DataFrame, pages: DataFrame, history: DataFrame, versions: DataFrame) -> DataFrame:
    """Verdict from fetched pages.

    candidates (law_id, ver_id current), pages (ver_id, next_ver), history (ver_id page, pos,
    hist_ver_id, hist_date). Stale when the page's successor is not stored, else when a listed
    version is not, else when the newest entry's own page lists one that is not.
    """
    stored = versions.select("law_id", F.col("ver_id").alias("_v")).distinct()
    asked = candidates.select("law_id", "ver_id").join(pages.select("ver_id", "next_ver"), "ver_id", "left")
    fetched = pages.select("ver_id", F.lit(True).alias("_ok")).distinct()

    def unseen(rows: DataFrame, level: int) -> DataFrame:
        """First listed version per law that is neither stored nor the current one."""
        open_ = rows.where(F.col("hist_ver_id").isNotNull() & (F.col("hist_ver_id") != F.col("ver_id")))
        open_ = open_.withColumn("_v", F.col("hist_ver_id")).join(stored, ["law_id", "_v"], "left_anti")
        first = best_row(open_.select("law_id", "pos", "hist_ver_id", "hist_date"), ["law_id"], ["pos"], lowest=True)
        return first.select("law_id", F.lit(level).alias("_l"), F.col("hist_ver_id").alias("official_latest_ver_id"), F.col("hist_date").alias("official_latest_date"))

    nxt = asked.where("next_ver IS NOT NULL").withColumn("_v", F.col("next_ver")).join(stored, ["law_id", "_v"], "left_anti").select(
        "law_id", F.lit(0).alias("_l"), F.col("next_ver").alias("official_latest_ver_id"), F.lit(None).cast("string").alias("official_latest_date")
    )
    listed = asked.select("law_id", "ver_id").join(history, "ver_id")
    head = listed.where((F.col("pos") == 0) & (F.col("hist_ver_id") != F.col("ver_id"))).select("law_id", "ver_id", F.col("hist_ver_id").alias("_page"))
    cross = head.join(history.withColumnRenamed("ver_id", "_page"), "_page").select("law_id", "ver_id", "pos", "hist_ver_id", "hist_date")
    found = best_row(nxt.unionByName(unseen(listed, 1)).unionByName(unseen(cross, 2)), ["law_id"], ["_l"], lowest=True)
    out = candidates.join(fetched, "ver_id", "left").join(found.drop("_l"), "law_id", "left")
    status = (
        F.when(F.col("ver_id").isNull(), "no_current_version")
        .when(F.col("_ok").isNull(), "source_unavailable")
        .when(F.col("official_latest_ver_id").isNotNull(), "stale")
        .otherwise("current")
    )
    return out.withColumn("currency_status", status).drop("_ok")


def cross_history(history: DataFrame, newer: DataFrame) -> DataFrame:
    """A page's history plus the entries only the newer page lists (law_id, pos, ver_id, date)."""
    extra = newer.join(history.select("law_id", "ver_id").distinct(), ["law_id", "ver_id"], "left_anti")
    return history.unionByName(first_seen(extra, ["law_id", "ver_id"], ["pos"]).select(*history.columns))


def versions_to_import(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Per request (law_id, base_ver_id, primary_date or NULL) the newest dated version and the
    one in force on the date (else the oldest); without any dated version the base id.

    One row per version of the law with ``picked``.
    """
    dated = history.where("day IS NOT NULL")
    ends = dated.groupBy("law_id").agg(
        F.max_by("ver_id", F.struct("day", "ver_id")).alias("_newest"), F.min_by("ver_id", F.struct("day", "ver_id")).alias("_oldest")
    )
    asked = asof_join(requests, dated, ["law_id"], "primary_date", "day", ["ver_id"], ["ver_id"], prefix="_hit_").join(ends, "law_id", "left")
    needed = F.when(F.col("primary_date").isNotNull(), F.coalesce("_hit_ver_id", "_oldest"))
    wanted = asked.select("law_id", F.explode(F.array_distinct(F.array(F.coalesce("_newest", "base_ver_id"), F.coalesce(needed, "_newest", "base_ver_id")))).alias("ver_id"))
    wanted = wanted.distinct().withColumn("_p", F.lit(True))
    listed = history.join(requests.select("law_id").distinct(), "law_id", "left_semi").select("law_id", "ver_id").unionByName(
        requests.select("law_id", F.col("base_ver_id").alias("ver_id"))
    )
    return listed.distinct().join(wanted, ["law_id", "ver_id"], "left").select("law_id", "ver_id", F.coalesce("_p", F.lit(False)).alias("picked"))


def current_to_import(history: DataFrame) -> DataFrame:
    """J29, current only: the newest dated entry of each history, else its first entry."""
    dated = F.col("day").isNotNull()
    return best_row(history.select("law_id", "pos", "ver_id", "day"), ["law_id"], [dated, "day", -F.col("pos")]).select("law_id", "ver_id")


def import_worklist(known: DataFrame, versions: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Versions to import, oldest first (``import_order`` per law).

    With ``requested`` (law_id, ver_id) each row gets an outcome: unknown ids are rejected, stored
    ones count as done, the others are to be imported.
    """
    open_ = unimported_versions(known, versions).select("law_id", "ver_id", "date_in_force")
    if requested is None:
        return number_rows(open_, ["law_id"], [F.asc("date_in_force"), F.asc("ver_id")], F.col("date_in_force"), "import_order")
    k = known.select("law_id", "ver_id", F.lit(True).alias("_k")).distinct()
    s = versions.select("ver_id", F.lit(True).alias("_s")).distinct()
    out = requested.join(k, ["law_id", "ver_id"], "left").join(s, "ver_id", "left")
    outcome = F.when(F.col("_k").isNull(), "rejected").when(F.col("_s"), "done").otherwise("to_import")
    return out.select("law_id", "ver_id", outcome.alias("outcome"))


def discovery_summary(new_counts: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A10: one row: laws checked, versions discovered, errors."""
    total = new_counts.select("law_id", "new_count", F.lit(0).alias("_e"))
    if errors is not None:
        total = total.unionByName(errors.select("law_id", F.lit(0).cast("long").alias("new_count"), F.lit(1).alias("_e")))
    return total.agg(
        F.count(F.lit(1)).alias("checked"), F.coalesce(F.sum("new_count"), F.lit(0)).alias("discovered"), F.coalesce(F.sum("_e"), F.lit(0)).alias("errors")
    )


def discovery_notices(new_counts: DataFrame, laws: DataFrame) -> DataFrame:
    """A10: one notice per law with new versions."""
    return new_counts.where("new_count > 0").join(laws, "law_id").select(
        "law_id",
        F.concat(F.lit("New version(s) found: "), "title").alias("title"),
        F.concat(F.col("new_count").cast("string"), F.lit(" new version(s) discovered for Legea "), "law_number", F.lit("/"), F.col("law_year").cast("string"), F.lit(".")).alias("message"),
    )
