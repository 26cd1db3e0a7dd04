"""Checks around an answer: gates, partition by issue, citations, coverage, confidence, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import LAW_KEY
from palimpsest.functions.text import strip_space
from palimpsest.operators.core import first_seen, top_k

TRIGGER, WARN = 0.3, 0.5


def relevance_gate(questions: DataFrame, ranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """per question the clamped top score and what follows from it.

    Below 0.3 the run stops, unless every primary law is in the library; below 0.5 it warns.
    """
    scores = ranked.groupBy("question_id").agg(F.max("reranker_score").alias("top_score"), F.avg("reranker_score").alias("_avg"))
    primary = (
        candidates.where("tier = 'tier1_primary'")
        .groupBy("question_id")
        .agg(F.count_if(F.col("law_id").isNull()).alias("_missing"), F.count_if(F.col("law_id").isNotNull()).alias("_held"))
    )
    out = questions.select("question_id").distinct().join(scores, "question_id", "left").join(primary, "question_id", "left")
    score = F.when(F.col("top_score").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("top_score"))))
    missing, held = F.coalesce("_missing", F.lit(0)), F.coalesce("_held", F.lit(0))
    outcome = (
        F.when(F.col("top_score").isNull(), "skipped")
        .when(score >= WARN, "ok")
        .when(score >= TRIGGER, "warning")
        .when((held > 0) & (missing == 0), "proceed")
        .when(missing > 0, "needs_import")
        .otherwise("clarification")
    )
    return out.select(
        "question_id",
        F.round(score, 3).alias("relevance_score"),
        F.round("top_score", 3).alias("top_reranker_score"),
        F.round("_avg", 3).alias("avg_reranker_score"),
        F.coalesce(score < TRIGGER, F.lit(False)).alias("gate_triggered"),
        F.coalesce((score >= TRIGGER) & (score < WARN), F.lit(False)).alias("gate_warning"),
        outcome.alias("outcome"),
    )


def _stale() -> Column:
    return F.coalesce(F.col("version_status") == "stale", F.lit(False)) | F.coalesce(F.col("currency_status") == "stale", F.lit(False))


def coverage_gate(questions: DataFrame, candidates: DataFrame, recheck: bool = False) -> DataFrame:
    """pause a question when a candidate law is missing, of the wrong version or stale; without
    candidates ask back. ``recheck`` after an import looks at primary laws only and not at staleness."""
    pool = candidates.where("role = 'PRIMARY'") if recheck else candidates
    stale = F.lit(False) if recheck else _stale()
    seen = pool.groupBy("question_id").agg(
        F.count_if(F.col("availability") == "missing").alias("missing"),
        F.count_if(F.col("availability") == "wrong_version").alias("wrong_version"),
        F.count_if(stale).alias("stale"),
    )
    out = questions.select("question_id").distinct().join(seen, "question_id", "left")
    counts = ["missing", "wrong_version", "stale"]
    if recheck:
        outcome = F.when(F.col("missing") > 0, "error_missing").when(F.col("wrong_version") > 0, "error_wrong_version").otherwise("continue")
    else:
        trouble = (F.col("missing") > 0) | (F.col("wrong_version") > 0) | (F.col("stale") > 0)
        outcome = F.when(F.col("missing").isNull(), "clarification").when(trouble, "pause").otherwise("continue")
    return out.select("question_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], outcome.alias("outcome"))


def coverage_lines(candidates: DataFrame) -> DataFrame:
    """what the message lists, one line per (question, reason, law), dates for stale laws."""
    name = F.concat(F.coalesce("title", F.lit("")), F.lit(" ("), "law_number", F.lit("/"), F.col("law_year").cast("string"), F.lit(")"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    dates = F.concat(name, F.lit(" — "), text("available_version_date"), F.lit(" < "), text("official_current_date"))
    reasons = F.filter(
        F.array(
            F.when(F.col("availability") == "missing", F.struct(F.lit("missing").alias("reason"), name.alias("line"))),
            F.when(F.col("availability") == "wrong_version", F.struct(F.lit("wrong_version").alias("reason"), name.alias("line"))),
            F.when(_stale(), F.struct(F.lit("stale").alias("reason"), dates.alias("line"))),
        ),
        lambda x: x.isNotNull(),
    )
    return candidates.select("question_id", F.inline(reasons))


def partition_by_issue(hits: DataFrame, issue_versions: DataFrame) -> DataFrame:
    """Hits to the issues whose selected version they belong to, all others to 'shared'."""
    links = issue_versions.select("question_id", "version_id", "issue_id").distinct()
    return hits.join(links, ["question_id", "version_id"], "left").withColumn("issue_id", F.coalesce("issue_id", F.lit("shared")))


def empty_issues(issues: DataFrame, partitioned: DataFrame) -> DataFrame:
    """Flags of issues that got no hit."""
    some = partitioned.select("question_id", "issue_id").distinct()
    return issues.select("question_id", "issue_id").distinct().join(some, ["question_id", "issue_id"], "left_anti").withColumn(
        "flag", F.concat(F.lit("ISSUE "), "issue_id", F.lit(": no articles matched after partitioning"))
    )


def analysis_coverage(issues: DataFrame, analysed: DataFrame) -> DataFrame:
    """Issues that were expected but not analysed."""
    done = analysed.select("question_id", "issue_id").distinct()
    return issues.select("question_id", "issue_id").distinct().join(done, ["question_id", "issue_id"], "left_anti").withColumn(
        "flag", F.concat("issue_id", F.lit(": not analyzed by reasoning step"))
    )


def certainty_rollup(analysed: DataFrame) -> DataFrame:
    """LOW if any issue is uncertain, MEDIUM if any is conditional, else HIGH."""
    level = F.col("certainty_level")
    return analysed.groupBy("question_id").agg(
        F.when(F.bool_or(level == "UNCERTAIN"), "LOW").when(F.bool_or(level == "CONDITIONAL"), "MEDIUM").otherwise("HIGH").alias("derived_confidence")
    )


def missing_law_mentions(texts: DataFrame, candidates: DataFrame, laws: DataFrame) -> DataFrame:
    """Laws named in free text that were not candidates, and whether the library holds them."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(LAW_KEY), 1).alias("n"), F.regexp_extract_all("text", F.lit(LAW_KEY), 2).alias("y")
    )
    named = texts.select("question_id", F.inline(pairs)).select("question_id", F.col("n").alias("law_number"), F.col("y").cast("int").alias("law_year")).distinct()
    open_ = named.join(candidates.select("question_id", "law_number", "law_year").distinct(), ["question_id", "law_number", "law_year"], "left_anti")
    held = laws.groupBy("law_number", "law_year").agg(F.min("law_id").alias("law_id"))
    return open_.join(held, ["law_number", "law_year"], "left").select(
        "question_id", "law_number", "law_year", F.col("law_id").isNotNull().alias("in_library")
    )


# --- citations -------------------------------------------------------------------------------


def operative_keys(refs: DataFrame) -> DataFrame:
    """(run_id, law_key, article_number) from texts like 'Legea 31/1990 art.197 alin.(3)'."""
    key = F.regexp_extract("article_ref", LAW_KEY, 0)
    art = F.regexp_extract("article_ref", r"art\.?\s*(\d+(?:\^\d+)?)", 1)
    return refs.select("run_id", key.alias("law_key"), art.alias("article_number")).where("law_key <> '' AND article_number <> ''").distinct()


def provided_keys(hits: DataFrame) -> DataFrame:
    key = F.concat_ws("/", "law_number", F.col("law_year").cast("string"))
    return hits.select("run_id", key.alias("law_key"), F.trim("article_number").alias("article_number")).distinct()


def validate_citations(citations: DataFrame, hits: DataFrame, operative: DataFrame | None = None) -> DataFrame:
    """Citations labelled DB that are not among the provided articles become Unverified.

    A citation holds if its (law, article) was provided, or its (law number, article) was retrieved.
    ``operative`` (see ``operative_keys``) narrows the first test.
    """
    article = F.regexp_replace(strip_space(F.coalesce("article", F.lit(""))), r"(?i)^art\.?\s*", "")
    law = strip_space(F.coalesce("law", F.lit("")))
    form = r"(\d+)\s*/\s*(\d+)"
    key = F.when(law.rlike(form), F.concat_ws("/", F.regexp_extract(law, form, 1), F.regexp_extract(law, form, 2))).otherwise(law)
    parsed = citations.withColumn("article_number", strip_space(article)).withColumn("law_key", key).withColumn("_num", F.regexp_extract(law, r"(\d+)", 1))
    exact = (operative if operative is not None else provided_keys(hits)).withColumn("_exact", F.lit(True))
    loose = hits.select("run_id", F.trim("law_number").alias("_num"), F.trim("article_number").alias("article_number"), F.lit(True).alias("_loose")).distinct()
    out = parsed.join(exact, ["run_id", "law_key", "article_number"], "left").join(loose, ["run_id", "_num", "article_number"], "left")
    found = F.coalesce("_exact", F.lit(False)) | F.coalesce("_loose", F.lit(False))
    was_db = F.coalesce(F.col("label") == "DB", F.lit(False))
    return out.select(
        *[F.col(c) for c in citations.columns if c != "label"],
        "article_number",
        "law_key",
        F.col("label").alias("original_label"),
        F.when(was_db & ~found, "Unverified").otherwise(F.col("label")).alias("label"),
    )


def citation_counts(checked: DataFrame) -> DataFrame:
    """Per run validated, downgraded, all DB-or-unverified citations, and whether most fell."""
    was_db = F.col("original_label") == "DB"
    out = checked.groupBy("run_id").agg(
        F.count_if(was_db & (F.col("label") == "DB")).alias("validated"),
        F.count_if(was_db & (F.col("label") == "Unverified")).alias("downgraded"),
        F.count_if(F.col("label").isin("DB", "Unverified")).alias("total_db"),
    )
    return out.withColumn("confidence_downgraded", (F.col("total_db") > 0) & (F.col("downgraded") > F.col("total_db") / 2))


def citation_coverage(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """Sources, distinct cited article numbers (law left out), retrieved minus cited, and beside
    them the distinct (law, article) pairs."""
    db = F.col("label") == "DB"
    cited = citations.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("sources_count"),
        F.count_distinct(F.when(db, F.col("article"))).alias("articles_cited"),
        F.count_distinct(F.when(db, F.struct("law", "article"))).alias("law_articles_cited"),
    )
    given = hits.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    return cited.join(given, "run_id", "left").select(
        "run_id", "sources_count", "articles_cited", (F.coalesce("_n", F.lit(0)) - F.col("articles_cited")).alias("articles_not_cited"), "law_articles_cited"
    )


# --- summaries -------------------------------------------------------------------------------


def retrieval_breakdown(hits: DataFrame) -> DataFrame:
    """Hits per source; the rules overlap on purpose."""
    lexical = (F.col("source") == "bm25") | F.coalesce(F.col("bm25_rank") != 0, F.lit(False))
    semantic = F.col("distance").isNotNull() & F.coalesce(F.col("bm25_rank") == 0, F.lit(True))
    return hits.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("articles_found"),
        F.count_if(lexical).alias("bm25_count"),
        F.count_if(semantic).alias("semantic_count"),
        F.count_if(F.col("tier") == "entity_targeted").alias("entity_count"),
        F.count_if(F.col("source") == "expansion").alias("expansion_added"),
        F.count_if(F.col("source") == "exception").alias("exceptions_added"),
    )


def issue_counts(partitioned: DataFrame) -> DataFrame:
    """Hits per issue, 'shared' included."""
    return partitioned.groupBy("question_id", "issue_id").agg(F.count(F.lit(1)).alias("articles"))


def top_ranked(ranked: DataFrame, n: int = 10) -> DataFrame:
    """The ten best hits of each question."""
    rows = ranked.select("question_id", "doc_type", "doc_id", F.round("reranker_score", 3).alias("score"), F.col("rank").alias("_rank"))
    return top_k(rows, ["question_id"], [F.asc("_rank")], n).drop("_rank")


def derive_confidence(runs: DataFrame) -> DataFrame:
    """Final confidence and its reason; the first LOW rule wins, later rules only cap.

    runs: model_confidence, levels ARRAY<STRING>, has_articles, primary_from_db, missing_primary,
    has_stale_versions, downgraded, total_db, governing_norm_incomplete, gaps ARRAY<STRING> (details
    of library gaps), conditions ARRAY<STRUCT<total, unknown>>.
    """
    low = (
        F.when(~F.col("has_articles"), "No relevant articles found")
        .when((F.col("total_db") > 0) & (F.col("downgraded") > F.col("total_db") / 2), "Most citations could not be verified against provided articles")
        .when(F.exists("levels", lambda x: F.coalesce(x, F.lit("UNCERTAIN")) == "UNCERTAIN"), "Legal analysis has uncertain conditions")
        .when(F.coalesce("governing_norm_incomplete", F.lit(False)), "Governing norm for primary issue not found")
    )
    cap = (
        F.when(F.exists("levels", lambda x: x == "CONDITIONAL"), "Legal analysis has conditional conclusions")
        .when(F.size("gaps") > 0, F.concat(F.lit("Library gap: "), F.coalesce(F.get("gaps", F.lit(0)), F.lit("missing provision"))))
        .when(F.exists("conditions", lambda x: (x["total"] > 0) & (x["unknown"] > x["total"] / 2)), "Majority of legal conditions could not be evaluated")
        .when(~F.col("primary_from_db"), "Primary law source not from verified database")
        .when(F.col("missing_primary"), "Primary law not in library")
        .when(F.col("has_stale_versions"), "Law version may be outdated")
    )
    high = ~F.coalesce("model_confidence", F.lit("")).isin("LOW", "MEDIUM")
    capped = high & cap.isNotNull()
    return runs.withColumn("confidence", F.when(low.isNotNull(), "LOW").when(capped, "MEDIUM").otherwise(F.col("model_confidence"))).withColumn(
        "reason", F.when(low.isNotNull(), low).when(capped, cap).otherwise("Based on model assessment")
    )


# --- context ---------------------------------------------------------------------------------


def operative_first(hits: DataFrame, operative: DataFrame) -> DataFrame:
    """Mark hits an analysis calls operative. ``art.N`` inside a reference counts, so a number
    also matches as the beginning of a longer one."""
    numbers = operative.select("question_id", F.explode(F.regexp_extract_all("article_ref", F.lit(r"art\.([0-9^]+)"), 1)).alias("_n"))
    starts = F.transform(F.sequence(F.lit(1), F.length("_n")), lambda i: F.substring(F.col("_n"), F.lit(1), i))
    keys = numbers.select("question_id", F.explode(starts).alias("article_number"), F.lit(True).alias("_op")).distinct()
    return hits.join(keys, ["question_id", "article_number"], "left").withColumn("operative", F.coalesce("_op", F.lit(False))).drop("_op")


def context_lines(issues: DataFrame, partitioned: DataFrame, facts: DataFrame, flags: DataFrame) -> DataFrame:
    """The context of each question as ordered lines: facts, issues with their articles, shared
    articles, flags.

    Lines stay rows (question_id, section, part, place, line), to be ordered or written sorted by
    those columns, so no context is ever gathered in one cell.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    none = F.lit("").alias("part")

    def lines(df: DataFrame, section: int, part: Column, place: Column, line: Column) -> DataFrame:
        return df.select("question_id", F.lit(section).alias("section"), part.alias("part"), place.cast("long").alias("place"), line.alias("line"))

    def heading(df: DataFrame, section: int, title: str, part: Column = none) -> DataFrame:
        return lines(df.select("question_id", *(["issue_id"] if part is not none else [])).distinct(), section, part, F.lit(-1), F.lit(title))

    said = F.concat(F.lit("  "), text("fact_id"), F.lit(": "), text("description"))
    dated = F.when(text("date") != "", F.concat(F.lit(" ("), text("date"), F.lit(")"))).otherwise("")
    out = None
    for no, (kind, title) in enumerate((("stated", "STATED FACTS:"), ("assumed", "ASSUMED FACTS:"), ("missing", "MISSING FACTS (identified by classifier):"))):
        mine = facts.where(F.col("kind") == kind)
        block = heading(mine, no, title).unionByName(lines(mine, no, none, F.col("place"), F.concat(said, dated)))
        out = block if out is None else out.unionByName(block)

    def article(prefix: str) -> Column:
        return F.concat(F.lit(f"{prefix}[Art. "), text("article_number"), F.lit("] "), text("law_title"), F.lit(" ("), text("law_number"), F.lit("/"), text("law_year"), F.lit(")"))

    rows = issues.select("question_id", "issue_id", "description", "relevant_date")
    heads = first_seen(rows, ["question_id", "issue_id"], ["relevant_date", "description"])
    out = out.unionByName(lines(heads, 3, F.col("issue_id"), F.lit(-3), F.concat("issue_id", F.lit(": "), text("description"))))
    out = out.unionByName(lines(heads, 3, F.col("issue_id"), F.lit(-2), F.concat(F.lit("  Relevant date: "), F.coalesce("relevant_date", F.lit("unknown")))))
    out = out.unionByName(lines(heads, 3, F.col("issue_id"), F.lit(-1), F.lit("  Articles:")))
    mine = partitioned.where("issue_id <> 'shared'")
    shared = partitioned.where("issue_id = 'shared'")
    for df, section, part, pad in ((mine, 3, F.col("issue_id"), "    "), (shared, 4, none, "  ")):
        place = F.col("rank") * 2
        out = out.unionByName(lines(df, section, part, place, article(pad))).unionByName(
            lines(df, section, part, place + 1, F.concat(F.lit(pad), text("text")))
        )
    out = out.unionByName(heading(shared, 4, "SHARED CONTEXT (SECONDARY):"))
    out = out.unionByName(lines(flags, 5, none, F.col("place"), F.concat(F.lit("  - "), text("flag"))))
    return out.unionByName(heading(flags, 5, "FLAGS AND WARNINGS:"))
