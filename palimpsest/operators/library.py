"""Library views, suggestions and searches over laws and catalogue entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.terms import forms_of
from palimpsest.operators.core import best_row, first_seen, top_k
from palimpsest.operators.versions import unimported_counts
from palimpsest.session import written

UNCLASSIFIED = "__unclassified__"


# --- overview --------------------------------------------------------------------------------


def library_overview(laws: DataFrame, versions: DataFrame, categories: DataFrame, groups: DataFrame) -> DataFrame:
    """A1: each law with its version count (zero if none), current version and group."""
    counts = versions.groupBy("law_id").agg(F.count(F.lit(1)).alias("_n"))
    current = best_row(versions.where("is_current").select("law_id", "version_id", "state"), ["law_id"], ["version_id"])
    current = current.select("law_id", F.col("version_id").alias("current_version_id"), F.col("state").alias("current_state"))
    slugs = categories.join(groups, "group_id").select("category_id", F.col("group_slug").alias("category_group_slug"))
    out = laws.join(counts, "law_id", "left").join(current, "law_id", "left").join(slugs, "category_id", "left")
    return out.select(
        *[out[c] for c in laws.columns], F.coalesce("_n", F.lit(0)).alias("version_count"), "current_version_id", "current_state", "category_group_slug"
    )


def law_list(laws: DataFrame, versions: DataFrame, known: DataFrame) -> DataFrame:
    """A1, plain list: version count and number of known versions not imported."""
    counts = versions.groupBy("law_id").agg(F.count(F.lit(1)).alias("_n"))
    missing = unimported_counts(laws, known, versions)
    out = laws.join(counts, "law_id", "left").join(missing, "law_id", "left")
    return out.select(*[out[c] for c in laws.columns], F.coalesce("_n", F.lit(0)).alias("version_count"), "unimported_count")


def category_counts(laws: DataFrame, categories: DataFrame, groups: DataFrame) -> DataFrame:
    """A1: laws per category, zero where none."""
    n = laws.where("category_id IS NOT NULL").groupBy("category_id").agg(F.count(F.lit(1)).alias("_n"))
    return categories.join(groups, "group_id").join(n, "category_id", "left").select("category_id", "group_slug", F.coalesce("_n", F.lit(0)).alias("law_count"))


def library_totals(laws: DataFrame, versions: DataFrame) -> DataFrame:
    """A1: one row: laws, versions, day of the last import."""
    v = versions.agg(F.count(F.lit(1)).alias("total_versions"), F.max("date_imported").alias("_last"))
    law = laws.agg(F.count(F.lit(1)).alias("total_laws"))
    # two one-row results side by side
    return law.withColumn("_k", F.lit(1)).join(v.withColumn("_k", F.lit(1)), "_k").select(
        "total_laws", "total_versions", F.to_date("_last").alias("last_imported")
    )


def library_filter(overview: DataFrame, group: str | None = None, category_id: int | None = None, state: str | None = None) -> DataFrame:
    """overview rows of a group, a category, a state of the current version."""
    out = overview
    for column, value in (("category_group_slug", group), ("category_id", category_id), ("current_state", state)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def filtered_stats(filtered: DataFrame) -> DataFrame:
    """totals of the filtered rows, split by whether they have a category."""
    free = F.col("category_id").isNull()
    return filtered.agg(
        F.count(F.lit(1)).alias("total_laws"),
        F.coalesce(F.sum("version_count"), F.lit(0)).alias("total_versions"),
        F.count_if(free).alias("unclassified"),
        F.count_if(~free).alias("classified"),
    )


def group_laws(overview: DataFrame) -> DataFrame:
    """Each law with the bucket it is shown in; ``group_sizes`` gives the bucket sizes. Buckets
    stay rows: one may hold a third of the library."""
    return overview.withColumn("bucket", F.coalesce("category_group_slug", F.lit(UNCLASSIFIED)))


def group_sizes(overview: DataFrame) -> DataFrame:
    return group_laws(overview).groupBy("bucket").agg(F.count(F.lit(1)).alias("laws"), F.sum("version_count").alias("versions"))


def favorites(laws: DataFrame, favs: DataFrame, user: int | None = None) -> DataFrame:
    """Laws a user marked."""
    mine = favs if user is None else favs.where(F.col("user_id") == user)
    return laws.join(mine.select("law_id"), "law_id", "left_semi")


def favorite_counts(overview: DataFrame, favs: DataFrame, user: int | None = None) -> DataFrame:
    """Marked laws per group."""
    own = favorites(overview, favs, user).where("category_group_slug IS NOT NULL")
    return own.groupBy("category_group_slug").agg(F.count(F.lit(1)).alias("n"))


# --- suggestions -----------------------------------------------------------------------------


def list_suggestions(
    mappings: DataFrame,
    categories: DataFrame,
    groups: DataFrame,
    category_id: int | None = None,
    source: str | None = None,
    pinned: bool | None = None,
    title: str | None = None,
    group: str | None = None,
) -> DataFrame:
    """suggestions that were not deleted, by category, source, pin, title part and group."""
    out = mappings.where("deleted_at IS NULL")
    if category_id is not None:
        out = out.where(F.col("category_id") == category_id)
    if source is not None:
        out = out.where(F.col("source") == source)
    if pinned is not None:
        has = F.col("source_ver_id").isNotNull() | F.col("celex_number").isNotNull()
        out = out.where(has if pinned else ~has)
    if title:
        out = out.where(F.contains(F.lower("title"), F.lower(F.lit(title))))
    slugs = categories.join(groups, "group_id").select("category_id", "group_slug")
    out = out.join(slugs, "category_id", "left")
    return out if group is None else out.where(F.col("group_slug") == group)


def flag_imported(results: DataFrame, versions: DataFrame, laws: DataFrame, url_prefix: str) -> DataFrame:
    """Search results with ``already_imported`` and the law: by version id, else by source address."""
    by_id = versions.groupBy("ver_id").agg(F.min("law_id").alias("_a"))
    by_url = laws.where("source_url IS NOT NULL").groupBy("source_url").agg(F.min("law_id").alias("_b"))
    out = results.join(by_id, "ver_id", "left").withColumn("source_url", F.concat(F.lit(url_prefix), F.col("ver_id").cast("string")))
    out = out.join(by_url, "source_url", "left")
    law = F.coalesce("_a", "_b")
    return out.select(*results.columns, law.isNotNull().alias("already_imported"), law.alias("local_law_id"))


def flag_imported_eu(results: DataFrame, laws: DataFrame) -> DataFrame:
    """J8 for results that carry a CELEX number."""
    held = laws.where("celex_number IS NOT NULL").groupBy("celex_number").agg(F.min("law_id").alias("local_law_id"))
    return results.join(held, "celex_number", "left").withColumn("already_imported", F.col("local_law_id").isNotNull())


def flag_suggestions(mappings: DataFrame, laws: DataFrame) -> DataFrame:
    """J8 for suggestions: by CELEX number, or by number, year and type (empty matches empty)."""
    eu = laws.where("celex_number IS NOT NULL").select("celex_number", F.lit(True).alias("_e")).distinct()
    ro = laws.select(F.col("law_number").alias("_n"), F.col("law_year").alias("_y"), F.col("document_type").alias("_t"), F.lit(True).alias("_r")).distinct()
    same = (F.col("law_number") == F.col("_n")) & F.col("law_year").eqNullSafe(F.col("_y")) & F.col("document_type").eqNullSafe(F.col("_t"))
    out = mappings.join(eu, "celex_number", "left").join(ro, same, "left")
    return out.select(*[out[c] for c in mappings.columns], (F.coalesce("_e", F.lit(False)) | F.coalesce("_r", F.lit(False))).alias("is_imported"))


def pending_suggestions(mappings: DataFrame, laws: DataFrame) -> DataFrame:
    """Suggestions whose law is not in the library, the first per number and year; those without
    a number all stay."""
    live = mappings.where("deleted_at IS NULL")
    numbered = F.coalesce(F.col("law_number"), F.lit("")) != ""
    first = first_seen(live.where(numbered), ["law_number", "law_year"], ["mapping_id"])
    held = laws.select(F.col("law_number").alias("_n"), F.col("law_year").alias("_y")).distinct()
    same = (F.col("law_number") == F.col("_n")) & F.col("law_year").eqNullSafe(F.col("_y"))
    return first.join(held, same, "left_anti").unionByName(live.where(~numbered))


def resolve_category(laws: DataFrame, mappings: DataFrame) -> DataFrame:
    """Category of each law from the suggestions with its number.

    A single candidate decides; else type, number and year; else number and year; else type and
    number if that leaves one. Candidates are first reduced to the few facts the rules need, one row
    per number, per (number, year) and so on, so no law meets a long list of candidates.
    """
    m = mappings.where("law_number IS NOT NULL AND law_number <> 'unknown'")
    pick = F.min_by("category_id", "mapping_id")
    per_number = m.groupBy("law_number").agg(F.count(F.lit(1)).alias("_n1"), pick.alias("_c1"))
    per_exact = m.groupBy("law_number", "law_year", "document_type").agg(pick.alias("_c2"))
    per_year = m.groupBy("law_number", "law_year").agg(pick.alias("_c3"), F.lit(True).alias("_h3"))
    per_type = m.groupBy("law_number", "document_type").agg(F.count(F.lit(1)).alias("_n4"), pick.alias("_c4"))
    per_exact = per_exact.withColumn("_h2", F.lit(True))
    out = (
        laws.join(per_number, "law_number", "left")
        .join(per_exact, ["law_number", "law_year", "document_type"], "left")
        .join(per_year, ["law_number", "law_year"], "left")
        .join(per_type, ["law_number", "document_type"], "left")
    )
    category = (
        F.when(F.col("_n1").isNull(), None)
        .when(F.col("_n1") == 1, F.col("_c1"))
        .when(F.col("_h2"), F.col("_c2"))
        .when(F.col("_h3"), F.col("_c3"))
        .when(F.col("_n4") == 1, F.col("_c4"))
    )
    return out.select("law_id", category.alias("resolved_category_id"))


def auto_category(laws: DataFrame, mappings: DataFrame) -> DataFrame:
    """J10, on import: number and year only."""
    m = mappings.where("law_number IS NOT NULL").groupBy("law_number", "law_year").agg(F.min_by("category_id", "mapping_id").alias("resolved_category_id"))
    return laws.join(m, ["law_number", "law_year"], "left").select("law_id", "resolved_category_id")


def import_triage(mappings: DataFrame, laws: DataFrame, versions: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a bulk import does with each suggestion, and the counts per outcome.

    Type and year of the suggestion count only when given. The version is the pinned one, else the
    first catalogue entry (doc_type, number, year, ver_id, place) that fits.
    """
    given = {"document_type": "_t", "law_year": "_y"}
    m = mappings.withColumn("_m", F.struct(*[F.col(c).isNotNull() for c in given]))
    held = _any_of(m, laws.select("law_number", "document_type", "law_year"), given, F.lit(True), "_held")
    entries = catalog.select(F.col("number").alias("law_number"), "document_type", F.col("year").alias("law_year"), "ver_id", "place")
    hit = _any_of(m, entries, given, F.min_by("ver_id", "place"), "_found")
    out = m.drop("_m").join(held, "mapping_id", "left").join(hit, "mapping_id", "left")
    out = out.withColumn("ver_id", F.coalesce("source_ver_id", "_found"))
    stored = versions.select("ver_id", F.lit(True).alias("_s")).distinct()
    out = out.join(stored, "ver_id", "left")
    blank = F.coalesce("law_number", F.lit("")) == ""
    outcome = (
        F.when(blank, "error: no law number")
        .when(F.col("_held"), "skipped: already imported")
        .when(F.col("ver_id").isNull(), "error: not found")
        .when(F.col("_s"), "skipped: version already imported")
        .otherwise("import")
    )
    rows = out.select("mapping_id", outcome.alias("outcome"), F.when(outcome == "import", F.col("ver_id")).alias("ver_id"))
    return rows, rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _any_of(m: DataFrame, pool: DataFrame, given: dict[str, str], value: Column, name: str) -> DataFrame:
    """Match on number plus those columns the left row gives: one reduced equi join per combination."""
    out = None
    for mask in range(4):
        used = [c for i, c in enumerate(given) if mask >> i & 1]
        here = m.where(" AND ".join(f"{c} IS {'NOT ' if c in used else ''}NULL" for c in given))
        side = pool.groupBy("law_number", *used).agg((value if name != "_held" else F.first(value)).alias(name))
        part = here.join(side, ["law_number", *used]).select("mapping_id", name)
        out = part if out is None else out.unionByName(part)
    return out


# --- searches --------------------------------------------------------------------------------


def autocomplete(values: DataFrame, q: DataFrame, cap: int = 30) -> DataFrame:
    """for each query the first ``cap`` values (value, place) that contain it in any case; a query
    under two letters lists from the start.

    Texts meet values through their letter pairs: a value can only contain a text if it holds the
    text's rarest pair, so values are looked up by one pair and then checked. Queries of the same text
    share its list, which is cut before it is handed out.
    """
    values = values.withColumn("_v", F.lower("value"))
    long = q.where(F.length("text") >= 2).select("query_id", F.lower("text").alias("_t")).distinct()
    gram = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2))))
    pairs = values.where(F.length("_v") >= 2).select("value", "place", "_v", F.explode(gram("_v")).alias("_g"))
    asked = written(long.select("_t").distinct().select("_t", F.explode(gram("_t")).alias("_g")), "pairs")
    # only the pairs of texts are counted, only each text's rarest is looked up
    sizes = pairs.select("_g").join(asked.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rare = best_row(asked.join(sizes, "_g", "left").select("_t", "_g", F.coalesce("_n", F.lit(0)).alias("_n")), ["_t"], ["_n", "_g"], lowest=True)
    met = pairs.join(written(rare, "rarest"), "_g").where(F.contains("_v", F.col("_t"))).select("_t", "value", "place")
    found = long.join(top_k(met, ["_t"], [F.asc("place")], cap).drop("rank"), "_t").select("query_id", "value", "place")
    # short queries all get the same list: cut it once, then hand it out
    head = values.orderBy("place").limit(cap).select("value", "place")
    short = q.where(F.length("text") < 2).select("query_id", F.lit(1).alias("_k")).join(head.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return top_k(found.unionByName(short), ["query_id"], [F.asc("place")], cap)


def _forms(word: Column, table: dict[str, list[str]]) -> Column:
    """The word with its other forms, folded."""
    stored = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    return F.array_distinct(F.concat(F.array(word), F.transform(F.coalesce(F.try_element_at(stored, word), F.array().cast("array<string>")), X.fold)))


def keyword_words(q: Column, split_numbers: bool = True) -> Column:
    """Significant words of a query: stop-words and single letters out, NUM/YEAR split in two."""
    parts = X.words(q)
    if split_numbers:
        parts = F.flatten(F.transform(parts, lambda w: F.when(w.rlike(r"^\d+/\d{4}$"), F.split(w, "/")).otherwise(F.array(w))))
    kept = F.filter(parts, lambda w: ~F.lower(w).isin(*X.STOP_WORDS) & (F.length(w) >= 2))
    return F.transform(kept, X.fold)


def keyword_filter(df: DataFrame, query: str, fields: Sequence[str], split_numbers: bool = True) -> DataFrame:
    """F8: rows whose visible fields hold every significant word of the query column in some form."""
    table = forms_of()
    hay = X.fold(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    every = F.transform(keyword_words(F.col(query), split_numbers), lambda w: _forms(w, table))
    return (
        df.withColumn("_hay", hay)
        .withColumn("_words", every)
        .where(F.forall("_words", lambda forms: F.exists(forms, lambda v: F.contains(F.col("_hay"), v))))
        .drop("_hay", "_words")
    )


def word_variants(q: DataFrame, most: int = 3) -> DataFrame:
    """Up to three rephrasings per query, one word replaced by another form of it; words in
    order, forms in text order, the query itself left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("w"), F.array(*[F.lit(f) for f in v]).alias("f")) for k, v in forms_of().items()])
    forms = F.map_from_entries(pairs)
    w = X.words(F.lower("text"))
    split = q.select("query_id", "text", w.alias("_ws"), F.posexplode(w).alias("_i", "_w")).withColumn("_fs", F.try_element_at(forms, F.col("_w")))
    alts = split.select("query_id", "text", "_ws", "_i", "_w", F.explode("_fs").alias("_f")).where("_f <> _w")
    swapped = F.array_join(F.transform("_ws", lambda x, i: F.when(i == F.col("_i"), F.col("_f")).otherwise(x)), " ")
    made = alts.select("query_id", "_i", "_f", swapped.alias("variant"), F.lower("text").alias("_q")).where("variant <> _q")
    once = first_seen(made.select("query_id", "variant", "_i", "_f"), ["query_id", "variant"], ["_i", "_f"])
    return top_k(once, ["query_id"], [F.asc("_i"), F.asc("_f")], most).select("query_id", "variant", "rank")


# Endings a definite form may carry; the shortest that fits is cut.
ENDINGS = ("ul", "a", "ea", "ua", "ului", "ei", "iei", "elor")
# Words a query may start with that name a kind of act.
ACT_WORDS = (
    "legea ", "lege ", "oug ", "hg ", "og ", "ordin ", "ordinul ",
    "hotarare ", "hotararea ", "ordonanta ", "decizie ", "decizia ",
)


def bare_words(col: Column) -> Column:
    """Words without definite endings and diacritics, for comparing short names."""
    form = "^(.{2,})(?:" + "|".join(ENDINGS) + ")$"
    return F.array_join(F.transform(X.words(X.fold(col)), lambda w: F.regexp_replace(w, form, "$1")), " ")


def expand_aliases(q: DataFrame, aliases: DataFrame) -> DataFrame:
    """Queries to the act they mean (alias, place, title, doc_type, number).

    First the whole query, then the query without its act word, then both without endings, then the
    first alias of three letters or more that the query contains. Containment is found by the
    aliases' word starts, as equal keys.
    """
    low = X.strip_space(F.lower("text"))
    cut = F.trim(F.regexp_replace(low, "^(?:" + "|".join(ACT_WORDS) + ")", ""))
    asks = q.select("query_id", low.alias("_q"), cut.alias("_s"))
    asks = asks.withColumn("_qn", bare_words(F.col("_q"))).withColumn("_sn", bare_words(F.col("_s")))
    named = aliases.withColumn("_an", bare_words(F.col("alias")))
    out = None
    for level, left, right in ((0, "_q", "alias"), (1, "_s", "alias"), (2, "_qn", "_an"), (2, "_sn", "_an")):
        part = asks.select("query_id", F.col(left).alias("_k")).join(named.withColumn("_k", F.col(right)), "_k").select(
            "query_id", F.lit(level).alias("_l"), "place", "alias", "title", "doc_type", "number"
        )
        out = part if out is None else out.unionByName(part)
    # every three-letter piece of the query against the first three letters of the alias
    piece = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_q") - 2), lambda i: F.substring(F.col("_q"), i, F.lit(3))))
    inside = (
        asks.where(F.length("_q") >= 3)
        .select("query_id", "_q", F.explode(piece).alias("_k"))
        .join(aliases.where(F.length("alias") >= 3).withColumn("_k", F.substring("alias", 1, 3)), "_k")
        .where(F.contains("_q", F.col("alias")))
        .select("query_id", F.lit(3).alias("_l"), "place", "alias", "title", "doc_type", "number")
    )
    return best_row(out.unionByName(inside), ["query_id"], ["_l", "place"], lowest=True).drop("_l", "place")


# Rank of a kind of act, 4 for all others.
ACT_TIERS = {"LEGE": 1, "COD": 1, "OUG": 2, "OG": 2, "ORDONANTA": 2, "ORDONANȚĂ": 2, "HG": 3, "HOTARARE": 3, "HOTĂRÂRE": 3}
LAST_TIER = 4


def promoted_tier(query: Column) -> Column:
    """The tier a query asks for by naming a kind of act, NULL when it names none."""
    norm = X.fold(query)
    tokens = F.regexp_extract_all(norm, F.lit("[a-z]+"), 0)
    has = lambda *ws: F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in ws]))
    return (
        F.when(has("oug") | F.contains(norm, F.lit("de urgenta")), 2)
        .when(has("ordonanta", "og"), 2)
        .when(has("hotarare", "hg"), 3)
        .when(has("lege", "legea"), 1)
    )


def rank_results(results: DataFrame, query: str = "query", k: int = 20) -> DataFrame:
    """Boosted block first, then the kind of act the query names, then tiers, then
    arrival; best ``k`` per query. Columns query_id, query, doc_type, boosted, place."""
    tier = X.lookup(ACT_TIERS, F.upper("doc_type"), F.lit(LAST_TIER))
    ranked = results.withColumn("_tier", tier).withColumn("_rank", F.when(tier == promoted_tier(F.col(query)), 0).otherwise(1))
    order = [F.desc("boosted"), F.asc("_rank"), F.asc("_tier"), F.asc("place")]
    return top_k(ranked, ["query_id"], order, k).drop("_tier", "_rank")


def library_search(q: DataFrame, laws: DataFrame, k: int = 10) -> DataFrame:
    """Per query the laws with exactly that NUMBER/YEAR or bare number, then those whose fields
    hold every word; newest year first, ``k`` in all.

    Laws are looked up by three-letter pieces of a query's longest word, so queries and laws meet by
    equal keys; words under three letters fall back to single-letter keys.
    """
    raw = X.strip_space(F.col("text"))
    asks = q.select("query_id", raw.alias("_raw"), X.fold(raw).alias("_norm")).where("_raw <> ''")
    num = F.regexp_extract("_raw", r"(\d+)/(\d{4})", 1)
    bare = F.regexp_extract("_raw", r"^(\d+)$", 1)
    exact = asks.select(
        "query_id",
        F.when(num != "", num).otherwise(bare).alias("law_number"),
        F.when(num != "", F.regexp_extract("_raw", r"(\d+)/(\d{4})", 2).cast("int")).alias("_y"),
    ).where("law_number <> ''")
    hits = exact.join(laws.select("law_id", "law_number", "law_year"), "law_number").where("_y IS NULL OR law_year = _y").select(
        "query_id", "law_id", F.lit(0).alias("_p"), "law_year"
    )
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("title", "description", "keywords", "law_number", "law_year") if c in laws.columns]
    hay = laws.select("law_id", "law_year", X.fold(F.concat_ws(" ", *fields)).alias("_hay"))
    size = 3
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda i: F.substring(F.col(c), i, F.lit(size))))
    longest = F.array_max(F.transform(X.words(F.col("_norm")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    # queries of the same text share its list
    keyed = written(asks.select("_norm").distinct().withColumn("_l", longest), "texts")
    grams = hay.where(F.length("_hay") >= size).select("law_id", "law_year", "_hay", F.explode(pieces("_hay")).alias("_g"))
    asked = keyed.where(F.col("_l.n") >= size).withColumn("_w", F.col("_l.w"))
    asked = written(asked.select("_norm", F.explode(pieces("_w")).alias("_g")), "pieces")
    # only the pieces of texts are counted, only each text's rarest is looked up
    seen = grams.select("_g").join(asked.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    rare = best_row(asked.join(seen, "_g", "left").select("_norm", "_g", F.coalesce("_n", F.lit(0)).alias("_n")), ["_norm"], ["_n", "_g"], lowest=True)
    single = F.array_distinct(F.filter(F.split("_hay", ""), lambda x: x != ""))
    letters = hay.select("law_id", "law_year", "_hay", F.explode(single).alias("_g"))
    short = keyed.where(F.col("_l.n") < size).select("_norm", F.substring(F.col("_l.w"), 1, 1).alias("_g"))
    met = grams.join(written(rare.select("_norm", "_g"), "rarest"), "_g").unionByName(letters.join(short, "_g"))
    held = met.where(F.forall(X.words(F.col("_norm")), lambda t: F.contains(F.col("_hay"), t))).select("_norm", "law_id", "law_year")
    # exact hits take at most as many of a text's first ``k`` as they bring
    held = top_k(first_seen(held, ["_norm", "law_id"], ["law_year"]), ["_norm"], [F.desc("law_year"), F.asc("law_id")], k)
    title = asks.join(held, "_norm").select("query_id", "law_id", F.lit(1).alias("_p"), "law_year")
    merged = first_seen(hits.unionByName(title), ["query_id", "law_id"], ["_p"])
    return top_k(merged, ["query_id"], [F.asc("_p"), F.desc("law_year"), F.asc("law_id")], k).select("query_id", "law_id", "rank")


def text_pieces(words: Column, size: int = 3) -> Column:
    """Distinct pieces of one to ``size`` letters of an array of words."""
    cut = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n)))
    none = F.array().cast("array<string>")
    each = F.transform(words, lambda w: F.concat(*(F.when(F.length(w) >= n, cut(w, n)).otherwise(none) for n in range(1, size + 1))))
    return F.array_distinct(F.flatten(each))


def entries_holding(asks: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, variant, ver_id): entries (ver_id, text) that hold every word of a phrase, also as part
    of a word, both folded. ``asks`` is (query_id, variant, phrase); a phrase without words finds nothing.

    Index rows hold a piece of up to three letters and an id, no text. A phrase meets the entries of the
    rarest piece of all of its words (a word of three letters or more stands for pieces of three, a shorter
    one for itself); every candidate is then verified once against its text.
    """
    hay = X.fold(F.coalesce("text", F.lit("")))
    words = asks.select("query_id", "variant", F.array_distinct(X.tokens(F.col("phrase"))).alias("_ws")).where(F.size("_ws") > 0).distinct()
    longest = lambda w: F.filter(text_pieces(F.array(w)), lambda g: F.length(g) == F.least(F.length(w), F.lit(3)))
    # phrases of the same words are looked up once, and of the index only what they ask for is made
    each = words.select("_ws").distinct().select("_ws", F.explode(F.array_distinct(F.flatten(F.transform("_ws", longest)))).alias("_g"))
    each = written(each, "pieces")
    index = entries.select("ver_id", F.explode(text_pieces(X.tokens(F.col("text")))).alias("_g"))
    freq = index.join(each.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    # a piece that no entry holds counts as the rarest, and meets none
    rare = best_row(each.join(freq, "_g", "left").withColumn("_f", F.coalesce("_f", F.lit(0))), ["_ws"], ["_f", "_g"], lowest=True)
    met = index.join(written(rare.select("_ws", "_g"), "rarest"), "_g").select("_ws", "ver_id")
    held = met.join(entries.select("ver_id", hay.alias("_hay")), "ver_id").where(F.forall("_ws", lambda w: F.contains(F.col("_hay"), w)))
    return words.join(held.select("_ws", "ver_id"), "_ws").select("query_id", "variant", "ver_id")


def count_holding(asks: DataFrame, entries: DataFrame) -> DataFrame:
    """(query_id, n_entries, first_id, last_id): how many rows ``entries_holding`` finds for a query, and the
    first and last entry. Counted per set of words, so no row per query and entry is made."""
    words = asks.select("query_id", "variant", F.array_distinct(X.tokens(F.col("phrase"))).alias("_ws")).where(F.size("_ws") > 0).distinct()
    sets = words.select(F.col("_ws").alias("query_id"), F.lit(0).alias("variant"), F.array_join("_ws", " ").alias("phrase")).distinct()
    held = entries_holding(sets, entries).groupBy(F.col("query_id").alias("_ws"))
    held = held.agg(F.count(F.lit(1)).alias("_n"), F.min("ver_id").alias("_first"), F.max("ver_id").alias("_last"))
    found = words.join(held, "_ws").groupBy("query_id")
    return found.agg(F.sum("_n").alias("n_entries"), F.min("_first").alias("first_id"), F.max("_last").alias("last_id"))


def search_catalog(q: DataFrame, catalog: DataFrame, aliases: DataFrame, k: int = 10) -> DataFrame:
    """Alias, number, title, rephrased title and content searches over a local catalogue
    (ver_id, title, description, issuer, doc_type, doc_code, number, year, date, place), united in that order,
    filtered by keywords, ranked.

    Title and content searches need every word, also as part of a longer one.
    """
    entries = catalog.select("ver_id", F.concat_ws(" ", "title", "description").alias("text"))
    parsed = q.select("query_id", "text", X.parse_query(F.col("text")).alias("_p"))
    number = F.concat_ws("-", "number", F.col("year").cast("string"))

    def by_number(asks: DataFrame, strategy: int) -> DataFrame:
        """asks (query_id, doc_type, number); an empty type fits all, a number without year too."""
        full = catalog.select("ver_id", "place", "doc_code", number.alias("_n"))
        bare = catalog.select("ver_id", "place", "doc_code", F.col("number").alias("_n"))
        met = asks.join(full.unionByName(bare), asks["number"] == F.col("_n"))
        return met.where("doc_type = '' OR doc_type = doc_code").select("query_id", "ver_id", "place", F.lit(strategy).alias("_s"))

    def by_words(asks: DataFrame, strategy: int) -> DataFrame:
        """asks (query_id, variant, phrase): entries holding every word of a phrase."""
        held = entries_holding(asks, entries).select("query_id", "ver_id").distinct()
        return held.join(catalog.select("ver_id", "place"), "ver_id").select("query_id", "ver_id", "place", F.lit(strategy).alias("_s"))

    alias = expand_aliases(q, aliases)
    title = parsed.where(F.col("_p.title") != "").select("query_id", F.lit(0).alias("variant"), F.col("_p.title").alias("phrase"))
    forms = word_variants(q.select("query_id", F.col("text").alias("text"))).select("query_id", F.col("rank").alias("variant"), F.col("variant").alias("phrase"))
    content = q.select("query_id", F.lit(0).alias("variant"), F.array_join(X.significant(F.regexp_replace("text", X.TYPE_PREFIX, "")), " ").alias("phrase"))
    found = (
        by_number(alias.where("number <> ''").select("query_id", "doc_type", "number"), 0)
        .unionByName(by_words(alias.where("title <> ''").select("query_id", F.lit(0).alias("variant"), F.col("title").alias("phrase")), 1))
        .unionByName(by_number(parsed.where(F.col("_p.number") != "").select("query_id", F.col("_p.doc_type").alias("doc_type"), F.col("_p.number").alias("number")), 2))
        .unionByName(by_words(title, 3))
        .unionByName(by_words(forms, 4))
        .unionByName(by_words(content, 5))
    )
    first = first_seen(found, ["query_id", "ver_id"], ["_s", "place"])
    rows = first.join(catalog.drop("place"), "ver_id").join(q.select("query_id", F.col("text").alias("query")), "query_id")
    kept = keyword_filter(rows, "query", ["title", "description", "issuer", "doc_type", "number", "date"], split_numbers=True)
    boosted = kept.withColumn("boosted", F.col("_s").isin(0, 2)).withColumn("place", F.struct("_s", "place"))
    return rank_results(boosted, "query", k).select("query_id", "ver_id", "boosted", "rank")


