"""Date and number columns: the forms sources write them in, and dates inside questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import lookup, strip_space

# Fixed value: the date that stands for "unknown" in stored history.
SENTINEL = "1900-01-01"


def sentinel() -> Column:
    return F.lit(SENTINEL).cast("date")


def make_day(year: Column, month: Column, day: Column) -> Column:
    """A date, NULL where the three numbers make none."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def _part(col: Column, pattern: str, idx: int) -> Column:
    return F.try_to_number(F.nullif(F.regexp_extract(col, pattern, idx), F.lit("")), F.lit("9999")).cast("int")


_DOTTED = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$"
_ISO = r"^(\d{4})-(\d{2})-(\d{2})$"
_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"


def dotted_day(col: Column) -> Column:
    """DD.MM.YYYY to date."""
    s = strip_space(col)
    return make_day(_part(s, _DOTTED, 3), _part(s, _DOTTED, 2), _part(s, _DOTTED, 1))


def iso_day(col: Column) -> Column:
    s = strip_space(col)
    return F.when(s.rlike(_ISO), F.try_to_date(s, "yyyy-MM-dd"))


def history_day(col: Column) -> Column:
    """DD.MM.YYYY or ISO, else the sentinel."""
    return F.coalesce(dotted_day(col), iso_day(col), sentinel())


def list_day(col: Column) -> Column:
    """[day, month, year] to date."""
    return F.when(F.size(col) >= 3, make_day(F.get(col, 2), F.get(col, 1), F.get(col, 0)))


def slashed_to_iso(col: Column) -> Column:
    """DD/MM/YYYY to YYYY-MM-DD text, parts as given."""
    parts = F.split(strip_space(col), "/")
    return F.when(F.size(parts) == 3, F.concat_ws("-", F.get(parts, 2), F.get(parts, 1), F.get(parts, 0)))


# Month words in two languages.
MONTHS = {
    "Jan": "01", "Feb": "02", "Mar": "03", "Apr": "04",
    "May": "05", "Jun": "06", "Jul": "07", "Aug": "08",
    "Sep": "09", "Oct": "10", "Nov": "11", "Dec": "12",
    "Ian": "01", "Mai": "05", "Iun": "06", "Iul": "07", "Sept": "09", "Noi": "11",
}


def month_word_day(col: Column) -> Column:
    """X10: 'D Mon YYYY', a dot after the month allowed."""
    parts = F.split(strip_space(col), r"\s+")
    month = lookup(MONTHS, F.regexp_replace(F.get(parts, 1), r"\.$", ""))
    day = make_day(F.get(parts, 2).try_cast("int"), month, F.get(parts, 0).try_cast("int"))
    return F.when(F.size(parts) == 3, day)


def us_or_iso_day(col: Column) -> Column:
    """M/D/YYYY or ISO."""
    s = strip_space(col)
    us = make_day(_part(s, _SLASHED, 3), _part(s, _SLASHED, 1), _part(s, _SLASHED, 2))
    return F.coalesce(us, iso_day(s))


def iso_to_dotted(col: Column) -> Column:
    """YYYY-MM-DD to DD.MM.YYYY, anything else as it is."""
    parts = F.split(col, "-")
    return F.when(F.size(parts) == 3, F.concat_ws(".", F.get(parts, 2), F.get(parts, 1), F.get(parts, 0))).otherwise(col)


def rate_number(col: Column) -> Column:
    """X11: rate text, percent sign dropped, comma or dot decimals."""
    s = F.regexp_replace(strip_space(col), "%+$", "")
    return F.replace(strip_space(s), F.lit(","), F.lit(".")).try_cast("double")


_TENOR = r"(?i)euribor\s+(\d+)\s+(week|month)"


def tenor_code(col: Column) -> Column:
    """X12: 'Euribor N week' to NW, 'Euribor N months' to NM."""
    n = F.regexp_extract(col, _TENOR, 1)
    unit = F.upper(F.substring(F.regexp_extract(col, _TENOR, 2), 1, 1))
    return F.when(n != "", F.concat(F.regexp_replace(n, "^0+(?=.)", ""), unit))


# Ways a question names a date.
FULL_DATE = r"(\d{1,2})[./\-](\d{1,2})[./\-](\d{4})"
YEAR_PHRASE = r"(?i)\b(?:in|din|anul|din anul|pe|la)\s+(\d{4})\b"
YEARS_AGO = r"(?i)\bacum\s+(\d+)\s+ani?\b"
MONTHS_AGO = r"(?i)\bacum\s+(\d+)\s+luni?\b"


def question_date(col: Column, today: Column) -> Column:
    """struct(primary_date, date_type, n_dates, year_bound).

    All full dates first (latest is primary), else a year phrase, else "N years/months ago", else
    today. A bare year stands as an exclusive bound, so ``primary_date`` is the last day before it
    and ``year_bound`` tells that apart.
    """
    texts = F.regexp_extract_all(col, F.lit(FULL_DATE), 0)
    days = F.filter(
        F.transform(
            texts,
            lambda t: make_day(
                F.regexp_extract(t, FULL_DATE, 3).cast("int"),
                F.regexp_extract(t, FULL_DATE, 2).cast("int"),
                F.regexp_extract(t, FULL_DATE, 1).cast("int"),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    year = F.regexp_extract(col, YEAR_PHRASE, 1)
    years = F.regexp_extract(col, YEARS_AGO, 1).try_cast("int")
    months = F.regexp_extract(col, MONTHS_AGO, 1).try_cast("int")
    has_year = year != ""
    primary = (
        F.when(F.size(days) > 0, F.array_max(days))
        .when(has_year, F.date_sub(make_day(year.try_cast("int"), F.lit(1), F.lit(1)), 1))
        .when(years.isNotNull(), F.add_months(today, -12 * years))
        .when(months.isNotNull(), F.add_months(today, -months))
        .otherwise(today)
    )
    kind = (
        F.when((F.size(days) > 0) | has_year, "explicit")
        .when(years.isNotNull() | months.isNotNull(), "relative")
        .otherwise("implicit_current")
    )
    return F.struct(
        primary.alias("primary_date"),
        kind.alias("date_type"),
        F.greatest(F.size(days), F.lit(1)).alias("n_dates"),
        ((F.size(days) == 0) & has_year).alias("year_bound"),
    )


def history_windows(start_year: Column, today: Column, years: int = 2) -> Column:
    """Windows of at most two calendar years from Jan 1 of the start year to today."""
    first = make_day(start_year, F.lit(1), F.lit(1))
    starts = F.when(first <= today, F.sequence(first, today, F.expr(f"INTERVAL {years} YEARS")))
    return F.transform(
        starts,
        lambda s: F.struct(s.alias("start"), F.least(F.date_sub(F.add_months(s, 12 * years), 1), today).alias("end")),
    )


def age_days(latest: Column, today: Column) -> Column:
    """X22."""
    return F.datediff(today, latest)
