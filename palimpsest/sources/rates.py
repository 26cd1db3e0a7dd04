"""Readers of FX and interest-rate files, and the seed file.

Each reader has two halves: ``read_*`` lands files, ``*_rows`` / ``parse_*`` turns landed documents
(doc_id, value) into rows, so the same code serves files, tables and streams. Documents are single
files or messages; a broken one gives no rows and never fails the job.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import dates as D
from palimpsest.functions.text import fold, lookup, strip_space

CELLS = "doc_id string, row int, col int, header boolean, text string"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (doc_id, value)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")


# --- FX as XML -------------------------------------------------------------------------------

RATE_XML = "array<struct<_VALUE:string,_currency:string,_multiplier:string>>"
CUBE_XML = f"struct<Rate:{RATE_XML},_date:string>"


def fx_rows(cubes: DataFrame) -> DataFrame:
    """(Rate, _date) to one row per rate; unreadable rates and rows without day or currency go,
    an unreadable multiplier is 1."""
    rows = cubes.select(F.col("_date").alias("date"), F.inline("Rate"))
    return (
        rows.select(
            F.try_to_date("date").alias("date"),
            F.col("_currency").alias("currency"),
            F.trim("_VALUE").try_cast("double").alias("rate"),
            F.coalesce(F.trim("_multiplier").try_cast("int"), F.lit(1)).alias("multiplier"),
        )
        .where("date IS NOT NULL AND rate IS NOT NULL AND currency IS NOT NULL AND currency <> ''")
    )


def read_fx_xml(spark: SparkSession, path: str) -> DataFrame:
    """XML files, one row per Cube read by the XML source (splits large files)."""
    reader = spark.read.format("xml").option("rowTag", "Cube").option("mode", "DROPMALFORMED")
    return fx_rows(reader.schema(f"Rate {RATE_XML}, _date string").load(path))


def parse_fx_xml(docs: DataFrame) -> DataFrame:
    """S1 for documents already in a table."""
    body = F.from_xml("value", F.lit(f"struct<Body:struct<Cube:array<{CUBE_XML}>>>"), {"mode": "PERMISSIVE"})
    return fx_rows(docs.select(F.inline(body["Body"]["Cube"])))


# --- tables ----------------------------------------------------------------------------------


class _TableCells(HTMLParser):
    """Cells of the first table of a page, text pieces stripped and joined."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth = 0
        self.done = False
        self.row = -1
        self.cells: list[list] = []
        self.open: list | None = None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth and tag == "tr":
            self.row += 1
            self.col = -1
        elif self.depth and tag in ("td", "th") and self.row >= 0:
            self.col += 1
            self.open = [self.row, self.col, tag == "th", ""]
            self.cells.append(self.open)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.depth == 0
        elif tag in ("td", "th"):
            self.open = None

    def handle_data(self, data):
        if self.open is not None and not self.done:
            self.open[3] += data.strip()


def _html_cells(html: str) -> list[list]:
    parser = _TableCells()
    try:
        parser.feed(html or "")
        parser.close()
    except Exception:  # a broken page has no cells
        return []
    return parser.cells


def _csv_cells(text: str) -> list[list]:
    try:
        return [[r, c, False, cell] for r, cells in enumerate(csv.reader(io.StringIO(text or ""))) for c, cell in enumerate(cells)]
    except csv.Error:
        return []


def _cells(docs: DataFrame, read) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[d, *cell] for d, v in zip(batch["doc_id"], batch["value"]) for cell in read(v)]
            yield pd.DataFrame(rows, columns=["doc_id", "row", "col", "header", "text"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "value").mapInPandas(run, CELLS)


def _cross(cells: DataFrame, heads: DataFrame, top: Column, left: Column, value: Column) -> DataFrame:
    """Meet column heads and row heads at each cell: (doc_id, top, left, value), all three present.

    ``heads`` gives each document's header row ``_h``.
    """
    placed = cells.join(heads, "doc_id")
    names = placed.where((F.col("row") == F.col("_h")) & (F.col("col") > 0)).select("doc_id", "col", top.alias("top")).where("top IS NOT NULL")
    sides = placed.where((F.col("row") > F.col("_h")) & (F.col("col") == 0)).select("doc_id", "row", left.alias("left")).where("left IS NOT NULL")
    body = placed.where((F.col("row") > F.col("_h")) & (F.col("col") > 0)).select("doc_id", "row", "col", value.alias("value")).where("value IS NOT NULL")
    return body.join(names, ["doc_id", "col"]).join(sides, ["doc_id", "row"]).select("doc_id", "top", "left", "value")


# Column heads of the daily table.
DAILY_TENORS = {"o/n": "ON", "1 sapt.": "1W", "1 luna": "1M", "3 luni": "3M", "6 luni": "6M", "12 luni": "12M"}


def parse_rate_tables(docs: DataFrame, rate_type: str, tenors: dict[str, str] | None = None, layout: str = "down") -> DataFrame:
    """S2 (``layout='down'``): the row whose first header cell is 'Data' names the tenors, dates run
    down. S3 (``layout='auto'``): the first row names tenors or dates, whichever its second cell is.

    Returns (date, rate_type, tenor, rate).
    """
    cells = _cells(docs, _html_cells)
    text, rate = F.col("text"), D.rate_number(F.col("text"))
    if layout == "down":
        table = DAILY_TENORS if tenors is None else tenors
        first = cells.where((F.col("col") == 0) & F.col("header") & (F.lower(text) == "data"))
        heads = first.groupBy("doc_id").agg(F.min("row").alias("_h"))
        out = _cross(cells, heads, lookup(table, F.lower(F.trim(text))), D.month_word_day(text), rate)
        named = out.select(F.col("left").alias("date"), F.col("top").alias("tenor"), F.col("value").alias("rate"))
    else:
        corner = cells.where("row = 0 AND col = 1").select("doc_id", D.tenor_code(text).isNotNull().alias("_down"), F.lit(0).alias("_h"))
        down = _cross(cells, corner.where("_down").drop("_down"), D.tenor_code(text), D.us_or_iso_day(text), rate)
        across = _cross(cells, corner.where("NOT _down").drop("_down"), D.us_or_iso_day(text), D.tenor_code(text), rate)
        named = down.select(F.col("left").alias("date"), F.col("top").alias("tenor"), F.col("value").alias("rate")).unionByName(
            across.select(F.col("top").alias("date"), F.col("left").alias("tenor"), F.col("value").alias("rate"))
        )
    return named.select("date", F.lit(rate_type).alias("rate_type"), "tenor", "rate")


def read_rate_table_html(spark: SparkSession, path: str, rate_type: str, tenors: dict[str, str] | None = None, layout: str = "down") -> DataFrame:
    return parse_rate_tables(landed(spark, path), rate_type, tenors, layout)


# Column heads of the statistical export.
GRID_TENORS = {
    "robor overnight": "ON",
    "robor 1 saptamana": "1W",
    "robor 1 luna": "1M",
    "robor 3 luni": "3M",
    "robor 6 luni": "6M",
    "robor 12 luni": "12M",
}


def parse_rate_grid(docs: DataFrame, tenors: dict[str, str] = GRID_TENORS, rate_type: str = "ROBOR") -> DataFrame:
    """CSV form of the export; the first row that starts with 'Data' names the columns."""
    cells = _cells(docs, _csv_cells)
    norm = F.regexp_replace(strip_space(fold(F.col("text"))), r"\s+", " ")
    heads = cells.where((F.col("col") == 0) & (norm == "data")).groupBy("doc_id").agg(F.min("row").alias("_h"))
    out = _cross(cells, heads, lookup(tenors, norm), D.iso_day(F.col("text")), D.rate_number(F.col("text")))
    return out.select(F.col("left").alias("date"), F.lit(rate_type).alias("rate_type"), F.col("top").alias("tenor"), F.col("value").alias("rate"))


def read_rate_grid(spark: SparkSession, path: str, tenors: dict[str, str] = GRID_TENORS, rate_type: str = "ROBOR") -> DataFrame:
    return parse_rate_grid(landed(spark, path), tenors, rate_type)


# --- chart series as JSON --------------------------------------------------------------------

# Series number to tenor.
SERIES_TENORS = {1: "1M", 2: "3M", 3: "6M", 4: "12M", 5: "1W"}
_NUMBER = r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def parse_rate_series(docs: DataFrame, series: dict[int, str] = SERIES_TENORS, rate_type: str = "EURIBOR") -> DataFrame:
    """``[{Id, Data: [[epoch_ms, rate]]}]``; unknown series, short points and anything that is not
    a number are skipped."""
    parsed = docs.select(F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("ARRAY"))
    item = parsed.select(F.explode(F.expr("try_variant_get(v, '$', 'array<variant>')")).alias("s"))
    points = item.select(
        lookup(series, F.expr("try_variant_get(s, '$.Id', 'int')")).alias("tenor"),
        F.explode(F.expr("try_variant_get(s, '$.Data', 'array<variant>')")).alias("p"),
    ).where("tenor IS NOT NULL")
    pair = points.select("tenor", F.expr("try_variant_get(p, '$[0]', 'variant')").alias("t"), F.expr("try_variant_get(p, '$[1]', 'variant')").alias("r"))
    numeric = F.schema_of_variant("t").rlike(_NUMBER) & F.schema_of_variant("r").rlike(_NUMBER)
    return pair.where(numeric).select(
        F.to_date(F.timestamp_millis(F.expr("cast(cast(t as double) as bigint)"))).alias("date"),
        F.lit(rate_type).alias("rate_type"),
        "tenor",
        F.expr("cast(r as double)").alias("rate"),
    )


def read_rate_series_json(spark: SparkSession, path: str, series: dict[int, str] = SERIES_TENORS) -> DataFrame:
    return parse_rate_series(landed(spark, path), series)


# --- seed ------------------------------------------------------------------------------------


def seed_rows(rows: DataFrame) -> DataFrame:
    """(date, rate_type, tenor, rate) as text to typed rows; rows without day or rate go."""
    return rows.select(
        D.iso_day(F.col("date")).alias("date"),
        F.coalesce(F.nullif("rate_type", F.lit("")), F.lit("ROBOR")).alias("rate_type"),
        F.coalesce("tenor", F.lit("")).alias("tenor"),
        D.rate_number(F.col("rate")).alias("rate"),
    ).where("date IS NOT NULL AND rate IS NOT NULL")


def read_rate_seed(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped CSV with a header."""
    schema = "date string, rate_type string, tenor string, rate string"
    return seed_rows(spark.read.schema(schema).option("header", True).csv(path))


def write_rate_seed(df: DataFrame, path: str) -> None:
    """Gzipped CSV with a header."""
    rows = df.select(F.col("date").cast("string").alias("date"), "rate_type", "tenor", "rate")
    rows.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
