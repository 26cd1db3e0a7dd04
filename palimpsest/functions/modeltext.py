"""Columns that read structured text written by a model: JSON objects, scores, candidate laws."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.text import strip_space

FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"


def _without_comments(text: str) -> str:
    """Drop // comments that are not inside a quoted string of their line."""
    kept = []
    for line in text.split("\n"):
        piece = re.match(r'(?:[^"\\/]|\\.|/(?!/)|"(?:[^"\\]|\\.)*(?:"|$))*', line).group(0)
        kept.append(piece.rstrip() if line[len(piece) :].startswith("//") else line)
    return "\n".join(kept)


def _balanced(text: str) -> str | None:
    """The first {...} block with as many closing as opening braces."""
    start = text.find("{")
    depth = 0
    for m in re.finditer(r"[{}]", text[start:]) if start >= 0 else ():
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return text[start : start + m.end()]
    return None


def _json_or_none(text: str) -> str | None:
    for form in (text, _without_comments(text)):
        try:
            return json.dumps(json.loads(form), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def _salvage(col: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        text = raw.strip()
        fence = re.search(r"```(?:json)?\s*\n?(.*?)\n?```", text, re.DOTALL)
        block = _balanced(text)
        tries = [text, fence.group(1).strip() if fence else None, block]
        return next((found for t in tries if t is not None and (found := _json_or_none(t)) is not None), None)

    return col.map(one)


def json_object(col: Column) -> Column:
    """JSON text out of model output: as it is, fenced, with // comments, or the first balanced
    braces. Clean text never leaves the JVM; only the rest goes through Python."""
    s = strip_space(col)
    inner = strip_space(F.regexp_extract(s, FENCE, 1))
    # the parser reads the first value and ignores what follows it, so it is written out again
    first = lambda c: F.when(F.startswith(c, F.lit("{")), F.to_json(F.try_parse_json(c)))
    clean = F.coalesce(first(s), first(inner))
    return F.coalesce(clean, _salvage(F.when(clean.isNull(), col)))


ANALYSIS = (
    "struct<issues:array<struct<issue_id:string,certainty_level:string,"
    "governing_norm_status:struct<status:string,missing_norm_ref:string,expected_norm_description:string>,"
    "uncertainty_sources:array<struct<type:string,detail:string,impact:string>>,"
    "subsumption_summary:struct<total_conditions:bigint,satisfied:bigint,not_satisfied:bigint,unknown:bigint>>>>"
)


def analysis_issues(col: Column) -> Column:
    """Issues of an analysis with their defaults; NULL when the text holds none."""
    parsed = F.from_json(json_object(col), ANALYSIS)["issues"]
    return F.transform(
        parsed,
        lambda i: F.struct(
            i["issue_id"].alias("issue_id"),
            i["certainty_level"].alias("certainty_level"),
            F.coalesce(i["governing_norm_status"]["status"], F.lit("PRESENT")).alias("norm_status"),
            i["governing_norm_status"]["missing_norm_ref"].alias("missing_norm_ref"),
            F.coalesce(i["uncertainty_sources"], F.from_json(F.lit("[]"), "array<struct<type:string,detail:string,impact:string>>")).alias("uncertainty_sources"),
            i["subsumption_summary"].alias("subsumption_summary"),
        ),
    )


def scorer_scores(df: DataFrame, col: str) -> DataFrame:
    """``{"scores": [{"idx", "score"}]}`` somewhere in a text to rows (…, idx, score)."""
    block = F.regexp_extract(col, r"(?s)\{.*\}", 0)
    parsed = F.from_json(block, "struct<scores:array<struct<idx:int,score:double>>>")["scores"]
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.inline(parsed)).where("idx IS NOT NULL AND score IS NOT NULL")


def check_candidates(laws: DataFrame) -> DataFrame:
    """Rows without number or year are flagged malformed; a role that is neither is SECONDARY."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    role = F.when(F.col("role").isin("PRIMARY", "SECONDARY"), F.col("role")).otherwise("SECONDARY")
    return laws.withColumn("malformed", blank("law_number") | blank("law_year")).withColumn("role", role)
