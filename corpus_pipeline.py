"""A corpus pipeline of the subpackage's operators: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontamination, ngram_join, quality
from palimpsest.llm.common import table, unused
from palimpsest.llm.queries import QUALITY, quality_model
from palimpsest.session import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    score = unused(docs.columns, "score")
    scored = quality.score(docs, quality_model(spark, sf_dir), score_col=score)
    return scored.where(F.col(score) >= QUALITY).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked texts, that with the smallest id."""
    return ngram_join.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any phrase of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document left, and the bytes they decode to."""
    import public_tokenizers as tokenizers

    ranks = tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.decode(bpe.encode(docs, ranks, tokenizers.PATTERN), ranks)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode_bytes),
]

#: SQL expresses neither the classifier nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
