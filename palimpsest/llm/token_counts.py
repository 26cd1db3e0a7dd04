"""Token counts through a digest cache.

A text is known by the digest of its normalised content, a tokenizer by the digest of its file and
of how it is used. Counts live in an append-only Parquet table partitioned by tokenizer digest; a
job joins its texts to it, encodes only the distinct texts that are missing, appends their counts
and answers from the table. Normalising must not change the count: by default it only makes a null
text empty.

Repeated texts are encoded once, repeated rows and null ids each keep their row. A lost executor
repeats its tasks only; a failed job leaves no partial append (Spark's commit). Two jobs that append
the same digest at once store equal counts, which reading folds into one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, text_of

#: Distinct words that a task remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 1 << 18

CACHE = "tokenizer string, content binary, n_tokens long"


@dataclass(frozen=True)
class Tokenizer:
    """A SentencePiece model (``.model``) or a tokenizers file (``.json``), installed on every executor."""

    path: str

    @property
    def version(self) -> str:
        with open(self.path, "rb") as file:
            return hashlib.sha256(b"plain text, no added tokens\n" + file.read()).hexdigest()

    def counter(self) -> Callable[[list[str]], list[int]]:
        if not self.path.endswith(".model"):
            from tokenizers import Tokenizer as Library

            library = Library.from_file(self.path)
            library.no_truncation()
            library.no_padding()
            return lambda texts: [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=self.path)

        def count(texts: list[str]) -> list[int]:
            return [len(ids) for ids in model.encode(texts, num_threads=1)]

        return _by_word(count) if _words_are_apart(model) else count


def _words_are_apart(model) -> bool:
    """Whether no piece holds a space after another character and white space is kept as it is: then
    merges never cross the start of a run of spaces, and a text's count is the sum over its words."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    probe = [" a  b ", "　a\tb\n", "ﬁ é"]
    kept = all("".join(model.encode(t, out_type=str)).replace("▁", " ") == " " + t for t in ("a  b ", " ab"))
    exact = all(model.decode(model.encode(t)) == t for t in probe)
    return kept and exact and all(re.fullmatch("▁*[^▁]*", p) for p in pieces)


def _by_word(count: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    """Counts whole texts by their words. A word takes the spaces before it; the model itself puts one
    space before a text, so each word is given without its first one."""
    known: dict[str, int] = {}
    units = re.compile("[ ▁]+[^ ▁]*")
    lone = count([" "])[0] if count([" "]) == count(["▁"]) else None

    def texts(batch: list[str]) -> list[int]:
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        words = []
        for text in batch:
            if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
                words.append([w[1:] for w in units.findall(" " + text)] if text else [])
            else:
                words.append(text.split(" ") if text else [])
        new = list({w for ws in words for w in ws}.difference(known))
        known.update(zip(new, count(new)))
        known[""] = 1  # a single space at the end of a text
        return [sum(map(known.__getitem__, ws)) for ws in words]

    return texts if lone is not None and count(["a "])[0] == count(["a"])[0] + 1 else count


def read_cache(like: DataFrame, cache: str, version: str) -> DataFrame:
    """``(content, n_tokens)`` of one tokenizer; empty where the table does not exist yet."""
    spark = like.sparkSession
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    tokenizer: Tokenizer,
    cache: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` per row of ``docs``; fills the table ``cache`` on the way.

    ``n_bytes`` is of the normalised text. Null and empty texts have no tokens.
    """
    version = tokenizer.version
    rows = docs.select(F.col(id_col).alias(id_col), normalise(text_of(text_col)).alias("_text"))
    keyed = rows.withColumn("content", F.unhex(F.sha2("_text", 256)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer.counter()
        for batch in slices(batches, "_text"):
            counts = count(batch.column("_text").to_pylist())
            yield pa.record_batch([batch.column("content"), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    distinct = keyed.groupBy("content").agg(F.first("_text").alias("_text"))
    misses = distinct.join(read_cache(docs, cache, version), "content", "left_anti")
    fresh = misses.select("content", "_text").mapInArrow(encode, "content binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)

    sizes = keyed.select(id_col, "content", F.octet_length("_text").cast("long").alias("n_bytes"))
    return sizes.join(read_cache(docs, cache, version), "content").select(id_col, "n_bytes", "n_tokens")
