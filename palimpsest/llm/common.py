"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def release() -> None:
    """Hands back what earlier tasks of this Python worker have freed; workers live for many stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column`` (one row at least)."""
    release()
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most / max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    release()


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as their UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for numbers that rarely repeat, sorting beats hashing."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if values.size else values


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
