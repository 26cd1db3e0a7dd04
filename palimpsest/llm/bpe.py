"""Byte-level BPE over overlapping chunks.

Long texts are cut into overlapping chunks. Each chunk is split into pre-tokens on its own, from an
arbitrary place; neighbours agree again from the first pre-token start that both found in their
overlap. Between two such places lies a piece that is encoded alone: merges never cross pre-tokens.
Texts of one chunk are one piece.

A place is used only if the character before it is no white space: the pattern's look-ahead could
otherwise see the cut. Where two neighbours find no common place, the text from there to its end is
taken as one piece, so the result never depends on the chunk size.

Nulls and empty texts give no ids. Texts that repeat are encoded once per long text; rows keep their
number, whatever their ids (null and repeated ids are fine).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import slices, text_of

#: Code points of a chunk and of its overlap with the next one.
CHUNK = 1 << 15
OVERLAP = 1 << 9


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _encoder(path: str, pattern: str):
    bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})

    def encode(text: str) -> np.ndarray:
        return np.asarray(bpe.encode_to_numpy(text, disallowed_special=()), dtype="<u4")

    return encode


def pretoken_starts(text: str, pattern: regex.Pattern, origin: int) -> list[int]:
    """Starts of the pre-tokens of ``text`` that have a character before them which is no white space."""
    return [origin + m.start() for m in pattern.finditer(text) if m.start() and not text[m.start() - 1].isspace()]


def encode(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``(id, n_tokens, ids)``; ``ids`` holds little-endian unsigned 32-bit integers."""
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    long = F.char_length("_text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(ranks, pattern)
        for batch in slices(batches, "_text"):
            ids = [bpe(t) for t in batch.column("_text").to_pylist()]
            sizes, packed = pa.array([i.size for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())
            yield pa.record_batch([batch.column(id_col), sizes, packed], names=[id_col, "n_tokens", "ids"])

    kind = rows.schema[id_col].dataType.simpleString()
    short = rows.where(~long).mapInArrow(whole, f"`{id_col}` {kind}, n_tokens long, ids binary")

    digest = rows.where(long).select(id_col, F.unhex(F.sha2("_text", 256)).alias("_key"), "_text")
    pieces = _pieces(digest.select("_key", "_text"), pattern, chunk, overlap)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(ranks, pattern)
        for batch in slices(batches, "_piece"):
            ids = [bpe(t).tobytes() for t in batch.column("_piece").to_pylist()]
            yield pa.record_batch([batch.column("_key"), batch.column("_at"), pa.array(ids, pa.binary())], names=["_key", "_at", "_ids"])

    encoded = (
        pieces.repartition("_key", "_at")
        .mapInArrow(parts, "_key binary, _at long, _ids binary")
        .groupBy("_key")
        .agg(F.sort_array(F.collect_list(F.struct("_at", "_ids")))["_ids"].alias("_parts"))
        .mapInArrow(_joined, "_key binary, n_tokens long, ids binary")
    )
    joined = digest.drop("_text").join(encoded, "_key").select(id_col, "n_tokens", "ids")
    return short.unionByName(joined)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [b"".join(parts) for parts in batch.column("_parts").to_pylist()]
        yield pa.record_batch([batch.column("_key"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["_key", "n_tokens", "ids"])


def _pieces(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``(_key, _at, _piece)``: the texts cut at places where neighbouring chunks agree."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist()):
                last = max(0, (len(text) - 1) // chunk)
                for k in range(last + 1):
                    window = text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.record_batch([pa.array([key], pa.binary()), pa.array([k], pa.int64()), pa.array([window], pa.string())], names=["_key", "_k", "_window"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = regex.compile(pattern)
        for batch in slices(batches, "_window"):
            heads, tails = [], []
            for k, window in zip(batch.column("_k").to_pylist(), batch.column("_window").to_pylist()):
                starts = pretoken_starts(window, words, k * chunk)
                heads.append([s for s in starts if s < k * chunk + overlap])
                tails.append([s for s in starts if s >= (k + 1) * chunk])
            lists = pa.list_(pa.int64())
            yield pa.record_batch([*(batch.column(c) for c in ("_key", "_k", "_window")), pa.array(heads, lists), pa.array(tails, lists)], names=["_key", "_k", "_window", "_heads", "_tails"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_windows"):
            out = []
            for at, end, first, windows in zip(*(batch.column(c).to_pylist() for c in ("_at", "_end", "_first", "_windows"))):
                text = "".join(w[:chunk] for w in windows[:-1]) + windows[-1]
                origin = first * chunk
                out.append(text[at - origin : None if end is None else end - origin])
            yield pa.record_batch([batch.column("_key"), batch.column("_at"), pa.array(out, pa.string())], names=["_key", "_at", "_piece"])

    chunks = (
        texts.mapInArrow(cut, "_key binary, _k long, _window string")
        .dropDuplicates(["_key", "_k"])
        .mapInArrow(split, "_key binary, _k long, _window string, _heads array<long>, _tails array<long>")
    )
    order = Window.partitionBy("_key").orderBy("_k")
    meet = F.when(F.col("_k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("_tails").over(order), "_heads")))
    placed = (
        chunks.withColumn("_meet", meet)
        .withColumn("_agreed", F.min(F.col("_meet").isNotNull()).over(order))
        .withColumn("_first", F.max(F.when(F.col("_agreed"), F.col("_k"))).over(order))
    )
    ends = F.when(F.lead("_agreed").over(order), F.lead("_meet").over(order))
    whole = F.sort_array(F.collect_list(F.struct("_k", "_window")))["_window"]
    return (
        placed.withColumn("_end", ends)
        .groupBy("_key", "_first")
        .agg(F.min("_meet").alias("_at"), F.max("_end").alias("_end"), whole.alias("_windows"))
        .mapInArrow(assemble, "_key binary, _at long, _piece string")
    )


def decode(encoded: DataFrame, ranks: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the raw bytes of the ids: the concatenation of the ids' byte strings."""
    kept = [c for c in encoded.columns if c != out_col]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {rank: token for token, rank in read_ranks(ranks).items()}
        for batch in slices(batches, ids_col):
            texts = [b"".join(map(piece.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())) for ids in batch.column(ids_col).to_pylist()]
            yield pa.record_batch([*batch.select(kept).columns, pa.array(texts, pa.binary())], names=[*kept, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*kept).schema)
    return encoded.select(*kept).mapInArrow(back, f"{fields}, `{out_col}` binary")
