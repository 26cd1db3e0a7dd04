"""Spelling variants by blocked Gram matrices.

A word's letter counts form a vector. One inserted or deleted letter moves it by a squared distance of
one, one replaced letter by two; so words one edit apart lie at most two apart, in blocks of the same
or of adjacent length. The NumPy product of two blocks' vectors gives all their squared distances at
once; the pairs within reach are verified as edits.

So that the products don't grow with the square of the vocabulary, blocks are cut finer without losing
a pair: a word of length L is split in stretches of ``STRETCH`` letters (in 128 stretches if longer than
that allows), and one edit leaves all but one of them as they are. A block holds the words of length L
and those of length L + 1 that agree outside one stretch; a word lies in a few blocks of either kind. Small
blocks share one product, in which only pairs of one block count, and a block larger than ``TILE`` is
multiplied tile by tile. Equal letters outside the stretch cancel out, so vectors count the stretch's
letters only. A pair that several blocks hold is taken from the first.

Keys of blocks are hashes; verification compares whole words, so equal hashes of unequal keys cost time
only. The rows of one block are held by one task: words of up to 384 letters agree there but for three
letters (four, the longer ones). Rows with a null word or count, and empty words, take no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices
from palimpsest.session import written

#: Letters of a stretch, and most stretches of a word.
STRETCH, STRETCHES = 3, 128
#: Words of a block that are multiplied at once.
TILE = 512
#: Distinct words that a counting worker holds before it passes their counts on.
HELD_WORDS = 1 << 17

#: Word letters: ASCII and the Latin-1 letters, with the two signs between them.
LETTERS = "A-Za-zÀ-ÿ"


def lower_ascii(text: str) -> str:
    """Lower case of A-Z only, as bytes have it."""
    return text.encode().lower().decode()


def noisy_words(text: str, doc_id: str, shortest: int, every: int) -> Iterator[tuple[str, int]]:
    """Words of a text with their counts; runs whose checksum ``every`` divides have lost a letter."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(re.findall(f"[{LETTERS}]{{{shortest},}}", lower_ascii(text))).items():
        h = zlib.crc32(run.encode(), start)
        if every and h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        yield run, n


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, every: int = 31) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters in whole texts, lower-cased in A-Z only. The
    letter that goes from a run depends on the document's id; a null id counts as empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in slices(batches, "_text"):
            for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                for word, n in noisy_words(text or "", doc_id or "", shortest, every):
                    found[word] += n
                if len(found) > HELD_WORDS:
                    yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
                    found.clear()
        yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    texts = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(words: DataFrame) -> DataFrame:
    """A row per word and block: key, word, n, whether it is the longer kind, and its stretch."""

    def kept(size: Column, longer: int) -> Column:
        parts = F.least(F.ceil(size / STRETCH), F.lit(STRETCHES))
        return F.transform(
            F.sequence(F.lit(0).cast("long"), parts - 1),
            lambda i: F.struct(
                F.lit(bool(longer)).alias("longer"),
                F.floor(i * size / parts).cast("int").alias("start"),
                (F.floor((i + 1) * size / parts) - F.floor(i * size / parts) + longer).cast("int").alias("size"),
                size.cast("int").alias("base"),
            ),
        )

    size = F.char_length("word").cast("long")
    none = F.slice(kept(size, 0), 1, 0)
    spread = F.explode(F.concat(kept(size, 0), F.when(size > 1, kept(size - 1, 1)).otherwise(none)))
    rows = words.select("word", "n", spread.alias("_b")).select("word", "n", "_b.*")
    before, after = F.expr("substring(word, 1, start)"), F.expr("substring(word, start + size + 1)")
    return rows.select(F.xxhash64("base", "start", before, after).alias("key"), "word", "n", "longer", "start", "size")


class Words:
    """Rows of blocks, as columns."""

    def __init__(self, rows: pa.Table) -> None:
        self.words, self.n = rows.column("word").to_pylist(), rows.column("n").to_pylist()
        self.key, self.start, size = (np.asarray(rows.column(c)) for c in ("key", "start", "size"))
        self.longer = np.array(rows.column("longer").to_pylist(), bool)
        self.ends = (self.start + size).tolist()
        self.parts = [w[a:z] for w, a, z in zip(self.words, self.start.tolist(), self.ends)]


def letter_counts(parts: list[str]) -> np.ndarray:
    """A row per part, a column per letter that occurs."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    letters, of = np.unique(np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32), return_inverse=True)
    places = np.repeat(np.arange(len(parts)), sizes) * letters.size + of
    # squares stay exact
    kind = np.float32 if sizes.max(initial=0) < 2048 else np.float64
    return np.bincount(places, minlength=len(parts) * letters.size).reshape(len(parts), letters.size).astype(kind)


def edited(a: Words, i: int, b: Words, j: int) -> bool:
    """Whether the words are one edit apart, in their stretches; an insertion that fits in several blocks
    counts in the first of them."""
    if a.longer[i]:
        a, i, b, j = b, j, a, i
    x, y = a.parts[i], b.parts[j]
    if len(x) == len(y):
        if sum(p != q for p, q in zip(x, y)) != 1:
            return False
    else:
        if a.start[i] > 0 and y[1:] == x:
            return False
        at = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
        if x[at:] != y[at + 1 :]:
            return False
    u, v = a.words[i], b.words[j]
    return u[: a.start[i]] == v[: b.start[j]] and u[a.ends[i] :] == v[b.ends[j] :]


def near_in(a: Words, b: Words) -> list[tuple[int, int]]:
    """Pairs of two tiles (or of one with itself) that lie in one block and are one edit apart."""
    counts = letter_counts(a.parts + b.parts if b is not a else a.parts)
    x, y = (counts[: len(a.parts)], counts[len(a.parts) :]) if b is not a else (counts, counts)
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
    fit = squares == np.where(a.longer[:, None] ^ b.longer, 1, 2)
    fit &= (a.key[:, None] == b.key) & (a.start[:, None] == b.start) & ~(a.longer[:, None] & b.longer)
    if b is a:
        fit = np.triu(fit, 1)
    return [(i, j) for i, j in zip(*(k.tolist() for k in np.nonzero(fit))) if edited(a, i, b, j)]


def _tiles(rows: pa.Table) -> Iterator[tuple[Words, Words]]:
    """Tiles to multiply: small blocks together, a large one piece by piece."""
    key = np.asarray(rows.column("key"))
    same = np.append(key[1:] == key[:-1], False)
    rows = rows.filter(pa.array(same | np.append(False, same[:-1])))  # most blocks hold one word
    key = np.asarray(rows.column("key"))
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
    at = 0
    while at < rows.num_rows:
        k = int(np.searchsorted(ends, at, "right"))  # the block that begins here
        fits = int(np.searchsorted(ends, at + TILE, "right")) - 1
        to = int(ends[max(k, fits)])
        pieces = [Words(rows.slice(p, min(TILE, to - p))) for p in range(at, to, TILE)]
        for p, one in enumerate(pieces):
            yield from ((one, other) for other in pieces[p:])
        at = to


def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) both ways, from rows in order of their key."""
    rest: pa.Table | None = None
    for batch in chain(batches, [None]):
        if batch is None:
            rows, whole = rest, rest.num_rows if rest is not None else 0
        else:
            rows = pa.concat_tables([t for t in (rest, pa.Table.from_batches([batch])) if t is not None])
            key = np.asarray(rows.column("key"))
            whole = int(np.searchsorted(key, key[-1])) if key.size else 0  # the last block may go on
        for a, b in _tiles(rows.slice(0, whole)) if whole else ():
            out: list[tuple] = []
            for i, j in near_in(a, b):
                out += [(a.words[i], b.words[j], b.n[j]), (b.words[j], a.words[i], a.n[i])]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])
        rest = rows.slice(whole).combine_chunks() if batch is not None else None


def group_variants(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words and their counts ``n``: a word's form is
    the commonest word one edit apart (ties: the smaller), if it is at least ``ratio`` times as common;
    the root is where forms lead to."""
    words = written(words.where("word is not null and word <> '' and n is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = _blocks(words).repartition("key").sortWithinPartitions("key").mapInArrow(near_words, "word string, near string, near_n long")
    # negated counts, so that the least is the commonest and then the smaller word
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("_b"))
    common = -F.col("_b.less") >= ratio * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("_b.form")).alias("form"),
        F.when(common, -F.col("_b.less")).alias("form_n"),
    )
    formed = written(formed, "forms")
    least, most = formed.agg(F.min("n"), F.max("n")).first()
    # a step multiplies the count by ``ratio`` at least, so no way is longer than this
    steps = int(math.log(most / max(1, least), ratio)) + 1 if most else 1
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        roots = written(roots.join(onward, "root", "left").select("word", F.coalesce("_on", "root").alias("root")), "roots")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
