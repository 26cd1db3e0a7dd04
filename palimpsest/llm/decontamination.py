"""Benchmark decontamination with an FM-index per training shard.

Test phrases (all runs of ``window`` words of an item; a shorter item as a whole) are sent to the
tasks in blocks of a fixed size. A task gathers its documents into shards of about ``SHARD_WORDS``
words, kept as the numbers of the words that the block knows. Per shard and block it keeps the runs of known words
long enough to hold a phrase (no phrase can cross an unknown word), and builds an FM-index over them:
suffix array, Burrows-Wheeler transform in a wavelet matrix, and every sixteenth suffix position. All
phrases are searched backwards at once; the rows found are walked back to sampled positions, and the
places of a document are merged into spans. A document never spans two shards.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A null or empty text has no
words and no spans. Items without words have no phrases; an item with a null id marks words but is
not listed. Equal items and equal documents each count; columns of any name are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from palimpsest.llm.common import SLICE_BYTES, release, slices, utf8

WINDOW = 10
#: Words of a shard, phrases of a block: bounds of a task's memory, without influence on the result.
SHARD_WORDS = 1 << 20
BLOCK_PHRASES = 200_000
SAMPLE = 16

#: Lower-cases A-Z and turns every ASCII character that is in no word into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Phrases:
    """A block of distinct phrases and the items that hold them."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    numbers: dict[tuple[int, ...], int] = field(default_factory=dict)
    items: list[list] = field(default_factory=list)

    def add(self, item, words: list[bytes], window: int) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
        for phrase in {tuple(ids[i : i + window]) for i in range(max(1, len(ids) - window + 1))}:
            at = self.numbers.setdefault(phrase, len(self.numbers))
            if at == len(self.items):
                self.items.append([])
            self.items[at].append(item)

    def packed(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, list[list]]:
        """Vocabulary; phrases as rows of word numbers padded with zeros; their lengths; their items."""
        lengths = np.array([len(p) for p in self.numbers], np.int64)
        rows = np.zeros((len(lengths), int(lengths.max(initial=1))), np.int64)
        for row, phrase in zip(rows, self.numbers):
            row[: len(phrase)] = phrase
        return self.vocabulary, rows, lengths, self.items


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``keys``, by prefix doubling over the groups that are still tied.

    No two suffixes may be equal as far as they go (unique terminators see to that)."""
    n = keys.size
    order = np.argsort(keys, kind="stable")
    head = np.ones(n, bool)
    head[1:] = keys[order[1:]] != keys[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step, tied = 1, np.flatnonzero(~(head & np.append(head[1:], True)))
    while tied.size:
        suffixes = order[tied]
        both = rank[suffixes] * n + rank[suffixes + step]
        perm = np.argsort(both, kind="stable")
        both, suffixes = both[perm], suffixes[perm]
        order[tied] = suffixes
        new = np.ones(tied.size, bool)
        new[1:] = both[1:] != both[:-1]
        rank[suffixes] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        step *= 2
    return order


class Bits:
    """A bit vector with constant-time counts of ones."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((bits.size // 64 + 1) * 64, bool)
        padded[: bits.size] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, mask = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def at(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Symbols by their bits, highest first, each level stably split into zeros and ones."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.zeros, row = [], [], symbols
        for level in range(self.levels):
            one = (row >> (self.levels - 1 - level)) & 1 == 1
            self.bits.append(Bits(one))
            self.zeros.append(int(one.size - one.sum()))
            row = np.concatenate((row[~one], row[one]))
        every = np.arange(size)
        self.base = np.zeros(size, np.int64)
        self.base = self.rank(every, np.zeros(size, np.int64))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        place = at
        for level in range(self.levels):
            ones = self.bits[level].ones(place)
            one = (symbol >> (self.levels - 1 - level)) & 1 == 1
            place = np.where(one, self.zeros[level] + ones, place - ones)
        return place - self.base[symbol]

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, symbol = at, np.zeros(at.size, np.int64)
        for level in range(self.levels):
            one, ones = self.bits[level].at(place), self.bits[level].ones(place)
            place = np.where(one, self.zeros[level] + ones, place - ones)
            symbol = symbol * 2 + one
        return symbol, place - self.base[symbol]


class FmIndex:
    """Over runs of symbols from 1 up, given as one array in which a zero ends each run."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        stops = text == 0
        number = np.cumsum(stops)
        order = suffix_array(np.where(stops, number, number[-1] + text))
        self.size = text.size
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]))
        self.tree = WaveletMatrix(text[order - 1], symbols)
        start = np.concatenate(([0], np.flatnonzero(stops)[:-1] + 1))
        offset = np.arange(text.size) - np.repeat(start, np.diff(np.append(start, text.size)))
        sampled = (offset % SAMPLE == 0)[order]
        self.sampled, self.places = Bits(sampled), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one row of each phrase, searched from its last word on."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size, np.int64)
        left = np.flatnonzero(lengths > 0)
        for step in range(phrases.shape[1]):
            left = left[(lengths[left] > step) & (low[left] < high[left])]
            if not left.size:
                break
            symbol = phrases[left, lengths[left] - 1 - step]
            low[left] = self.counts[symbol] + self.tree.rank(symbol, low[left])
            high[left] = self.counts[symbol] + self.tree.rank(symbol, high[left])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: each row is walked back until it meets a sampled one. The first place of
        every run is sampled, so that no walk leaves its run."""
        out, walked = np.zeros(rows.size, np.int64), 0
        left, at = np.arange(rows.size), rows
        while left.size:
            known = self.sampled.at(at)
            out[left[known]] = self.places[self.sampled.ones(at[known])] + walked
            left, at = left[~known], at[~known]
            if left.size:
                symbol, rank = self.tree.symbol_and_rank(at)
                at = self.counts[symbol] + rank
            walked += 1
        return out


def numbered(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """A text's words as their numbers, 0 for unknown ones; the words themselves are not kept."""
    known = vocabulary.get
    return np.array([known(w, 0) for w in words_of(text)], np.int32)


def find(texts: list[np.ndarray], block: tuple) -> tuple[list[np.ndarray], list[set]]:
    """Per document of numbered words: merged spans of hit words as rows ``(start, end)``, and its items."""
    vocabulary, phrases, lengths, holders = block
    spans, items = [np.zeros((0, 2), np.int64) for _ in texts], [set() for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not lengths.size or not sizes.sum():
        return spans, items
    ids = np.concatenate(texts)
    ends = np.cumsum(sizes)
    # runs of known words, cut at unknown ones and at the ends of documents
    begin = ids > 0
    ended = np.zeros(ids.size + 1, bool)
    ended[ends] = True
    begin[1:] &= (ids[:-1] == 0) | ended[1:-1]
    starts = np.flatnonzero(begin)
    if not starts.size:
        return spans, items
    unknown = np.append(np.flatnonzero(ids == 0), ids.size)
    limit = np.minimum(unknown[np.searchsorted(unknown, starts)], ends[np.searchsorted(ends, starts, side="right")])
    limit[:-1] = np.minimum(limit[:-1], starts[1:])
    long = limit - starts >= lengths.min()
    starts, limit = starts[long], limit[long]
    if not starts.size:
        return spans, items
    width = limit - starts + 1
    heads = np.concatenate(([0], np.cumsum(width)[:-1]))
    inside = np.arange(width.sum()) - np.repeat(heads, width)
    place = np.repeat(starts, width) + inside
    stop = inside == np.repeat(width - 1, width)
    del inside
    text = np.where(stop, 0, ids[np.minimum(place, ids.size - 1)])
    # the shard's own numbers for the words that it has
    words = np.unique(text)
    own = np.zeros(len(vocabulary) + 1, np.int64)
    own[words] = np.arange(words.size)
    here = (own[phrases] > 0) | (np.arange(phrases.shape[1]) >= lengths[:, None])
    able = np.flatnonzero(here.all(axis=1))
    index = FmIndex(own[text], words.size)
    low, high = index.search(own[phrases[able]], lengths[able])
    found = high > low
    if not found.any():
        return spans, items
    able, low, count = able[found], low[found], (high - low)[found]
    which = np.repeat(able, count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    at = place[index.locate(rows)]
    document = np.searchsorted(ends, at, side="right")
    edge = np.zeros(ids.size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + lengths[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    change = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    # a document's end also ends a span
    first, last = change[::2], change[1::2]
    inner = ends[:-1][(ends[:-1] < ids.size) & (ends[:-1] > 0)]
    split = np.unique(inner[hit[inner] & hit[inner - 1]]) if inner.size else inner
    first, last = np.sort(np.append(first, split)), np.sort(np.append(last, split))
    owner = np.searchsorted(ends, first, side="right")
    both, at = np.stack((first, last), 1), np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for d, mine in zip(owner[at].tolist(), np.split(both, at[1:])):
        spans[d] = mine - (ends[d] - sizes[d])
    for pair in np.unique(document * len(lengths) + which).tolist():
        items[pair // len(lengths)].update(holders[pair % len(lengths)])
    return spans, items


def merge(spans: np.ndarray) -> np.ndarray:
    """Spans as few disjoint ones; those that touch become one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    return np.stack((spans[new, 0], reach[np.append(new[1:], True)]), 1)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[Phrases]:
    """The benchmark's phrases, a bounded block at a time; one empty block where there are none."""
    block = Phrases()
    for item, text in benchmark.select(item_col, F.col(text_col).cast("binary")).toLocalIterator():
        if len(block.numbers) >= most:
            yield block
            block = Phrases()
        if words := words_of(bytes(text or b"")):
            block.add(item, words, window)
    yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Per row of ``docs``: ``(id, n_words, n_hit, items, spans)``.

    ``items`` are the sorted ids of the items of which a phrase occurs; ``spans`` are the places to
    remove, as code points ``begin`` and ``end`` (exclusive) of the text, whole words.
    """
    found = _scan(docs.select(F.col(id_col), F.col(text_col).alias("_text")), benchmark, **options)
    return found.select(id_col, *[F.col(f"_{c}").alias(c) for c in ("n_words", "n_hit", "items", "spans")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no phrase occurs, as they were."""
    # as one struct, so that columns of any name come through
    found = _scan(docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("_text")), benchmark, **options)
    return found.where("_n_hit = 0").select("doc.*")


def _scan(
    rows: DataFrame,
    benchmark: DataFrame,
    *,
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_phrases: int = BLOCK_PHRASES,
) -> DataFrame:
    """``rows`` without ``_text``, with ``_n_words``, ``_n_hit``, ``_items`` and ``_spans``."""
    context = rows.sparkSession.sparkContext
    blocks = [context.broadcast(b.packed()) for b in _blocks(benchmark, item_col, item_text_col, window, block_phrases)]
    kept = [f for f in rows.schema if f.name != "_text"]
    item_type = benchmark.schema[item_col].dataType
    arrow_items, place = pa.list_(to_arrow_type(item_type)), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def search(held: list[pa.RecordBatch], words: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        spans, items = [np.zeros((0, 2), np.int64)] * len(words), [set() for _ in words]
        for n, block in enumerate(blocks):
            # each block numbers the words in its own way
            mine = words if n == 0 else [numbered(t, block.value[0]) for batch in held for t in utf8(batch.column("_text"))]
            found, of = find(mine, block.value)
            spans = [merge(np.concatenate((a, b))) if len(a) and len(b) else a if len(a) else b for a, b in zip(spans, found)]
            items = [a | b for a, b in zip(items, of)]
            if len(blocks) > 1:
                del block._value  # one block in memory at a time
        at = 0
        for batch in held:
            mine = slice(at, at + batch.num_rows)
            at += batch.num_rows
            columns = [
                pa.array([len(w) for w in words[mine]], pa.int64()),
                pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans[mine]], pa.int64()),
                pa.array([sorted(i for i in of if i is not None) for of in items[mine]], arrow_items),
                pa.array([_places(t, s) for t, s in zip(utf8(batch.column("_text")), spans[mine])], place),
            ]
            yield pa.record_batch([*(batch.column(f.name) for f in kept), *columns], names=[*(f.name for f in kept), "_n_words", "_n_hit", "_items", "_spans"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, total = [], [], 0
        for batch in slices(batches, "_text", min(SLICE_BYTES, 8 * shard_words)):
            held.append(batch)
            for text in utf8(batch.column("_text")):
                words.append(numbered(text, blocks[0].value[0]))
                total += len(words[-1])
            if total >= shard_words:
                yield from search(held, words)
                held, words, total = [], [], 0
                release()
        if held:
            yield from search(held, words)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    made = f"_n_words long, _n_hit long, _items array<{item_type.simpleString()}>, _spans array<struct<begin: long, end: long>>"
    return rows.mapInArrow(shards, ", ".join([*fields, made]))


def _places(text: bytes, spans: np.ndarray) -> list[dict]:
    """Spans of words as code points of the text."""
    if not len(spans):
        return []
    at = [m.span() for m in _WORD.finditer(text.decode())]
    return [{"begin": at[a][0], "end": at[b - 1][1]} for a, b in spans.tolist()]
