"""An n-gram trie of Elias-Fano levels: smoothed probabilities of words after one or two others.

All levels lie in one buffer (memory-mapped where it is built) and are read by views on it. For a last
word ``v`` the trie holds the words that follow it, and the words ``u`` before it; a triple (u, v, w) is
held below (v, u) not by the word ``w`` but by its place among the words that follow ``v``, a number
from a much smaller range. A query searches ``w`` among the successors of ``v`` and then its place among
those of (u, v). Ranges of successors are laid end to end with pointers that only grow, so pointers and
successors alike are Elias-Fano sequences: low bits packed, high bits in unary. Probabilities are smoothed
when the trie is built (absolute discounting, interpolated with the shorter context) and stored in steps
of ``STEP`` of their logarithm.
"""

from __future__ import annotations

import json
import mmap

import numpy as np

#: Bits of a word's number.
WORD_BITS = 18
WORDS = 1 << WORD_BITS
#: Steps that logarithms (base 10) are rounded to; sums of such numbers are exact in doubles.
STEP = 2.0**-12

#: Places that are looked up at once, so that what comes between stays in a core's cache.
CHUNK = 1 << 14

_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: The place of a byte's k-th one, at 256 k + byte.
_PLACE = np.array([(list(np.flatnonzero(b)) + [8] * 8)[:8] for b in _ONES], np.int64).T.reshape(-1).copy()
_55, _33, _0F, _01, _80 = (np.uint64(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))
_1, _2, _4, _7, _8, _56, _255 = (np.uint64(x) for x in (1, 2, 4, 7, 8, 56, 255))


def select_in(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th one of each word of 64 bits; it must have that many."""
    k = k.astype(np.uint64)
    counts = words - (words >> _1 & _55)
    counts = (counts & _33) + (counts >> _2 & _33)
    upto = (counts + (counts >> _4) & _0F) * _01  # in each byte, the ones of it and the lower ones
    place = (((k * _01 | _80) - upto & _80) >> _7) * _01 >> _56 << np.uint64(3)
    rest = k - (upto << _8 >> place & _255)
    return place.astype(np.int64) + _PLACE[(rest << _8 | words >> place & _255).astype(np.int64)]


def steps(p: np.ndarray) -> np.ndarray:
    """Logarithms as numbers of steps below zero."""
    return np.rint(-np.log10(p) / STEP)


class EliasFano:
    """A sequence of numbers that never fall: random access and search, for many places at a time."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        sizes, self.low, self.high, self.ones = arrays
        self.n, self.bits = (int(x) for x in sizes)
        self.zeros = np.arange(self.ones.size, dtype=np.int64) * 64 - self.ones

    @staticmethod
    def build(values: np.ndarray) -> list[np.ndarray]:
        n, most = values.size, int(values[-1]) if values.size else 0
        bits = max(0, (most // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values.astype(np.uint64) & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        size = (n + (most >> bits) + 2 + 63) // 64 * 64
        marks = np.zeros(size, np.uint8)
        marks[(values >> bits) + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(marks.reshape(-1, 64).sum(1, dtype=np.int64))])
        return [np.array([n, bits], np.int64), low, high, ones.astype(np.int64)]

    def _ones(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one of the high bits."""
        word = np.searchsorted(self.ones, k, "right") - 1
        return (word << 6) + select_in(self.high[word], k - self.ones[word])

    def _zeros(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, "right") - 1
        return (word << 6) + select_in(~self.high[word], k - self.zeros[word])

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(at.size, np.int64)
        bit = at * self.bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        # shifted in two parts, as a shift by 64 is none
        found = self.low[word] >> shift | self.low[word + 1] << (np.uint64(63) - shift) << np.uint64(1)
        return (found & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self._ones(at) - at) << self.bits | self._low(at)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of the values ``x``, -1 where they are not held: the successor of ``x``, compared with it."""
        found = np.full(x.size, -1, np.int64)
        for at in range(0, x.size if self.n else 0, CHUNK):
            some = x[at : at + CHUNK]
            inside = np.flatnonzero((some >= 0) & (some >> self.bits < self.zeros[-1]))
            found[at + inside] = self._find(some[inside])
        return found

    def _find(self, x: np.ndarray) -> np.ndarray:
        high, low = x >> self.bits, x & (1 << self.bits) - 1
        # the values with these high bits lie between two zeros
        end = np.minimum(self._zeros(high) - high, self.n)
        lower = np.maximum(high - 1, 0)
        left = np.where(high > 0, self._zeros(lower) - lower, 0)
        right, going = end.copy(), np.flatnonzero(left < end)
        while going.size:
            middle = left[going] + right[going] >> 1
            less = self._low(middle) < low[going]
            left[going[less]] = middle[less] + 1
            right[going[~less]] = middle[~less]
            going = going[left[going] < right[going]]
        held = left < end
        held[held] = self._low(left[held]) == low[held]
        return np.where(held, left, -1)


def to_buffer(arrays: list[np.ndarray]) -> bytes:
    head = json.dumps([(a.dtype.str, a.size) for a in arrays]).encode()
    parts = [len(head).to_bytes(8, "little"), head]
    for a in arrays:
        data = np.ascontiguousarray(a).tobytes()
        parts += [data, bytes(-len(data) % 8)]
    return b"".join(parts)


def views(buffer) -> list[np.ndarray]:
    """The arrays of a buffer, without copies."""
    size = int.from_bytes(buffer[:8], "little")
    at, found = 8 + size, []
    for kind, n in json.loads(bytes(buffer[8 : 8 + size])):
        found.append(np.frombuffer(buffer, kind, n, at))
        at += -(-found[-1].nbytes // 8) * 8
    return found


def mapped(data: bytes) -> mmap.mmap:
    """The levels in memory pages of their own."""
    pages = mmap.mmap(-1, len(data))
    pages.write(data)
    return pages


def discount(counts: np.ndarray) -> float:
    """Absolute discount from the numbers of n-grams that occur once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of sorted keys, where each begins, and the number of each row's value."""
    new = np.append(True, keys[1:] != keys[:-1]) if keys.size else np.zeros(0, bool)
    return keys[new], np.flatnonzero(new), np.cumsum(new) - 1


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if starts.size else np.zeros(0, values.dtype)


def build(
    triples: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, single: np.ndarray, discounts: tuple[float, float] | None = None
) -> bytes:
    """The trie of sorted ``triples`` (v, u, w in one number) and ``pairs`` (v, w) with their counts;
    ``single`` holds the probability of each word by itself."""
    d2, d3 = discounts or (discount(pair_counts), discount(counts))
    lasts, start2, of2 = _groups(pairs >> WORD_BITS)
    total2, kinds2 = _sums(pair_counts, start2), np.bincount(of2, minlength=lasts.size)
    p2 = (pair_counts - d2) / total2[of2] + d2 * (kinds2 / total2)[of2] * single[pairs & WORDS - 1]
    contexts, start3, of3 = _groups(triples >> WORD_BITS)
    total3, kinds3 = _sums(counts, start3), np.bincount(of3, minlength=contexts.size)
    v, w = triples >> 2 * WORD_BITS, triples & WORDS - 1
    below = np.searchsorted(pairs, v << WORD_BITS | w)
    p3 = (counts - d3) / total3[of3] + d3 * (kinds3 / total3)[of3] * p2[below]
    rank = np.searchsorted(lasts, contexts >> WORD_BITS)
    # every context has as many places as its last word has successors
    first = np.concatenate([[0], np.cumsum(kinds2[rank])[:-1]]) if contexts.size else np.zeros(0, np.int64)
    place = below - start2[rank[of3]]
    arrays: list[np.ndarray] = []
    ranked = np.arange(lasts.size) << WORD_BITS
    for sequence in (lasts, start2, ranked[of2] | pairs & WORDS - 1, ranked[rank] | contexts & WORDS - 1, first, first[of3] + place):
        arrays += EliasFano.build(sequence.astype(np.int64))
    for codes in (p2, d2 * kinds2 / total2, p3, d3 * kinds3 / total3):
        arrays.append(np.minimum(steps(codes), 65535).astype(np.uint16) if codes.size else np.zeros(0, np.uint16))
    return to_buffer(arrays)


class Trie:
    def __init__(self, buffer) -> None:
        arrays = views(buffer)
        self.lasts, self.start2, self.pairs, self.contexts, self.first, self.places = (EliasFano(arrays[k : k + 4]) for k in range(0, 24, 4))
        self.p2, self.rest2, self.p3, self.rest3 = arrays[24:]

    def cost(self, triples: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Steps below zero of the probability of w after u and v, for sorted triples; ``single`` has them
        by word."""
        asked, _, of = _groups(triples >> WORD_BITS)
        lasts, _, of_last = _groups(asked >> WORD_BITS)
        rank = self.lasts.find(lasts)
        start = self.start2.get(np.maximum(rank, 0)) if self.lasts.n else rank
        context = np.where(rank[of_last] >= 0, self.contexts.find(rank[of_last] << WORD_BITS | asked & WORDS - 1), -1)
        first = self.first.get(np.maximum(context, 0)) if self.contexts.n else context
        word, of_last = triples & WORDS - 1, of_last[of]
        pairs, of_pair = np.unique(rank[of_last] << WORD_BITS | word, return_inverse=True)
        pair = self.pairs.find(pairs)[of_pair]
        cost = single[word].astype(np.int64)
        if self.lasts.n:
            known = rank[of_last] >= 0
            cost = np.where(pair >= 0, self.p2[np.maximum(pair, 0)], cost + known * self.rest2[np.maximum(rank, 0)][of_last])
        if self.contexts.n:
            met = context[of] >= 0
            cost += met * self.rest3[np.maximum(context, 0)].astype(np.int64)[of]
            both = np.flatnonzero(met & (pair >= 0))
            at = self.places.find(first[of[both]] + pair[both] - start[of_last[both]])
            cost[both[at >= 0]] = self.p3[at[at >= 0]]
        return cost
