"""Scores of texts by an n-gram model of the corpus.

Tokens are words between ASCII white space, lower-cased in A-Z, and one end per text. A first job counts
the tokens of the training texts. The ``FREQUENT`` most frequent ones get numbers and are sent to all
tasks (a bound that doesn't grow); the others share one number in the model's contexts, and keep their own
exact counts: such a word's probability is that of the class after its context times its share of the class.

Another job reads the whole texts. A task turns a slice of texts to numbers and deals its triples (the
two words before, the word) over shards by the word before; a frequent word's triples are dealt over as
many shards as it is large, by the word before that, and its pairs (at most one per word with a number),
counted in a job of their own, go to all of them.
Rare words go to shards by themselves, where they are counted exactly. A shard builds its part of the trie
(``ngram_trie``) from the triples of the training texts, looks up every distinct triple of all texts, and
returns sums per slice and document, which are added up per slice. A shard holds about ``SHARD_TOKENS``
tokens whatever the corpus; a pair of words that are in very many documents sends one entry per document
to one shard.

The model: P(w | u, v) by absolute discounting, interpolated with P(w | v) and that with the base
probability (c + 0.1) / (N + 0.1 (V + 1)); a text's first token has its base probability. The discount of
a shard comes from its own counts of counts, unless given. Logarithms are rounded to 2^-12.

A null text is empty (one token, the end); a null id is kept; repeated rows are scored each; a null
training flag counts as false. Without training texts every probability is one. ``docs`` must give the
same rows when read again (a table does).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import ngram_trie
from palimpsest.llm.common import slices, text_of, utf8
from palimpsest.llm.ngram_trie import STEP, WORD_BITS, WORDS, Trie
from palimpsest.session import written

#: Words with numbers of their own, of which the first three are kept for other uses.
FREQUENT = WORDS - 3
START, RARE, FIRST = 1, 2, 3
#: The token that ends a text; no word holds white space.
END = b"\n"
#: Bytes of text of a slice; tokens of a shard; distinct tokens that a counting task holds.
SLICE, SHARD_TOKENS, HELD = 4 << 20, 1 << 19, 1 << 17
#: Added to every count of the base model.
ADDED = 0.1


def tokens_of(text: bytes) -> list[bytes]:
    """Bytes are lower-cased in A-Z only, and split at ASCII white space."""
    return [*text.lower().split(), END]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of training tokens; the row without a token counts the tokens of all texts."""

    def rows(found: Counter[bytes], total: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array([None, *found], pa.binary()), pa.array([total, *found.values()], pa.int64())], names=["token", "n"])

    found: Counter[bytes] = Counter()
    total = 0
    for batch in slices(batches, "_text"):
        for text, train in zip(utf8(batch.column("_text")), batch.column("_train").to_pylist()):
            got = tokens_of(text)
            total += len(got)
            if train:
                found.update(got)
        if len(found) > HELD:
            yield rows(found, total)
            found.clear()
            total = 0
    yield rows(found, total)


class Vocabulary:
    """Numbers and base probabilities of the frequent words, and the sums that hold for all."""

    def __init__(self, joined: bytes, counts: np.ndarray, train: int, distinct: int, total: int, shard_tokens: int) -> None:
        self.joined, self.counts = joined, counts
        self.train, self.distinct = train, distinct
        self.shards = max(1, -(-total // shard_tokens))
        self.whole = train + ADDED * (distinct + 1)
        self.rare = train - int(self.counts.sum())
        #: Mass of the class of rare words, with those never seen.
        self.rare_mass = self.rare + ADDED * (distinct - counts.size + 1)
        own = np.concatenate([np.full(FIRST, 1.0), (self.counts + ADDED) / self.whole])
        own[RARE] = self.rare_mass / self.whole
        self.single, self.single_steps = own, ngram_trie.steps(own).astype(np.int64)
        by_number = np.concatenate([np.zeros(FIRST, np.int64), self.counts])
        by_number[RARE] = self.rare
        self.spread = np.maximum(1, -(-by_number * self.shards // max(1, train)))

    def numbers(self) -> dict[bytes, int]:
        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                return RARE

        # the end token is white space, so words are split at the blank alone
        return Numbers({w: k + FIRST for k, w in enumerate(self.joined.split(b" "))} if self.joined else {})

    def base(self, n: np.ndarray) -> np.ndarray:
        """Logarithms of base probabilities of words that occur ``n`` times."""
        return np.log10((n + ADDED) / self.whole)

    def shard(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return (_mixed(last) + np.where(self.spread[last] > 1, _mixed(before + 7) % self.spread[last], 0)) % self.shards


def _mixed(x: np.ndarray) -> np.ndarray:
    h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(24)).astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte by byte of equal weight."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).reshape(-1)


ENTRIES = "shard long, slice long, info binary, pairs binary, pair_times binary, triples binary, docs binary, times binary, words binary, word_docs binary, word_times binary"
_COLUMNS = [c.split()[0] for c in ENTRIES.split(", ")]
_TYPES = [pa.int64(), pa.int64(), *[pa.binary()] * 9]


def _runs(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of sorted columns, and how often each occurs."""
    if not keys[0].size:
        return keys, np.zeros(0, np.int64)
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.diff(np.append(at, keys[0].size))


def _numbered(batch: pa.RecordBatch, numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[tuple[bytes, int, int]]]:
    """Numbers of all tokens of a slice, tokens per text, and (rare word, text, times)."""
    ids: list[np.ndarray] = []
    rare: list[tuple[bytes, int, int]] = []
    for d, text in enumerate(utf8(batch.column("_text"))):
        got = tokens_of(text)
        own = np.fromiter(map(numbers.__getitem__, got), np.int64, len(got))
        rare += [(w, d, n) for w, n in Counter(got[i] for i in np.flatnonzero(own == RARE).tolist()).items()]
        ids.append(own)
    return np.concatenate(ids), np.array([x.size for x in ids]), rare


PAIRS = "last long, pairs binary, times binary"


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct pairs with their counts."""
    pairs, of = np.unique(np.concatenate([np.zeros(0, np.int64), *(p for p, _ in held)]), return_inverse=True)
    return pairs, np.bincount(of, np.concatenate([np.zeros(0), *(n for _, n in held)]), pairs.size).astype(np.int64)


def _wide_pairs(sent):
    """The pairs of words whose triples lie in several shards, from training texts: a row per last word."""

    def rows(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        ends = np.flatnonzero(np.diff(pairs >> WORD_BITS, append=-1)) + 1
        own = [(int(pairs[a] >> WORD_BITS), packed(np.diff(pairs[a:z], prepend=0)), packed(n[a:z])) for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]
        columns = [list(c) for c in zip(*own)] or [[]] * 3
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["last", "pairs", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Vocabulary(*sent.value)
        numbers = model.numbers()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, "_text", SLICE):
            word, sizes, _ = _numbered(batch, numbers)
            later = np.ones(word.size, bool)
            later[np.cumsum(sizes) - sizes] = False
            at = np.flatnonzero(later)
            at = at[model.spread[word[at - 1]] > 1]
            held = [_summed([*held, (word[at - 1] << WORD_BITS | word[at], np.ones(at.size, np.int64))])]
            if held[0][0].size > 4 * HELD:
                yield rows(*held.pop())
        yield rows(*_summed(held))

    return run


def _spread(sent):
    """The pairs of one word, summed, as rows of ``ENTRIES`` for all of its shards."""

    def run(found: pa.Table) -> pa.Table:
        model = Vocabulary(*sent.value)
        pairs, n = _summed([(np.cumsum(unpacked(p)), unpacked(t)) for p, t in zip(found.column("pairs").to_pylist(), found.column("times").to_pylist())])
        last = pairs[:1] >> WORD_BITS
        shards = (_mixed(last)[0] + np.arange(model.spread[last[0]])) % model.shards
        data = packed(np.diff(pairs, prepend=0)), packed(n)
        rows = [(int(s), -1, None, *data, *[None] * 6) for s in shards]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_COLUMNS)

    return run


def _entries(sent):
    """Texts to rows of ``ENTRIES``: one with the documents of a slice, and one per shard that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Vocabulary(*sent.value)
        numbers = model.numbers()
        part = TaskContext.get().partitionId() << 32
        base = np.concatenate([np.zeros(FIRST), model.base(model.counts)])
        for k, batch in enumerate(slices(batches, "_text", SLICE)):
            train = np.array(batch.column("_train").to_pylist(), bool)
            word, sizes, rare = _numbered(batch, numbers)
            doc = np.repeat(np.arange(sizes.size), sizes)
            first = np.cumsum(sizes) - sizes
            own = word != RARE
            info = pa.record_batch(
                [
                    batch.column("_id"),
                    pa.array(~train),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.bincount(doc, own, sizes.size).astype(np.int64)),
                    pa.array(_add(doc, np.where(own, base[word], 0.0), sizes.size)),
                    pa.array(model.single_steps[word[first]]),
                ],
                names=["id", "held_out", "n_tokens", "n_known", "base", "steps"],
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, info.schema) as out:
                out.write_batch(info)
            rows: list[tuple] = [(int((part + k) % model.shards), part + k, sink.getvalue().to_pybytes(), *[None] * 8)]
            rows += _dealt(model, part + k, word, doc, first, train, rare)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_COLUMNS)

    return run


def _dealt(model: Vocabulary, number: int, word, doc, first, train, rare) -> Iterator[tuple]:
    """What each shard gets of a slice. Document numbers carry the training flag as lowest bit."""
    later = np.ones(word.size, bool)
    later[first] = False
    at = np.flatnonzero(later)
    v = word[at - 1]
    second = np.zeros(word.size, bool)
    second[np.minimum(first + 1, word.size - 1)] = True
    u = np.where(second[at], START, word[at - 2])
    flagged = doc[at] << 1 | train[doc[at]]
    triple = v << 2 * WORD_BITS | u << WORD_BITS | word[at]
    shard = model.shard(v, u).astype(np.int16 if model.shards < 1 << 15 else np.int64)
    del at, u, v, second, later
    # documents come in order already; few shards are sorted digit by digit
    order = np.argsort(triple, kind="stable")
    order = order[np.argsort(shard[order], kind="stable")]
    (shard, triple, flagged), times = _runs([shard[order], triple[order], flagged[order]])
    del order
    words: dict[int, list] = {}
    for w, d, n in rare:
        words.setdefault(zlib.crc32(w) % model.shards, []).append((w, d << 1 | int(train[d]), n))
    for s in sorted({*np.unique(shard).tolist(), *words}):
        own = slice(*np.searchsorted(shard, [s, s + 1]))
        mine = sorted(words.get(s, []))
        yield (
            s,
            number,
            *[None] * 3,
            packed(np.diff(triple[own], prepend=0)),
            packed(flagged[own]),
            packed(times[own]),
            zstandard.ZstdCompressor(level=1).compress(b" ".join(w for w, _, _ in mine)),
            packed(np.array([d for _, d, _ in mine], np.int64)),
            packed(np.array([n for _, _, n in mine], np.int64)),
        )


def _add(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(places, values, size).astype(float)


PARTS = "slice long, info binary, docs binary, steps binary, base binary, known binary"


class Shard:
    """The rows of one shard, in order of their slices."""

    def __init__(self, found: pa.Table) -> None:
        rows = found.sort_by("slice").to_pydict()
        self.info = [(s, i) for s, i in zip(rows["slice"], rows["info"]) if i is not None]
        self.pairs = [(np.cumsum(unpacked(p)), unpacked(n)) for p, n in zip(rows["pairs"], rows["pair_times"]) if p is not None]
        there = [k for k, t in enumerate(rows["triples"]) if t is not None]
        of = lambda name: [rows[name][k] for k in there]
        self.slices = of("slice")
        self.triples = [np.cumsum(unpacked(x)) for x in of("triples")]
        self.docs, self.times, self.word_docs, self.word_times = ([unpacked(x) for x in of(c)] for c in ("docs", "times", "word_docs", "word_times"))
        words = (zstandard.ZstdDecompressor().decompress(x) for x in of("words"))
        self.words = [w.split(b" ")[: d.size] for w, d in zip(words, self.word_docs)]


def _levels(model: Vocabulary, shard: Shard, discounts) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The shard's trie, the distinct triples asked for, and which of them each entry is."""
    nothing = np.zeros(0, np.int64)
    distinct, of = np.unique(np.concatenate([*shard.triples, nothing]), return_inverse=True)
    trained = np.concatenate([*(t * (d & 1) for t, d in zip(shard.times, shard.docs)), nothing])
    counts = np.bincount(of, trained, distinct.size).astype(np.int64)
    held = counts > 0
    known, n = distinct[held], counts[held]
    v = known >> 2 * WORD_BITS
    narrow = model.spread[v] == 1
    pairs, of_pair = np.unique(np.concatenate([(v << WORD_BITS | known & WORDS - 1)[narrow], *(p for p, _ in shard.pairs)]), return_inverse=True)
    pair_counts = np.bincount(of_pair, np.concatenate([n[narrow], *(m for _, m in shard.pairs)]), pairs.size).astype(np.int64)
    return ngram_trie.build(known, n, pairs, pair_counts, model.single, discounts), distinct, of


def _score(sent, discounts):
    def run(found: pa.Table) -> pa.Table:
        model, shard = Vocabulary(*sent.value), Shard(found)
        out = [(s, i, *[None] * 4) for s, i in shard.info]
        data, distinct, of = _levels(model, shard, discounts)
        cost = Trie(ngram_trie.mapped(data)).cost(distinct, model.single_steps)
        counts: dict[bytes, int] = {}
        for w, d, n in zip(shard.words, shard.word_docs, shard.word_times):
            for x, i, k in zip(w, d.tolist(), n.tolist()):
                counts[x] = counts.get(x, 0) + k * (i & 1)
        at = 0
        for s, d, n, w, wd, wn in zip(shard.slices, shard.docs, shard.times, shard.words, shard.word_docs, shard.word_times):
            c = np.array([counts[x] for x in w], np.int64)
            places, line = np.unique(np.concatenate([d, wd]) >> 1, return_inverse=True)
            own, of_words = line[: d.size], line[d.size :]
            step = _add(own, cost[of[at : at + d.size]] * n, places.size)
            step += _add(of_words, ngram_trie.steps((c + ADDED) / model.rare_mass) * wn, places.size)
            base = _add(of_words, model.base(c) * wn, places.size)
            known = _add(of_words, wn * (c > 0), places.size)
            out.append((s, None, packed(places), packed(step.astype(np.int64)), packed(base), packed(known.astype(np.int64))))
            at += d.size
        columns = [list(c) for c in zip(*out)] or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.binary()] * 5])], names=[c.split()[0] for c in PARTS.split(", ")])

    return run


def _sum(sent):
    def run(found: pa.Table) -> pa.Table:
        rows = found.to_pydict()
        info = pa.ipc.open_stream(next(i for i in rows["info"] if i is not None)).read_all()
        steps, base, known = (np.asarray(info.column(c)).copy() for c in ("steps", "base", "n_known"))
        parts = sorted((d, s, b, k) for d, s, b, k in zip(*(rows[c] for c in ("docs", "steps", "base", "known"))) if d is not None)
        for d, s, b, k in parts:  # in a fixed order, so that sums come out alike
            at = unpacked(d)
            steps[at] += unpacked(s)
            base[at] += unpacked(b, np.float64)
            known[at] += unpacked(k)
        size = info.num_rows
        score = pa.array(steps * -STEP + 0.0)
        columns = [info.column("id"), info.column("held_out"), info.column("n_tokens"), known, np.full(size, sent.value[2]), base, score]
        return pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _prepared(docs: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), F.coalesce(training, F.lit(False)).alias("_train"))


def vocabulary_of(docs: DataFrame, shard_tokens: int, frequent: int) -> tuple:
    """What makes a ``Vocabulary``."""
    counts = written(docs.mapInArrow(_count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "tokens")
    words = counts.where("token is not null")
    sums = words.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("train")).first()
    total = counts.where("token is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = words.orderBy(F.desc("n"), "token").limit(frequent).toArrow()  # a bounded number
    return b" ".join(most.column("token").to_pylist()), np.array(most.column("n").to_pylist(), np.int64), sums.train, sums.distinct, total, shard_tokens


def _rows(texts: DataFrame, sent) -> DataFrame:
    """All rows of ``ENTRIES``; a word has at most as many pairs as there are numbers."""
    pairs = texts.where("_train").select("_text").mapInArrow(_wide_pairs(sent), PAIRS)
    wide = pairs.groupBy("last").applyInArrow(_spread(sent), ENTRIES)
    return texts.mapInArrow(_entries(sent), ENTRIES).unionByName(wide)


def score(
    docs: DataFrame,
    training: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_tokens: int = SHARD_TOKENS,
    frequent: int = FREQUENT,
    discounts: tuple[float, float] | None = None,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``, by the
    model of the rows where ``training`` holds; other columns are not read."""
    texts = _prepared(docs, training, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_of(texts, shard_tokens, frequent))
    parts = _rows(texts, sent).groupBy("shard").applyInArrow(_score(sent, discounts), PARTS)
    kind = texts.schema["_id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.groupBy("slice").applyInArrow(_sum(sent), schema).withColumnRenamed("id", id_col)


def levels(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, frequent: int = FREQUENT) -> DataFrame:
    """(shard, levels): the model's tries, one row per shard, to be kept as a table."""
    texts = _prepared(docs, training, id_col, text_col).where("_train")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_of(texts, shard_tokens, frequent))

    def run(found: pa.Table) -> pa.Table:
        data = _levels(Vocabulary(*sent.value), Shard(found), None)[0]
        return pa.table({"shard": found.column("shard").slice(0, 1), "levels": pa.array([data], pa.binary())})

    return _rows(texts, sent).groupBy("shard").applyInArrow(run, "shard long, levels binary")
