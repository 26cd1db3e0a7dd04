"""Search over a corpus for many questions at once: BM25, vectors, union, cap, rerank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.functions import text as X
from palimpsest.functions.terms import ENTITY_KEYWORDS, EXPANSIONS, expansion_of
from palimpsest.operators.core import first_seen, spread, top_k, top_k_by
from palimpsest.session import written

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
# Scores and distances are ranked in full; this many digits only take away what the order of a sum
# leaves behind, so that equal documents tie and the smaller id wins.
DIGITS = 12


# --- BM25 ------------------------------------------------------------------------------------


def query_terms(q: DataFrame, expansions: dict[str, list[str]] = EXPANSIONS) -> DataFrame:
    """(question_id, phrase, term, phrase_size, weight): words of three letters or more with their
    expansions. A phrase of several words counts only as a whole; repeats add weight."""
    word = F.explode(F.regexp_extract_all("text", F.lit(X.QUERY_WORD), 0)).alias("word")
    phrases = q.select("question_id", word).select(
        "question_id", F.explode(F.concat(F.array(X.fold(F.col("word"))), expansion_of(F.lower("word"), expansions))).alias("phrase")
    )
    weighted = phrases.groupBy("question_id", "phrase").agg(F.count(F.lit(1)).alias("weight"))
    parts = F.array_distinct(X.tokens(F.col("phrase")))
    return weighted.withColumn("_parts", parts).select(
        "question_id", "phrase", F.explode("_parts").alias("term"), F.size("_parts").alias("phrase_size"), "weight"
    )


# Documents of a block of the index, and blocks and questions of a cell of the search.
BLOCK_DOCS, CELL_BLOCKS, CELL_QUESTIONS = 16, 64, 1024
# Blocks per question that are scored before any is skipped.
SEED_BLOCKS = 2
# Shares of scores that a cell unfolds at a time, and hits of a cell that scores whole versions.
HELD_SHARES, CELL_HITS = 1_000_000, 500_000
# Words that are indexed at a time (a text is never cut).
HELD_WORDS = 1_000_000
# Pairs of a hit and a question's term that one task sums.
TASK_PAIRS = 500_000
# Vocabularies up to this size are sent to the tasks; larger ones are joined.
SENT_TERMS = 100_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``HELD_WORDS`` words, or of one text."""
    for batch in batches:
        ends, at = batch.column("_t").offsets.to_numpy(), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + HELD_WORDS, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def build_postings(corpus: DataFrame, vocabulary: DataFrame | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The impact index: a row per block of documents and term with the block's hits, the most often
    the term occurs in one of them and the least length. Store it once for many searches.

    A block holds documents of one kind and of like length that were read together; the row without a
    term carries their number and length. Documents are unique by kind, number and version. With a
    ``vocabulary`` (term) other terms are left out.
    """
    ids = [corpus.schema["doc_id"], corpus.schema["version_id"]]
    hit = T.StructType([*ids, T.StructField("doc_len", T.IntegerType()), T.StructField("tf", T.IntegerType())])
    schema = T.StructType(
        [
            corpus.schema["doc_type"],
            T.StructField("block", T.LongType()),
            T.StructField("term", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("total_len", T.LongType()),
            T.StructField("max_tf", T.IntegerType()),
            T.StructField("min_len", T.IntegerType()),
            T.StructField("hits", T.ArrayType(hit)),
        ]
    )
    texts = spread(corpus.select("doc_type", "doc_id", "version_id", "text"))
    toks = texts.select("doc_type", "doc_id", "version_id", X.tokens(F.coalesce("text", F.lit(""))).alias("_t"))
    known = vocabulary.select("term").distinct().limit(SENT_TERMS + 1).collect() if vocabulary is not None else []
    sent = corpus.sparkSession.sparkContext.broadcast([r.term for r in known]) if vocabulary is not None and len(known) <= SENT_TERMS else None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        asked = pa.array(sent.value, pa.string()) if sent is not None else None
        for batch in _pieces(batches):
            kinds = batch.column("doc_type").dictionary_encode()
            kind = kinds.indices.fill_null(len(kinds.dictionary)).to_numpy()
            found = batch.column("_t")
            size = np.diff(found.offsets.to_numpy())
            # documents of a kind in order of their length, cut in blocks
            order = np.lexsort((size, kind))
            new = np.append(True, kind[order][1:] != kind[order][:-1])
            place = np.arange(order.size) - np.maximum.accumulate(np.where(new, np.arange(order.size), 0))
            block = np.empty(order.size, np.int64)
            block[order] = np.cumsum(new | (place % block_docs == 0)) - 1
            n_blocks = int(block.max()) + 1
            docs = np.bincount(block, minlength=n_blocks)
            lengths = np.bincount(block, size, n_blocks).astype(np.int64)
            first = np.empty(n_blocks, np.int64)
            first[block[order[::-1]]] = order[::-1]
            terms = found.flatten().dictionary_encode()
            code, doc = terms.indices.to_numpy(), np.repeat(np.arange(size.size), size)
            if asked is not None:
                held = np.asarray(pc.is_in(terms.dictionary.cast(pa.string()), asked))[code]
                code, doc = code[held], doc[held]
            width = max(1, len(terms.dictionary))
            keys, tf = np.unique((block[doc] * width + code) * size.size + doc, return_counts=True)
            row, doc = keys // size.size, keys % size.size
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if row.size else np.zeros(0, np.int64)
            at = pa.array(doc)
            least, most = (np.minimum.reduceat(size[doc], starts), np.maximum.reduceat(tf, starts)) if row.size else (starts, starts)
            hits = pa.StructArray.from_arrays(
                [batch.column("doc_id").take(at), batch.column("version_id").take(at), pa.array(size[doc], pa.int32()), pa.array(tf, pa.int32())],
                names=[f.name for f in hit],
            )
            offsets = np.append(starts, row.size)
            blocks = np.concatenate([np.arange(n_blocks), row[starts] // width])
            nothing = pa.nulls(n_blocks, pa.int32())
            yield pa.record_batch(
                [
                    batch.column("doc_type").take(pa.array(first[blocks])),
                    pa.array(made + blocks),
                    pa.concat_arrays([pa.nulls(n_blocks, pa.string()), terms.dictionary.cast(pa.string()).take(pa.array(row[starts] % width))]),
                    pa.array(np.concatenate([docs, np.diff(offsets)]), pa.int64()),
                    pa.array(np.concatenate([lengths, np.zeros(starts.size, np.int64)]), pa.int64()),
                    pa.concat_arrays([nothing, pa.array(most, pa.int32())]),
                    pa.concat_arrays([nothing, pa.array(least, pa.int32())]),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(n_blocks, np.int64), offsets]), pa.int32()), hits),
                ],
                names=schema.names,
            )
            made += n_blocks

    rows = toks.mapInArrow(pack, schema)
    if vocabulary is None or sent is not None:
        return rows
    marked = rows.join(vocabulary.select("term", F.lit(True).alias("_known")), "term", "left")
    return marked.where("term IS NULL OR _known").select(*schema.names)


def postings_stats(postings: DataFrame) -> DataFrame:
    """(doc_type, n_docs, avg_len): articles and annexes are two indexes."""
    blocks = postings.where("term IS NULL").groupBy("doc_type").agg(F.sum("n").alias("n_docs"), F.sum("total_len").alias("_len"))
    return blocks.select("doc_type", "n_docs", (F.col("_len") / F.col("n_docs")).alias("avg_len"))


def _part(tf: str, length: str) -> Column:
    """A term's share of a score; it grows with the count and falls with the length."""
    f = F.col(tf)
    return F.col("idf") * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col(length) / F.col("avg_len")))


def _asked(q: DataFrame, corpus: DataFrame, expansions: dict[str, list[str]], postings: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Index rows of the terms asked for (and those of whole blocks), a row per question term and kind
    with its weights, and the question terms."""
    terms = written(query_terms(q, expansions), "terms")
    vocabulary = terms.select("term").distinct()
    if postings is None:
        rows = build_postings(corpus, vocabulary)
    else:
        rows = postings.where("term IS NULL").unionByName(postings.join(vocabulary, "term", "left_semi").select(*postings.columns))
    rows = written(rows, "postings")
    idf = F.log((F.col("n_docs") - F.col("n_hits") + 0.5) / (F.col("n_hits") + 0.5))
    found = rows.where("term IS NOT NULL").groupBy("doc_type", "term").agg(F.sum("n").alias("n_hits"))
    weights = found.join(postings_stats(rows), "doc_type").withColumn("_idf", idf)
    weights = weights.select("doc_type", "term", "avg_len", F.when(F.col("_idf") <= 0, F.lit(IDF_FLOOR)).otherwise(F.col("_idf")).alias("idf"))
    return rows, terms.join(weights, "term"), terms


def bm25_scores(
    q: DataFrame,
    corpus: DataFrame,
    expansions: dict[str, list[str]] = EXPANSIONS,
    scope: DataFrame | None = None,
    postings: DataFrame | None = None,
) -> DataFrame:
    """(question_id, doc_type, doc_id, version_id, score) for every match.

    The corpus is read and cut into tokens once; of it only the index rows of the questions' terms are
    written, statistics come from there. Index rows lie by block, so that pairs are summed where they
    arise and never travel. Statistics cover the whole corpus; ``scope`` (question_id, version_id) limits
    what is scored: versions outside it go before any pair is made. The small sides are written tables,
    so Spark's own size check decides whether they are broadcast.
    """
    rows, ask, _ = _asked(q, corpus, expansions, postings)
    ask = written(ask, "ask")
    placed = rows.where("term IS NOT NULL").select("doc_type", "block", "term", F.explode("hits").alias("_h")).select("*", "_h.*").drop("_h")
    # as many tasks as keep the pairs of one of them, and the memory they are summed in, within bounds
    asks = ask.groupBy("doc_type", "term").agg(F.count(F.lit(1)).alias("_asks"))
    pairs = rows.where("term IS NOT NULL").groupBy("doc_type", "term").agg(F.sum("n").alias("_n")).join(asks, ["doc_type", "term"])
    pairs = pairs.agg(F.coalesce(F.sum(F.col("_n") * F.col("_asks")), F.lit(0))).first()[0]
    placed = placed.repartition(int(min(100_000, max(q.sparkSession.sparkContext.defaultParallelism, pairs // TASK_PAIRS))), "doc_type", "block")
    if scope is not None:
        scope = written(scope.select("question_id", "version_id").distinct(), "scope")
        placed = placed.join(scope.select("version_id").distinct(), "version_id", "left_semi")
    matches = placed.join(ask, ["doc_type", "term"])
    if scope is not None:
        matches = matches.join(scope, ["question_id", "version_id"], "left_semi")
    keys = ["doc_type", "block", "doc_id", "version_id", "question_id"]
    f = F.col("tf")
    part = F.col("idf") * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    whole = matches.groupBy(*keys, "phrase", "phrase_size", "weight").agg(F.count(F.lit(1)).alias("_n"), F.sum(part).alias("_s"))
    whole = whole.where(F.col("_n") == F.col("phrase_size"))
    scores = whole.groupBy(*keys).agg(F.round(F.sum(F.col("_s") * F.col("weight")), DIGITS).alias("score"))
    return scores.select("question_id", "doc_type", "doc_id", "version_id", "score")


def _join(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of equal values; ``right`` is sorted."""
    begin, end = np.searchsorted(right, left), np.searchsorted(right, left, "right")
    n = end - begin
    of = np.repeat(np.arange(left.size), n)
    return of, np.arange(of.size) - np.repeat(np.cumsum(n) - n, n) + begin[of]


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the sums and numbers of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, np.int64)
    sums = np.add.reduceat(values[order], starts) if starts.size else np.zeros(0)
    return keys[starts], sums, np.diff(np.append(starts, keys.size))


class _Cell:
    """Index rows of one kind and some blocks, and the terms of some questions. Rows of one document in
    several blocks are one document, or one in each of them (``apart``)."""

    def __init__(self, rows: pa.Table, ask: pa.Table, versions: pa.Table | None, apart: bool = False) -> None:
        self.rows, self.ask = rows, ask
        code = lambda c: (e := c.combine_chunks().dictionary_encode("encode"), np.asarray(e.indices))
        _, term = code(pa.chunked_array([*rows.column("term").chunks, *ask.column("term").chunks]))
        self.row_term, ask_term = term[: rows.num_rows], term[rows.num_rows :]
        self.questions, question = code(ask.column("question_id"))
        phrases, phrase = code(ask.column("phrase"))
        number = lambda t, c, kind=float: np.asarray(t.column(c), kind)
        # a phrase's terms, once for all questions
        self.width = len(phrases.dictionary)
        part, at = np.unique(phrase.astype(np.int64) << 32 | ask_term, return_index=True)
        self.part_phrase, self.part_term = part >> 32, part & 0xFFFFFFFF
        self.idf, self.average = number(ask, "idf")[at], number(ask, "avg_len")[at]
        self.size = np.zeros(self.width, np.int64)
        self.size[phrase] = number(ask, "phrase_size", np.int64)
        # a question's phrases, in order of the phrase
        own, at = np.unique(phrase.astype(np.int64) << 32 | question, return_index=True)
        self.asks, self.asked_by, self.weight = own >> 32, own & 0xFFFFFFFF, number(ask, "weight")[at]
        self.blocks, self.row_block = np.unique(number(rows, "block", np.int64), return_inverse=True)
        hits = rows.column("hits").combine_chunks()
        self.hits = hits.flatten()
        self.hit_row = np.repeat(np.arange(rows.num_rows), np.diff(np.asarray(hits.offsets)))
        key = pa.table({"d": self.hits.field(0), "v": self.hits.field(1), "b": self.row_block[self.hit_row]}).to_pandas()
        self.doc = key.groupby(["d", "v", "b"] if apart else ["d", "v"], sort=True, dropna=False).ngroup().to_numpy()
        self.n_docs = int(self.doc.max(initial=-1)) + 1
        self.shown = np.zeros(self.n_docs, np.int64)
        self.shown[self.doc] = np.arange(self.doc.size)
        self.allowed = None
        if versions is not None:
            named, version = code(pa.chunked_array([self.hits.field(1), *versions.column("version_id").chunks]))
            _, asker = code(pa.chunked_array([self.questions.dictionary, *versions.column("question_id").chunks]))
            self.allowed = np.zeros((len(self.questions.dictionary) + versions.num_rows, len(named.dictionary)), bool)
            self.allowed[asker[len(self.questions.dictionary) :], version[self.doc.size :]] = True
            self.doc_version = np.zeros(self.n_docs, np.int64)
            self.doc_version[self.doc] = version[: self.doc.size]

    def _parts(self, part: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[part] * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / self.average[part]))

    def bounds(self) -> np.ndarray:
        """Per question and block what no document of it exceeds; 0 without a match."""
        order = np.argsort(self.row_term, kind="stable")
        part, at = _join(self.part_term, self.row_term[order])
        row = order[at]
        most = self._parts(part, np.asarray(self.rows.column("max_tf"), float)[row], np.asarray(self.rows.column("min_len"), float)[row])
        n = self.blocks.size
        key, bound, count = _sums(self.part_phrase[part] * n + self.row_block[row], most)
        whole = count == self.size[key // n]
        of, by = _join(key[whole] // n, self.asks)
        place = self.asked_by[by] * n + (key[whole] % n)[of]
        # what the order of a sum leaves behind must not skip a block
        summed = np.bincount(place, bound[whole][of] * self.weight[by], len(self.questions.dictionary) * n) * (1 + 1e-9)
        return summed.reshape(-1, n)

    def entries(self) -> None:
        """Shares of the documents' scores by block and phrase, for phrases of which every term is there."""
        order = np.argsort(self.row_term[self.hit_row], kind="stable")
        part, at = _join(self.part_term, self.row_term[self.hit_row][order])
        hit = order[at]
        if self.allowed is not None:
            open_ = self.allowed.any(axis=0)[self.doc_version[self.doc[hit]]]
            part, hit = part[open_], hit[open_]
        tf, length = (np.asarray(self.hits.field(c), float)[hit] for c in (3, 2))
        key, share, count = _sums(self.part_phrase[part] * self.n_docs + self.doc[hit], self._parts(part, tf, length))
        whole = count == self.size[key // self.n_docs]
        key, self.share = key[whole], share[whole]
        doc_block = np.zeros(self.n_docs, np.int64)
        doc_block[self.doc] = self.row_block[self.hit_row]
        phrase, doc = key // self.n_docs, key % self.n_docs
        self.block_docs = int(np.bincount(doc_block, minlength=1).max())
        place = doc_block[doc] * self.width + phrase
        order = np.argsort(place, kind="stable")
        self.place, self.entry_doc, self.share = place[order], doc[order], self.share[order]
        self.by_question = np.argsort(self.asked_by, kind="stable")

    def score(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions, documents and scores of the chosen (question, block), some of them at a time."""
        question, block = np.nonzero(chosen)
        n_asks = np.bincount(self.asked_by, minlength=len(chosen))[question]
        # a block's shares bound what it unfolds for a question, as does each phrase with its documents
        held = np.bincount(self.place // self.width, minlength=self.blocks.size)[block]
        cost = np.cumsum(n_asks + np.minimum(held, n_asks * np.int64(self.block_docs)))
        found, at = [], 0
        while at < question.size:
            end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + HELD_SHARES, "right")))
            found.append(self._score(question[at:end], block[at:end]))
            at = end
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _score(self, question: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for a list of (question, block)."""
        pair, at = _join(question, self.asked_by[self.by_question])
        ask = self.by_question[at]
        met, entry = _join(block[pair] * self.width + self.asks[ask], self.place)
        doc, who = self.entry_doc[entry], question[pair][met]
        value = self.share[entry] * self.weight[ask[met]]
        if self.allowed is not None:
            keep = self.allowed[who, self.doc_version[doc]]
            doc, who, value = doc[keep], who[keep], value[keep]
        key, score, _ = _sums(who * max(1, self.n_docs) + doc, value)
        return key // max(1, self.n_docs), key % max(1, self.n_docs), np.round(score, DIGITS)

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best documents of each question. Blocks are scored in order of their bound, twice as
        many a round, until no bound reaches a question's k-th best score."""
        bounds = self.bounds()
        self.entries()
        order = np.argsort(-bounds, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(bounds.shape[1])[None, :].repeat(len(bounds), 0), 1)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        least, done, step = np.full(len(bounds), -np.inf), 0, SEED_BLOCKS
        while (chosen := (bounds > 0) & (bounds >= least[:, None]) & (rank >= done)).any():
            more = self.score(chosen & (rank < done + step))
            found = tuple(np.concatenate(x) for x in zip(found, more))
            by = np.lexsort((found[1], -found[2], found[0]))
            found = tuple(x[by] for x in found)
            new = np.append(True, found[0][1:] != found[0][:-1]) if found[0].size else np.zeros(0, bool)
            place = np.arange(new.size) - np.maximum.accumulate(np.where(new, np.arange(new.size), 0))
            least[found[0][place == k - 1]] = found[2][place == k - 1]
            found = tuple(x[place < k] for x in found)
            done, step = done + step, step * 2
        return found

    def best_by_version(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best documents of each question and version."""
        chosen = self.bounds() > 0
        self.entries()
        question, doc, score = self.score(chosen)
        group = question * self.allowed.shape[1] + self.doc_version[doc]
        by = np.lexsort((doc, -score, group))
        group = group[by]
        new = np.append(True, group[1:] != group[:-1]) if group.size else np.zeros(0, bool)
        by = by[np.arange(new.size) - np.maximum.accumulate(np.where(new, np.arange(new.size), 0)) < k]
        return question[by], doc[by], score[by]


def bm25_topk(
    q: DataFrame,
    corpus: DataFrame,
    k: int,
    expansions: dict[str, list[str]] = EXPANSIONS,
    version_filter: DataFrame | None = None,
    postings: DataFrame | None = None,
) -> DataFrame:
    """K1: best ``k`` articles and best ``k`` annexes per question.

    Blocks of the index and questions meet in a grid of cells of bounded size. In a cell the blocks with
    the highest bounds are scored first; a question's k-th best score is a threshold that grows, and a
    block whose bound does not reach it is never unfolded for that question. A cell returns its best ``k``.
    """
    rows, ask, terms = _asked(q, corpus, expansions, postings)
    across = max(1, -(-rows.where("term IS NULL").count() // CELL_BLOCKS))
    index, asked = _grid(rows, ask, terms, corpus, across, version_filter)
    found = _meet(index, asked, q, corpus, lambda cell: cell.best(k), version_filter is not None)
    ranked = top_k(found, ["question_id", "doc_type"], [F.desc("score"), F.asc("doc_id")], k)
    return ranked.withColumn("bm25_rank", -F.col("score"))


def bm25_candidates(
    q: DataFrame,
    corpus: DataFrame,
    k: int,
    scope: DataFrame,
    expansions: dict[str, list[str]] = EXPANSIONS,
    postings: DataFrame | None = None,
) -> DataFrame:
    """(question_id, doc_type, doc_id, version_id, score): per kind the best ``k`` documents of each question
    and version of ``scope`` (question_id, version_id) are among them.

    Index and questions meet in cells as in ``bm25_topk``. A cell holds a bounded number of hits, scores every
    document of the versions asked for and gives away the best only, so that no other pair leaves it.
    """
    rows, ask, terms = _asked(q, corpus, expansions, postings)
    size = rows.agg(F.count_if(F.col("term").isNull()).alias("blocks"), F.sum(F.when(F.col("term").isNotNull(), F.col("n"))).alias("hits")).first()
    cores = q.sparkSession.sparkContext.defaultParallelism
    across = max(1, min(size.blocks, max(cores, -(-(size.hits or 0) // CELL_HITS))))
    index, asked = _grid(rows, ask, terms, corpus, across, scope)
    tasks = int(min(100_000, max(cores, 2 * across)))
    index, asked = (df.repartition(tasks, *CELL) for df in (index, asked))
    return _meet(index, asked, q, corpus, lambda cell: cell.best_by_version(k), True, apart=True)


CELL = ["doc_type", "_x", "_y"]


def _grid(rows: DataFrame, ask: DataFrame, terms: DataFrame, corpus: DataFrame, across: int, scope: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Index rows and question terms of each cell: ``across`` parts of the blocks, parts of ``CELL_QUESTIONS``."""
    down = max(1, -(-terms.select("question_id").distinct().count() // CELL_QUESTIONS))
    here = F.pmod(F.xxhash64("block"), F.lit(across)).cast("int").alias("_x")
    there = F.pmod(F.xxhash64("question_id"), F.lit(down)).cast("int").alias("_y")
    cells, lines = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (across, down))
    version = corpus.schema["version_id"].dataType.simpleString()
    asked = ask.withColumn("version_id", F.lit(None).cast(version))
    if scope is not None:
        # a question's versions come as rows without a term, for both kinds
        kinds = ask.select("question_id", "doc_type").distinct()
        scope = scope.select("question_id", F.col("version_id").cast(version).alias("version_id")).where("version_id IS NOT NULL").distinct()
        asked = asked.unionByName(scope.join(kinds, "question_id"), allowMissingColumns=True)
    asked = written(asked, "ask")
    index = rows.where("term IS NOT NULL").select("doc_type", "block", "term", "max_tf", "min_len", "hits", here, lines.alias("_y"))
    return index, asked.select("*", there, cells.alias("_x"))


def _meet(
    index: DataFrame, asked: DataFrame, q: DataFrame, corpus: DataFrame, best: Callable[[_Cell], tuple[np.ndarray, np.ndarray, np.ndarray]], scoped: bool, apart: bool = False
) -> DataFrame:
    """What ``best`` finds in each cell."""
    schema = T.StructType([q.schema["question_id"], *(corpus.schema[c] for c in ("doc_type", "doc_id", "version_id")), T.StructField("score", T.DoubleType())])
    empty = to_arrow_schema(schema).empty_table()

    def search(index: pa.Table, questions: pa.Table) -> pa.Table:
        wanted = questions.filter(pc.is_valid(questions.column("term")))
        versions = questions.filter(pc.is_null(questions.column("term"))) if scoped else None
        if not index.num_rows or not wanted.num_rows:
            return empty
        cell = _Cell(index, wanted, versions, apart)
        question, doc, score = best(cell)
        at = pa.array(cell.shown[doc])
        kind = index.column("doc_type").combine_chunks().take(pa.array(np.zeros(doc.size, np.int64)))
        return pa.table([cell.questions.dictionary.take(pa.array(question)), kind, cell.hits.field(0).take(at), cell.hits.field(1).take(at), pa.array(score)], names=schema.names)

    return index.groupBy(*CELL).cogroup(asked.groupBy(*CELL)).applyInArrow(search, schema)


# --- vectors ---------------------------------------------------------------------------------

# Questions meet a block of vectors in blocks of at most this many bytes.
BLOCK_BYTES = 64 * 1024 * 1024
# Bytes of unit vectors that each side brings to one meeting, and distances held at a time.
CELL_BYTES = 4 * 1024 * 1024
HELD_DISTANCES = 2_000_000


def _unit(rows) -> np.ndarray:
    m = np.asarray(np.stack([np.asarray(r, dtype=np.float64) for r in rows]))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    norm[norm == 0] = 1.0
    return m / norm


def _nearest(asks: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, distance) of the ``k`` nearest rows of each question; on ties the earlier row."""
    distance = 1.0 - asks @ rows.T
    # at least ``k`` rows are within the k-th least of the minima of stretches; NaN is never beyond it
    stretch = max(1, len(rows) // (4 * k))
    least = np.fmin.reduce(distance[:, : len(rows) // stretch * stretch].reshape(len(asks), -1, stretch), axis=2)
    bound = np.partition(least, k - 1, axis=1)[:, k - 1 : k] if least.shape[1] > k else np.inf
    q, r = np.nonzero(~(distance > bound + 10.0**-DIGITS))
    found = np.round(distance[q, r], DIGITS) + 0.0
    order = np.lexsort((r, found, q))
    q, r, found = q[order], r[order], found[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[place < k], r[place < k], found[place < k]


def vector_candidates(
    queries: DataFrame, corpus: DataFrame, k: int, scope: DataFrame | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Exact best-k candidates per meeting: a superset of every question's best k.

    ``corpus`` is (version_id, vec_id, vector), with ``doc_type`` where kinds share numbers; the kind
    is part of a vector's key and comes back. With a ``scope`` (question_id, version_id) the best k of
    each (question, version) are among them.

    Questions and vectors are dealt into blocks of ``CELL_BYTES``, per version where there is a scope, and
    every block of questions meets every block of vectors in a grid; nothing passes through the driver.
    """
    kinds = ["doc_type"] if "doc_type" in corpus.columns else []
    schema = T.StructType(
        [
            T.StructField("question_id", queries.schema["question_id"].dataType),
            *[corpus.schema[c] for c in ("version_id", *kinds, "vec_id")],
            T.StructField("distance", T.DoubleType()),
        ]
    )
    asks, rows = queries.select("question_id", "vector"), corpus.select("version_id", *kinds, "vec_id", "vector")
    if scope is None:
        asks, rows = asks.withColumn("_of", F.lit(0)), rows.withColumn("_of", F.lit(0))
    else:
        of = F.col("version_id").cast(corpus.schema["version_id"].dataType).alias("_of")
        asks = asks.join(scope.select("question_id", of).distinct(), "question_id")
        rows = rows.withColumn("_of", F.col("version_id"))
    width = F.greatest(F.lit(1), F.floor(F.lit(CELL_BYTES) / F.greatest(F.lit(1), 8 * F.max(F.size("vector")))))
    blocks = lambda df, n: df.groupBy("_of").agg(F.ceil(F.count(F.lit(1)) / width).cast("int").alias(n))
    sizes = written(blocks(asks, "_na").join(blocks(rows, "_nb"), "_of"), "blocks")
    cells = sizes.agg(F.coalesce(F.sum(F.col("_na").cast("long") * F.col("_nb")), F.lit(0))).first()[0]
    tasks = int(min(100_000, max(queries.sparkSession.sparkContext.defaultParallelism, cells)))
    cell = ["_of", "_a", "_b"]

    def dealt(df: DataFrame, key: list[str], own: str, n: str, other: str, m: str) -> DataFrame:
        block = F.pmod(F.xxhash64(*key, "vector"), F.col(n)).cast("int").alias(own)
        return df.join(sizes, "_of").select(*df.columns, block, F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other)).repartition(tasks, *cell)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            right = right.take(pc.sort_indices(right, sort_keys=[(c, "ascending") for c in ("vec_id", *kinds)], null_placement="at_start"))
            matrix = _unit(right["vector"].to_pylist())
            step = min(block_bytes // (8 * (matrix.shape[1] + 1)), HELD_DISTANCES // len(matrix))
            found = []
            for at in range(0, left.num_rows, max(1, step)):
                part = left["vector"].slice(at, max(1, step))
                q, r, distance = _nearest(_unit(part.to_pylist()), matrix, k)
                found.append((q + at, r, distance))
            q, r, distance = (np.concatenate(x) for x in zip(*found))
        else:
            q, r, distance = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        out = {"question_id": left["question_id"].take(q), **{c: right[c].take(r) for c in ("version_id", *kinds, "vec_id")}, "distance": pa.array(distance)}
        return pa.table({c: out[c] for c in schema.names})

    left = dealt(asks, ["question_id"], "_a", "_na", "_b", "_nb").groupBy(*cell)
    right = dealt(rows, [*kinds, "vec_id"], "_b", "_nb", "_a", "_na").groupBy(*cell)
    return left.cogroup(right).applyInArrow(meet, schema)


def vector_topk(
    queries: DataFrame, corpus: DataFrame, k: int, scope: DataFrame | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """K2: nearest ``k`` vectors per question by cosine distance, exact; ties by id, then kind."""
    found = vector_candidates(queries, corpus, k, scope, block_bytes)
    kinds = [F.asc("doc_type")] if "doc_type" in found.columns else []
    return top_k(found, ["question_id"], [F.asc("distance"), F.asc("vec_id"), *kinds], k)


# --- hybrid ----------------------------------------------------------------------------------

FULL_BUDGETS = {"tier1_primary": 30, "tier2_secondary": 15}
FAST_BUDGETS = {"tier1_primary": 15, "tier2_secondary": 5}
LEAST_PER_LAW = 5


def law_budgets(scope: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """Scope rows (question_id, tier, law_id, law_order, version_id) with their per-law budget."""
    n_laws = scope.groupBy("question_id", "tier").agg(F.count_distinct("law_id").alias("_n"))
    whole = X.lookup(budgets, F.col("tier"))
    return (
        scope.join(n_laws, ["question_id", "tier"])
        .withColumn("budget", F.greatest(F.lit(LEAST_PER_LAW), F.floor(whole / F.col("_n")).cast("int")))
        .where(whole.isNotNull())
        .drop("_n")
    )


def hybrid_retrieve(
    q: DataFrame,
    scope: DataFrame,
    corpus: DataFrame,
    queries: DataFrame,
    vectors: DataFrame,
    budgets: dict[str, int] = FULL_BUDGETS,
) -> DataFrame:
    """K3: per tier and law the best of BM25 and of vectors, united, first one seen kept.

    ``vectors`` holds (doc_type, vec_id = doc_id, version_id, vector). Arrival order: tier, law,
    BM25 articles, BM25 annexes, vectors.
    """
    plan = law_budgets(scope, budgets)
    ceiling = max(LEAST_PER_LAW, *budgets.values())
    tier_no = X.lookup({t: i for i, t in enumerate(budgets)}, F.col("tier"))
    group = ["question_id", "tier", "law_id"]
    versions = scope.select("question_id", "version_id").distinct()

    lexical = bm25_candidates(q, corpus, ceiling, versions).join(plan, ["question_id", "version_id"])
    lexical = top_k_by(lexical, [*group, "doc_type"], [F.desc("score"), F.asc("doc_id")], F.col("budget"), ceiling).select(
        *group, "law_order", "doc_type", "doc_id", "version_id", "rank",
        F.when(F.col("doc_type") == "article", 0).otherwise(1).alias("_src"),
        (-F.col("score")).alias("bm25_rank"), F.lit(None).cast("double").alias("distance"), F.lit("bm25").alias("source"),
    )
    semantic = vector_candidates(queries, vectors, ceiling, versions).join(plan, ["question_id", "version_id"])
    semantic = (
        top_k_by(semantic, group, [F.asc("distance"), F.asc("vec_id"), F.asc("doc_type")], F.col("budget"), ceiling)
        .withColumnRenamed("vec_id", "doc_id")
        .select(
            *group, "law_order", "doc_type", "doc_id", "version_id", "rank", F.lit(2).alias("_src"),
            F.lit(None).cast("double").alias("bm25_rank"), "distance", F.lit("semantic").alias("source"),
        )
    )
    both = lexical.unionByName(semantic).withColumn("arrival", F.struct(tier_no.alias("t"), "law_order", "law_id", "_src", "rank"))
    kept = first_seen(both.drop("law_order", "rank", "_src"), ["question_id", "doc_type", "doc_id"], ["arrival"])
    return kept.withColumn("role", F.when(F.col("tier") == "tier1_primary", "PRIMARY").otherwise("SECONDARY"))


def entity_retrieve(
    q_entities: DataFrame,
    corpus: DataFrame,
    scope: DataFrame,
    seen: DataFrame | None = None,
    keywords: dict[str, list[str]] = ENTITY_KEYWORDS,
    k: int = 10,
) -> DataFrame:
    """K4: one more search per keyword of each entity (question_id, entity_order, entity), best 10
    each, in the primary versions ``scope``; hits already ``seen`` are left out."""
    table = F.create_map(*[x for e, ks in keywords.items() for x in (F.lit(e), F.array(*[F.lit(w) for w in ks]))])
    derived = q_entities.select(
        "question_id", "entity_order", "entity", F.posexplode(F.try_element_at(table, F.upper("entity"))).alias("kw_order", "text")
    ).withColumn("_sub", F.struct("question_id", "entity_order", "kw_order"))
    asks = derived.select(F.col("_sub").alias("question_id"), "text")
    allowed = derived.select("question_id", "_sub").distinct().join(scope.select("question_id", "version_id").distinct(), "question_id")
    scores = bm25_scores(asks, corpus, scope=allowed.select(F.col("_sub").alias("question_id"), "version_id"))
    best = top_k(scores, ["question_id", "doc_type"], [F.desc("score"), F.asc("doc_id")], k).withColumnRenamed("question_id", "_sub")
    named = best.join(derived.select("_sub", "entity").distinct(), "_sub").select(
        F.col("_sub.question_id").alias("question_id"), "doc_type", "doc_id", "version_id",
        F.concat(F.lit("entity:"), F.col("entity")).alias("source"), F.lit("entity_targeted").alias("tier"),
        F.lit("PRIMARY").alias("role"), (-F.col("score")).alias("bm25_rank"),
        F.struct("_sub.entity_order", "_sub.kw_order", F.when(F.col("doc_type") == "article", 0).otherwise(1).alias("t"), "rank").alias("arrival"),
    )
    out = first_seen(named, ["question_id", "doc_type", "doc_id"], ["arrival"])
    if seen is not None:
        out = out.join(seen.select("question_id", "doc_type", "doc_id").distinct(), ["question_id", "doc_type", "doc_id"], "left_anti")
    return out.drop("arrival")


def amendment_lines(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """K5: the lines ``[Amendment: …]`` that follow each hit's article text, in note order.

    One row per line, so an article with very many notes stays spread over the cluster.
    """
    said = notes.where(X.strip_space(F.coalesce(F.col("text"), F.lit(""))) != "").select(
        "article_id", "note_id", F.concat(F.lit("[Amendment: "), X.strip_space(F.col("text")), F.lit("]")).alias("line")
    )
    articles = hits.where("doc_type = 'article'").select("question_id", F.col("doc_id").alias("article_id")).distinct()
    return articles.join(said, "article_id").select("question_id", "article_id", "note_id", "line")


EXPANSION_INPUT = 30


def cap_hits(hits: DataFrame, n: int = EXPANSION_INPUT) -> DataFrame:
    """K6: the ``n`` hits with the smallest distance per question; a missing distance counts as 1."""
    order = [F.coalesce(F.col("distance"), F.lit(1.0)).asc(), F.col("arrival").asc()]
    return top_k(hits, ["question_id"], order, n, "_r").drop("_r")


# --- rerank ----------------------------------------------------------------------------------

ROLE_BOOST = 0.15


def fallback_score(distance: Column, bm25_rank: Column) -> Column:
    """Score from the retrieval signals: distance first, then BM25, else one half."""
    s = F.greatest(-bm25_rank, F.lit(0.0))
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), 1 - distance / 2)).when(bm25_rank.isNotNull(), s / (1 + s)).otherwise(0.5)


def dynamic_k(n_issues: Column) -> Column:
    """K9."""
    return F.least(F.lit(20), 5 + 5 * n_issues)


def rerank(
    hits: DataFrame,
    scores: DataFrame | None = None,
    k: int | Column = 25,
    boost: float = ROLE_BOOST,
    ceiling: int = 20,
) -> DataFrame:
    """K8: given scores where present, else the fallback; primary laws get a boost; best k stay.

    Every score given in ``scores`` (question_id, doc_type, doc_id, model_score) counts. ``k`` may be a
    column of ``hits``, at most ``ceiling``.
    """
    keys = ["question_id", "doc_type", "doc_id"]
    base = fallback_score(F.col("distance"), F.col("bm25_rank"))
    if scores is None:
        scored = hits.withColumn("_s", base)
    else:
        scored = hits.join(scores.select(*keys, "model_score"), keys, "left").withColumn("_s", F.coalesce("model_score", base)).drop("model_score")
    boosted = scored.withColumn(
        "reranker_score", F.round(F.col("_s") + F.when(F.col("role") == "PRIMARY", boost).otherwise(0.0), DIGITS)
    ).drop("_s")
    order = [F.desc("reranker_score"), F.asc("arrival")]
    if isinstance(k, int):
        return top_k(boosted, ["question_id"], order, k)
    return top_k_by(boosted, ["question_id"], order, k, ceiling)


def fetch_governing_norm(needs: DataFrame, exact: DataFrame, queries: DataFrame, vectors: DataFrame, q: DataFrame, corpus: DataFrame, scope: DataFrame) -> DataFrame:
    """Exact reference, else the five nearest vectors, else the five best by BM25.

    ``needs`` (question_id, …) one row per issue lacking its norm; ``exact`` what J25 fetched for it
    (question_id, doc_type, doc_id); questions without a vector fall through to BM25.
    """
    hit = exact.select("question_id", "doc_type", "doc_id", F.lit("exact").alias("strategy"))
    rest = needs.select("question_id").distinct().join(hit.select("question_id").distinct(), "question_id", "left_anti")
    near = (
        vector_topk(queries.join(rest, "question_id", "left_semi"), vectors, 5, scope)
        .select("question_id", "doc_type", F.col("vec_id").alias("doc_id"), F.lit("semantic").alias("strategy"))
    )
    last = rest.join(queries.select("question_id").distinct(), "question_id", "left_anti")
    lex = bm25_topk(q.join(last, "question_id", "left_semi"), corpus, 5, version_filter=scope).select(
        "question_id", "doc_type", "doc_id", F.lit("bm25").alias("strategy")
    )
    return hit.unionByName(near).unionByName(lex)


