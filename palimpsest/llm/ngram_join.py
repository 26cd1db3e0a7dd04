"""Exact Jaccard self-join of word n-gram sets by partition of the universe.

Sets fall into size bands. A band's scheme hashes every token of the universe to one of its segments.
If two sets are similar enough their symmetric difference is at most ``H`` tokens, so among segments
whose levels add up to ``H + 1`` one must agree: level 1 by equal content, level 2 (a segment with a
one-deletion neighbourhood) also when one side holds one token more. How many segments of either
level a scheme has is chosen by the rows they cost against the empty segments to be expected.

A set is indexed under the scheme of its band, and under the scheme below if a smaller partner may
lie there; the smaller set of a pair asks. Sets are nested: a set of ``n`` tokens needs only the first
segments that cover its own bound. What is shared by nobody costs nothing; where a set shares
segments with sets of other components, it asks by its cheapest segments only, by the sizes they
really have, until the levels add up. Small sets index their empty segments too; a larger set that
cannot do without them (it would have to lose far more segments than chance allows) sends its empty
segments in a pass of their own.

Equal sets are one node from the start. First each set is compared with a pivot that shares most
segments with it, and segments whose sets all lie in one component are left out. What is still asked
for falls into families: sets that share a segment asked for with the same first set. A family is cut into blocks by hash; a
task takes two blocks, counts all shared tokens at once, and hands on only links that join components.
So a large group of near copies costs neither a row per pair nor a task that holds all of it. The
result is the components of all links.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A text with fewer words than ``n`` is one
shingle; a text without words (or null) has no shingles and links with nothing. Shingles stand as
64-bit digests. Repeated rows, repeated and null ids are fine: rows keep their number, and a
component's id is its smallest id that is not null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import distinct, slices, utf8
from palimpsest.llm.components import components
from palimpsest.session import written

N = 5
#: Similarity in hundredths.
LEAST = 80
#: Growth of the size bands; cost of an indexed empty segment in index rows; nodes that a task remembers.
BAND = 1.6
EMPTY_COST = 30.0
REMEMBERED = 1 << 20
#: Bands up to this many tokens index empty segments; a larger set lacks levels with this chance at most.
SMALL = 150
RARE = 1e-7
#: A row's place: 1 for a deletion, twice the segment, and from this bit on the scheme.
SCHEME_BIT = 25
#: Sets of a block, and tokens that a task counts at a time.
BLOCK = 512
COLUMNS = 4096
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 20

_GAP = re.compile(rb"[ \t-\r]")

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    x = (x ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base of the words' hash, and of its inverse modulo two to the 64th."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, size: int) -> None:
        if self.up.size < size:
            base = int(_ODD[2])
            both = []
            for factor in (base, pow(base, -1, 1 << 64)):
                steps = np.full(2 * size, factor, np.uint64)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            self.up, self.down = both


def word_hashes(text: bytes, powers: _Powers) -> np.ndarray:
    """Hashes of the words of a text, lower-cased, from running sums over its bytes; long texts by pieces."""
    out, at = [], 0
    while at < len(text) or not out:
        end = at + PIECE
        if end < len(text):
            gap = _GAP.search(text, end)  # never inside a word
            end = gap.start() if gap else len(text)
        out.append(_piece_hashes(np.frombuffer(text[at:end], np.uint8), powers))
        at = end
    return np.concatenate(out) if len(out) > 1 else out[0]


def _piece_hashes(raw: np.ndarray, powers: _Powers) -> np.ndarray:
    powers.reach(raw.size + 1)
    low = _LOWER[raw]
    gap = np.ones(raw.size + 2, bool)
    gap[1:-1] = _SPACE[low]
    change = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = change[::2], change[1::2]
    sums = np.zeros(raw.size + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers.up[: raw.size], out=sums[1:])
    return mix((sums[end] - sums[start]) * powers.down[start] + (end - start).astype(np.uint64))


def shingles(text: bytes, powers: _Powers, n: int = N) -> np.ndarray:
    """The set of a text, as sorted digests."""
    ids = word_hashes(text, powers)
    if not ids.size:
        return ids
    size = min(n, ids.size)
    last = ids.size - size + 1
    out = np.full(last, size, np.uint64)
    for k in range(size):
        out = out * _ODD[3] + ids[k : last + k] * _ODD[k % 5]
    return distinct(mix(out))


def node_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def links(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """100 * intersection >= least * union, in integers."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= least * (a.size + b.size - both)


@dataclass(frozen=True)
class Scheme:
    """Segments ``0 .. segments - 1`` for pairs whose smaller set has ``low .. high`` tokens; the first
    ``double`` ones have deletion neighbourhoods."""

    number: int
    low: int
    high: int
    segments: int
    double: int


def _most(mean: float) -> int:
    """The number that a count with this mean (of rare events) passes with a chance of ``RARE`` at most."""
    if mean > 30:
        spread = math.sqrt(2 * math.log(1 / RARE))
        return math.ceil(mean + spread * math.sqrt(mean) + spread * spread / 6)
    term = total = math.exp(-mean)
    k = 0
    while 1 - total > RARE and k < 200:
        k += 1
        term *= mean / k
        total += term
    return k


class Schemes:
    def __init__(self, least: int, band: float = BAND) -> None:
        self.least, self.band = least, band
        self.edges, self.made, self.enough = [1], {}, {}

    def partner(self, n: int) -> int:
        """The most tokens that a partner of a set of ``n`` can have."""
        return n * 100 // self.least

    def bound(self, n: int) -> int:
        """The most tokens in which a set of ``n`` and a larger partner can differ."""
        return (n + self.partner(n)) * (100 - self.least) // (100 + self.least)

    def number(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * self.band)))
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def levels(self, count: int, double: int, load: float) -> int:
        """Levels of ``count`` segments, the first ``double`` of two, that are there for sure but for a rare
        chance, if a segment has ``load`` tokens in the mean."""
        two = min(count, double)
        none, one = math.exp(-load), load * math.exp(-load)
        lost = _most(none * (count - two)) + 2 * _most(none * two) + _most(one * two)
        return count + two - lost

    def scheme(self, number: int) -> Scheme:
        if number not in self.made:
            while len(self.edges) < number + 2:
                self.number(self.edges[-1])
            low, high = self.edges[number], self.edges[number + 1] - 1
            need, middle = self.bound(high) + 2, math.sqrt(low * high)

            def segments_with(double: int) -> int:
                count = max(1, double, need - double)
                if high <= SMALL:
                    return count
                while self.levels(count, double, high / count) < need and count < 4 * need:
                    count += max(1, need // 100)
                return count

            def cost(double: int) -> float:
                load = middle / segments_with(double)
                empty = EMPTY_COST * math.exp(-load) if high <= SMALL else 0  # only these are rows, in large groups
                return segments_with(double) * (1 + empty) + double * load

            double = min(sorted({need * k // 64 for k in range(33)}), key=cost)
            self.made[number] = Scheme(number, low, high, segments_with(double), double)
        return self.made[number]

    def taken(self, n: int) -> int:
        """How many of its band's segments a set of ``n`` takes; never fewer for a larger set."""
        scheme, need = self.scheme(self.number(n)), self.bound(n) + 2
        if (scheme.number, need) not in self.enough:
            count = min(scheme.segments, max(1, need - scheme.double))
            while count < scheme.segments:
                sure = count + min(count, scheme.double) if scheme.high <= SMALL else self.levels(count, scheme.double, scheme.low / scheme.segments)
                if sure >= need:
                    break
                count += 1
            self.enough[scheme.number, need] = count
        return self.enough[scheme.number, need]

    def spare(self, tokens: np.ndarray) -> int:
        """By how much the levels of a set's segments pass its bound; where by none, it needs its empty ones."""
        scheme = self.scheme(self.number(tokens.size))
        if not self.bound(scheme.high):
            return 1
        taken = self.taken(tokens.size)
        if scheme.high <= SMALL:
            return taken + min(taken, scheme.double) - self.bound(tokens.size)
        at, _, first, size = _segments(tokens, scheme, taken)
        return first.size + int(((size > 1) & (at[first] < scheme.double)).sum()) - self.bound(tokens.size)

    def plan(self, n: int) -> list[tuple[Scheme, int]]:
        """The schemes under which a set of ``n`` is indexed, with its number of segments; its own first.
        Sets so small that only equal ones link have none."""
        number = self.number(n)
        out = [(self.scheme(number), self.taken(n))] if self.bound(self.scheme(number).high) else []
        if number and -(-n * self.least // 100) < self.edges[number] and self.bound(self.edges[number] - 1):
            below = self.scheme(number - 1)
            out.append((below, below.segments))
        return out


def _segments(tokens: np.ndarray, scheme: Scheme, taken: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens in the segments taken: segments, in order; values; where segments begin; their sizes."""
    spread = tokens * (_ODD[4] + np.uint64(2 * scheme.number)) >> np.uint64(32)
    at = (spread * np.uint64(scheme.segments) >> np.uint64(32)).astype(np.uint16 if scheme.segments < 1 << 16 else np.int64)
    if taken < scheme.segments:
        keep = at < taken
        at, tokens = at[keep], tokens[keep]
    order = np.argsort(at, kind="stable")
    at, value = at[order].astype(np.int64), tokens[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if at.size else np.zeros(0, np.int64)
    return at, value, first, np.diff(np.append(first, at.size))


def _keys(total: np.ndarray, segments: np.ndarray, scheme: Scheme) -> np.ndarray:
    return mix(total + mix(segments.astype(np.uint64), scheme.number + 1 << 40), scheme.number + 1).view(np.int64)


def segment_rows(tokens: np.ndarray, scheme: Scheme, taken: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places (segment * 2, plus 1 for a deletion) of a set's segments that are not empty, nor
    are after a deletion."""
    at, value, first, size = _segments(tokens, scheme, taken)
    if not at.size:
        return np.zeros(0, np.int64), at
    total = np.add.reduceat(value, first)
    near = (at < scheme.double) & np.repeat(size > 1, size)
    keys = np.concatenate((total, np.repeat(total, size)[near] - value[near]))
    segments = np.concatenate((at[first], at[near]))
    return _keys(keys, segments, scheme), segments * 2 + (np.arange(keys.size) >= first.size)


def empty_rows(tokens: np.ndarray, scheme: Scheme, taken: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for segments that are empty, or are after a deletion."""
    at, _, first, size = _segments(tokens, scheme, taken)
    none, one = np.setdiff1d(np.arange(taken), at), at[first][(size == 1) & (at[first] < scheme.double)]
    segments = np.concatenate((none, one))
    return _keys(np.zeros(segments.size, np.uint64), segments, scheme), segments * 2 + (np.arange(segments.size) >= none.size)


def _set_rows(batches: Iterator[pa.RecordBatch], schemes: Schemes, n: int) -> Iterator[pa.RecordBatch]:
    powers = _Powers()
    for batch in slices(batches, "_text"):
        nodes, sizes, spare = [], [], []
        for text in utf8(batch.column("_text")):
            tokens = shingles(text, powers, n)
            nodes.append(node_of(tokens) if tokens.size else None)
            sizes.append(tokens.size)
            spare.append(schemes.spare(tokens) if tokens.size else 1)
        rest = batch.drop_columns(["_text"])
        made = (pa.array(x, pa.int64()) for x in (nodes, sizes, spare))
        yield pa.record_batch([*rest.columns, *made], names=[*rest.schema.names, "node", "n", "spare"])


def _index_rows(batches: Iterator[pa.RecordBatch], schemes: Schemes, n: int, empty: bool) -> Iterator[pa.RecordBatch]:
    powers, seen = _Powers(), set()
    for batch in slices(batches, "_text"):
        parts = []
        for text in utf8(batch.column("_text")):
            tokens = shingles(text, powers, n)
            if not tokens.size or (node := node_of(tokens)) in seen:
                continue
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.add(node)
            for scheme, taken in schemes.plan(tokens.size):
                if empty and scheme.high <= SMALL:
                    continue  # these are in the main pass
                makers = [empty_rows] if empty else [segment_rows, empty_rows][: 1 + (scheme.high <= SMALL)]
                for keys, places in (make(tokens, scheme, taken) for make in makers):
                    parts.append((keys, np.full(keys.size, node), (places + (scheme.number << SCHEME_BIT)).astype(np.int32)))
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["key", "node", "place"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, deletions last, and node: those whose key also another node has, if one of
    them is no deletion. Only the first row of a key is held back, however many rows it has."""
    key = node = None  # of the current run, and its first node
    held, alive = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes, places = (batch.column(c).to_numpy() for c in ("key", "node", "place"))
        new = np.append(key is None or keys[0] != key, keys[1:] != keys[:-1])
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: the run that goes on
        first_node = np.where(run < 0, 0 if node is None else node, nodes[start[np.maximum(run, 0)]] if start.size else 0)
        good = np.where(run < 0, alive, places[start[np.maximum(run, 0)]] % 2 == 0 if start.size else False)
        again = np.append(False, ~new[1:] & (nodes[1:] == nodes[:-1]))
        other = good & (nodes != first_node) & ~again
        with_other = np.zeros(start.size + 1, bool)
        np.logical_or.at(with_other, run + 1, other)
        take = other.copy()
        take[start] |= with_other[1:]
        out = batch.filter(pa.array(take))
        if held is not None and with_other[0]:
            yield held
            held = None
        if start.size:
            key, node, alive = keys[-1], nodes[start[-1]], bool(good[-1])
            held = None if with_other[-1] or not alive else batch.slice(int(start[-1]), 1)
        if out.num_rows:
            yield out


def _verified(batches: Iterator[pa.RecordBatch], n: int, least: int) -> Iterator[pa.RecordBatch]:
    powers = _Powers()
    for batch in slices(batches, "_text_a"):
        a, b = (utf8(batch.column(c)) for c in ("_text_a", "_text_b"))
        found = [links(shingles(x, powers, n), shingles(y, powers, n), least) for x, y in zip(a, b)]
        yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, least: int = LEAST
) -> DataFrame:
    """Per row of ``docs``: ``(id, n_shingles, component_id)``, the smallest id of all texts reachable by
    links. Two texts link when ``100 * intersection >= least * union``."""
    marked = _marked(docs, id_col, text_col, n, least)
    least_id = written(marked.where("root is not null").groupBy("root").agg(F.min("_id").alias("component_id")), "least")
    return marked.join(least_id, "root", "left").select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id")
    )


def drop_near_copies(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, least: int = LEAST
) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (null last; then by a digest of
    the text). Rows equal in id and text are one. Texts without words all stay."""
    marked = _marked(docs, id_col, text_col, n, least).where("root is not null")
    first = F.struct(F.col("_id").isNull(), "_id", "_row")
    best = written(marked.groupBy("root").agg(F.min_by("_row", first).alias("_best")), "best")
    gone = written(marked.join(best, "root").where("_row <> _best").select("_row").distinct(), "gone")
    again = written(marked.groupBy("_row").count().where("count > 1").select("_row"), "again")
    left = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(id_col, text_col).alias("_row")).join(gone, "_row", "left_anti")
    if not again.isEmpty():
        left = left.join(again, "_row", "left_anti").unionByName(left.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return left.select("doc.*")


def _marked(docs: DataFrame, id_col: str, text_col: str, n: int, least: int) -> DataFrame:
    """Per row ``(_id, _row, n, root)``: its digest, set size, and component (null without words)."""
    schemes = Schemes(least)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_row"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    texts = rows.where(F.length("_text") > 0)

    sets = rows.mapInArrow(lambda b: _set_rows(b, schemes, n), f"_id {kind}, _row long, node long, n long, spare long")
    sets = written(sets, "sets")
    nodes = written(sets.where("node is not null").groupBy("node").agg(*(F.min(c).alias(c) for c in ("n", "spare", "_row"))), "nodes")

    index = "key long, node long, place int"
    keyed = texts.select("_text").mapInArrow(lambda b: _index_rows(b, schemes, n, False), index)
    ordered = keyed.repartition("key").sortWithinPartitions("key", F.col("place").bitwiseAND(1), "node")
    shared = written(ordered.mapInArrow(_shared, index), "shared")
    groups = _askable(shared, nodes, schemes)
    if not nodes.where("spare <= 0").isEmpty():
        groups = groups.unionByName(_empty_groups(texts, nodes, schemes, n, index))
    groups = written(groups, "groups")

    wanted = groups.select("node").distinct().join(nodes.select("node", "_row"), "node")
    found = rows.select("_row", "_text").join(written(wanted, "wanted"), "_row")
    known = written(found.select("node", "_text").dropDuplicates(["node"]), "texts")

    label = docs.sparkSession.createDataFrame([], "node long, root long")
    edges = docs.sparkSession.createDataFrame([], "a long, b long")
    for find in (lambda mixed: _verify(_pivot_pairs(mixed, least), known, n, least), lambda mixed: _block_links(_families(mixed), label, known, n, least)):
        mixed = _mixed(groups, label)
        if mixed.isEmpty():
            break
        edges = edges.unionByName(written(find(mixed), "links"))
        label = written(components(edges), "labels")

    marked = sets.join(label, "node", "left").select("_id", "_row", "n", F.coalesce("root", "node").alias("root"))
    return written(marked, "marked")


def _scheme_table(like: DataFrame, schemes: Schemes) -> DataFrame:
    """One row per scheme in use: as many as the logarithm of the largest set."""
    largest = like.agg(F.max("n")).first()[0] or 1
    made = [schemes.scheme(k) for k in range(schemes.number(largest) + 1)]
    return like.sparkSession.createDataFrame([(s.number, s.low, s.high, s.double) for s in made], "scheme int, low long, high long, double int")


def _parts_of_place() -> tuple[Column, Column]:
    """Scheme and segment of a row's place."""
    scheme, segment = F.shiftright("place", SCHEME_BIT), F.shiftright("place", 1).bitwiseAND((1 << SCHEME_BIT - 1) - 1)
    return scheme.alias("scheme"), segment.alias("segment")


def _askable(shared: DataFrame, nodes: DataFrame, schemes: Schemes) -> DataFrame:
    """Groups in which some set may ask: ``(key, node, place, scheme, n, spare, asks, units)``.

    A set that asks shares more levels than it can spare: fewer cannot make a link. ``spare`` are the
    levels of its non-empty segments beyond its bound; all must be shared with a partner.
    """
    table = F.broadcast(_scheme_table(nodes, schemes))
    units = F.when((F.col("segment") < F.col("double")) & (F.col("place").bitwiseAND(1) == 0), 2).otherwise(1)
    rows = shared.select("key", "node", "place", *_parts_of_place()).join(table, "scheme").withColumn("units", units)
    rows = rows.join(nodes.select("node", "n", "spare"), "node").withColumn("own", F.col("n").between(F.col("low"), F.col("high")))
    per_segment = rows.where("own").groupBy("node", "segment").agg(F.max("units").alias("units"), F.first("spare").alias("spare"))
    asking = per_segment.groupBy("node").agg(F.sum("units").alias("shared"), F.first("spare").alias("spare"))
    asking = written(asking.where("shared >= spare").select("node", F.lit(True).alias("asking")), "asking")
    rows = rows.join(asking, "node", "left").withColumn("asks", F.coalesce("asking", F.lit(False)) & F.col("own"))
    rows = written(rows.select("key", "node", "place", "scheme", "segment", "n", "spare", "asks", "units"), "rows")
    return rows.join(written(rows.where("asks").select("key").distinct(), "keys"), "key", "left_semi")


def _empty_groups(texts: DataFrame, nodes: DataFrame, schemes: Schemes, n: int, index: str) -> DataFrame:
    """Empty segments of the sets that cannot do without them, and of all that share these."""
    rows = texts.select("_text").mapInArrow(lambda b: _index_rows(b, schemes, n, True), index).dropDuplicates(["key", "node", "place"])
    rows = rows.select("key", "node", "place", *_parts_of_place()).join(nodes.select("node", "n", "spare"), "node")
    table = F.broadcast(_scheme_table(nodes, schemes))
    rows = rows.join(table, "scheme").withColumn("asks", (F.col("spare") <= 0) & F.col("n").between(F.col("low"), F.col("high")))
    rows = rows.withColumn("units", F.when(F.col("segment") < F.col("double"), 2).otherwise(1))
    rows = written(rows.select("key", "node", "place", "scheme", "segment", "n", "spare", "asks", "units"), "empty")
    return rows.join(written(rows.where("asks").select("key").distinct(), "keys"), "key", "left_semi")


def _mixed(groups: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of the groups that hold more than one component."""
    rows = written(groups.join(label, "node", "left").withColumn("root", F.coalesce("root", "node")), "rows")
    keys = rows.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("cost"))
    return written(rows.join(written(keys.where("_low <> _high").select("key", "cost"), "keys"), "key"), "mixed")


def _fits(least: int):
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * least


def _pivot_pairs(mixed: DataFrame, least: int) -> DataFrame:
    """Each node with the pivot of another component that it shares most segments with."""
    order = F.xxhash64("node")
    pivots = mixed.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("b"), F.col("root").alias("_root_b"), F.col("n").alias("n_b")), order).alias("p"))
    pairs = mixed.select("key", F.col("node").alias("a"), "root", F.col("n").alias("n_a")).join(written(pivots.select("key", "p.*"), "pivots"), "key")
    pairs = pairs.where((F.col("root") != F.col("_root_b")) & _fits(least)).groupBy("a", "b").agg(F.count("*").alias("together"))
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("together", "b")).alias("b"))


def _families(mixed: DataFrame) -> DataFrame:
    """``(node, family)``: the sets that share a segment, of those that asking sets must ask by, belong to
    the family of its first set. Segments with the same first set make one family, so that a group of
    near copies, which share most segments, is a few families and not one per segment.

    ``spare`` is what a set's segments have beyond its bound, so it must ask by segments whose levels,
    with those of the segments it shares with no other component, pass the bound.
    """
    per_segment = mixed.where("asks").groupBy("node", "segment").agg(
        F.max("units").alias("units"), F.sum("cost").alias("cost"), F.first("spare").alias("spare")
    )
    dear = Window.partitionBy("node").orderBy(F.desc("cost"), "segment").rowsBetween(Window.unboundedPreceding, 0)
    asked = per_segment.withColumn("left_out", F.sum("units").over(dear)).where("left_out >= spare").select("node", "segment")
    keys = mixed.where("asks").join(written(asked, "asked"), ["node", "segment"]).select("key").distinct()
    members = written(mixed.select("key", "node").join(written(keys, "keys"), "key", "left_semi"), "members")
    first = written(members.groupBy("key").agg(F.min("node").alias("family")), "first")
    return members.join(first, "key").select("node", "family").distinct()


def _block_links(families: DataFrame, label: DataFrame, texts: DataFrame, n: int, least: int) -> DataFrame:
    """Links within families that join components: each pair of blocks is one small group of rows."""
    families = written(families, "families")
    blocks = written(families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    rows = families.join(blocks, "family").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "_text")
    placed = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return placed.mapInArrow(lambda batches: _linked_blocks(batches, n, least), "a long, b long")


def _linked_blocks(batches: Iterator[pa.RecordBatch], n: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by pair of blocks; one pair is in memory at a time."""
    powers, now, held = _Powers(), None, []

    def found() -> Iterator[pa.RecordBatch]:
        pairs = _joining_links(held, least) if held else []
        if pairs:
            yield pa.record_batch([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])

    for batch in slices(batches, "_text"):
        for family, i, j, own, node, root, text in zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j", "own", "node", "root")), utf8(batch.column("_text"))):
            if (family, i, j) != now:
                yield from found()
                now, held = (family, i, j), []
            held.append((node, root, own == i, own == j, shingles(text, powers, n)))
    yield from found()


def _joining_links(rows: list[tuple], least: int) -> list[tuple[int, int]]:
    """Of the links between the two sides, as many as it takes to join the components that they join."""
    left, right = [r for r in rows if r[2]], [r for r in rows if r[3]]
    if not left or not right:
        return []
    sizes = [np.array([r[4].size for r in side], float) for side in (left, right)]
    tokens = [np.concatenate([r[4] for r in side]) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), size.astype(int)) for side, size in zip((left, right), sizes)]
    shared = np.intersect1d(*(distinct(t) for t in tokens), assume_unique=True)
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, shared.size, COLUMNS):
        part, counts = shared[at : at + COLUMNS], []
        for t, o, side in zip(tokens, owner, (left, right)):
            column = np.searchsorted(part, t)
            here = part[np.minimum(column, part.size - 1)] == t
            matrix = np.zeros((len(side), part.size), np.float32)
            matrix[o[here], column[here]] = 1
            counts.append(matrix)
        both += counts[0] @ counts[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    roots = [np.array([r[1] for r in side], np.int64) for side in (left, right)]
    link = (100 * both.astype(float) >= least * union) & (roots[0][:, None] != roots[1][None, :])
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for x, y in np.argwhere(link).tolist():
        a, b = find(left[x][1]), find(right[y][1])
        if a != b:
            top[max(a, b)] = min(a, b)
            out.append((left[x][0], right[y][0]))
    return out


def _verify(pairs: DataFrame, texts: DataFrame, n: int, least: int) -> DataFrame:
    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("_text").alias("_text_a")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("_text").alias("_text_b")), "b")
    return both.mapInArrow(lambda rows: _verified(rows, n, least), "a long, b long")
