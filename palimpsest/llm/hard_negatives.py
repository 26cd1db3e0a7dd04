"""Hard negatives by Kronecker-packed products.

Components become the integers ``floor(scale * x)``. In a block, candidates' components and anchors'
are shifted to be non-negative; so many bits as a whole inner product can need make a field, and the
components of several candidates lie in separated fields of one integer. One product per anchor
component then adds to the scores of all of them, no field ever reaches the next, and the scores are
read from the fields exactly. Where two fields or more fit in 53 bits the integers are held in doubles
and multiplied as matrices; wider ones are Python integers with all candidates of a block in one.

Anchors (a share of the rows) meet all rows in a grid: rows are dealt over one side, anchors over the
other, by row numbers of a written table, so that a cell holds a bounded number of both whatever the
labels are. First every anchor's best rows of its own label are found, then, with their scores as
bounds, its best rows of other labels; cells return the few best and a ranked limit merges them.

Rows with a null id, label, vector or component, or a component that is not finite (or not after
scaling) take no part. Of several rows of one id the least by label and vector counts. Vectors of
different lengths do not meet; empty ones score 0. Scores beyond 64 bits count as the end of the range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.core import top_k
from palimpsest.session import written

#: Bytes of the rows, as doubles, and of the anchors of a cell of the grid; anchors multiplied at once.
CELL_BYTES, AT_ONCE = 16 << 20, 64
#: Bits of an integer that a double holds exactly.
EXACT = 53

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all ``anchors`` with all ``rows``; both hold integers as doubles."""
    size = anchors.shape[1]
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    low_a, low_r = int(anchors.min()), int(rows.min())
    bits = max(1, (size * (int(anchors.max()) - low_a) * (int(rows.max()) - low_r)).bit_length())
    if 2 * bits > EXACT or max(abs(low_a), abs(low_r), int(anchors.max()), int(rows.max())) >> EXACT:
        return _wide(anchors, rows, low_a, low_r, bits)
    a, r = anchors - low_a, rows - low_r
    fields = EXACT // bits
    words = np.zeros((-(-len(r) // fields), size))
    for f in range(fields):
        part = r[f::fields]
        words[: len(part)] += part * float(1 << bits * f)
    packed = (a @ words.T).astype(np.int64)
    found = np.empty((len(a), len(words) * fields), np.int64)
    for f in range(fields):
        found[:, f::fields] = packed >> bits * f & (1 << bits) - 1
    found = found[:, : len(r)]
    return found + (low_r * a.sum(1)).astype(np.int64)[:, None] + (low_a * r.sum(1)).astype(np.int64) + size * low_a * low_r


def _wide(anchors: np.ndarray, rows: np.ndarray, low_a: int, low_r: int, bits: int) -> np.ndarray:
    """The same with one Python integer per component, which holds all rows."""
    step = bits + 7 >> 3
    a = [[int(x) - low_a for x in row] for row in anchors.tolist()]
    r = [[int(x) - low_r for x in row] for row in rows.tolist()]
    packed = [int.from_bytes(b"".join(x.to_bytes(step, "little") for x in column), "little") for column in zip(*r)]
    sums, size = [sum(row) for row in r], len(packed)
    found = np.empty((len(a), len(r)), np.int64)
    for i, row in enumerate(a):
        whole = sum(x * p for x, p in zip(row, packed)).to_bytes(step * len(r), "little")
        more = low_r * sum(row) + size * low_a * low_r
        for j in range(len(r)):
            score = int.from_bytes(whole[j * step : (j + 1) * step], "little") + more + low_a * sums[j]
            found[i, j] = min(max(score, _LEAST), _MOST)
    return found


def _first(i: np.ndarray, k: int) -> np.ndarray:
    """Which of the entries, in order of their group ``i``, are among the first ``k`` of the group."""
    starts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if i.size else np.zeros(0, int)
    return np.arange(i.size) - np.repeat(starts, np.diff(np.append(starts, i.size))) < k


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` highest allowed scores of each line, ties by the earlier column."""
    held = np.where(allowed, scores, _LEAST)
    least = np.partition(held, -k, axis=1)[:, -k] if held.shape[1] > k else np.full(len(held), _LEAST)
    i, j = np.nonzero(allowed & (held >= least[:, None]))
    order = np.lexsort((j, ~held[i, j], i))  # ~x falls as x rises, at the ends of the range too
    i, j = i[order], j[order]
    keep = _first(i, k)
    return i[keep], j[keep]


def _block(found: pa.Table, name: str) -> np.ndarray:
    column = found.column(name).combine_chunks()
    size = len(column[0]) if len(column) else 0
    return np.floor(np.asarray(column.flatten(), float)).reshape(len(column), size)


def mine(
    vectors: DataFrame,
    anchors: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which
    ``anchors``, a condition on the id column, holds: an anchor's ``positives`` best rows of its label,
    and for each the ``negatives`` best rows of other labels whose score lies between ``low`` and
    ``high`` hundredths of the positive's. Ids must be numbers."""
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    finite = F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("string").alias("_label"), scaled.alias("_vec"))
    plain = plain.where("_id is not null and _label is not null and _vec is not null").where(finite)
    single = plain.groupBy("_id").agg(F.min(F.struct("_label", "_vec")).alias("_r")).select("_id", "_r.*", F.size("_r._vec").alias("_size"))
    # the number is written with the row, so that every later read deals it alike
    table = written(single.withColumn("_at", F.monotonically_increasing_id()), "vectors")
    named = table.withColumn(id_col, F.col("_id")).where(anchors)
    chosen = written(named.select("_id", "_label", "_vec", "_size").withColumn("_at", F.monotonically_increasing_id()), "anchors")
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.max("_size"), F.lit(1)).alias("most")).first()
    in_cell = max(1, cell_bytes // (8 * max(1, size.most)))
    across, down = max(1, -(-size.n // in_cell)), max(1, -(-chosen.count() // in_cell))

    def dealt(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        # numbers of different writing tasks lie far apart, hence the hash
        return df.withColumn(own, F.pmod(F.xxhash64("_at"), F.lit(count)).cast("int")).withColumn(other, spread).drop("_at")

    rows = dealt(table, "_x", across, "_y", down)
    cell = ["_size", "_x", "_y"]

    def near(asked: pa.Table, all_rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"anchor_id": [], "positive_id": [], "positive_score": []}
        if asked.num_rows and all_rows.num_rows:
            for a_ids, a, _, ids, r, _ in _by_label(asked, all_rows):
                for at in range(0, len(a), AT_ONCE):
                    scores = products(a[at : at + AT_ONCE], r)
                    i, j = best(scores, a_ids[at : at + AT_ONCE, None] != ids, positives)
                    for name, got in zip(out, (a_ids[at + i], ids[j], scores[i, j])):
                        out[name].append(got)
        return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})

    def hard(asked: pa.Table, all_rows: pa.Table) -> pa.Table:
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        out: dict[str, list] = {n: [] for n in names}
        if asked.num_rows and all_rows.num_rows:
            ids, labels, r = _sorted(all_rows)
            a, a_ids = _block(asked, "_vec"), np.asarray(asked.column("_id"))
            a_labels = np.array(asked.column("_label").to_pylist(), object)
            given = [[(p["positive_id"], p["positive_score"]) for p in x] for x in asked.column("_positives").to_pylist()]
            for at in range(0, len(a), AT_ONCE):
                some = given[at : at + AT_ONCE]
                bounds = [[(-(-low * s // 100), high * s // 100) for _, s in x] for x in some]
                scores = products(a[at : at + AT_ONCE], r)
                floor = np.array([max(min(l for l, _ in x), _LEAST) for x in bounds])
                ceiling = np.array([min(max(h for _, h in x), _MOST) for x in bounds])
                i, j = np.nonzero((scores >= floor[:, None]) & (scores <= ceiling[:, None]) & (a_labels[at : at + AT_ONCE, None] != labels))
                s = scores[i, j]
                order = np.lexsort((j, ~s, i))
                i, j, s = i[order], j[order], s[order]
                for k in range(positives):
                    least = np.array([max(x[k][0], _LEAST) if k < len(x) else 1 for x in bounds])
                    most = np.array([min(x[k][1], _MOST) if k < len(x) else 0 for x in bounds])
                    fit = np.flatnonzero((s >= least[i]) & (s <= most[i]))
                    fit = fit[_first(i[fit], negatives)]
                    who = i[fit]
                    p_id = np.array([x[k][0] if k < len(x) else 0 for x in some], np.int64)
                    p_score = np.array([x[k][1] if k < len(x) else 0 for x in some], np.int64)
                    for name, got in zip(names, (a_ids[at + who], p_id[who], p_score[who], ids[j[fit]], s[fit])):
                        out[name].append(got)
        return pa.table({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})

    def met(asked: DataFrame, run, schema: str) -> DataFrame:
        return dealt(asked, "_y", down, "_x", across).groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(run, schema)

    first = met(chosen, near, "anchor_id long, positive_id long, positive_score long")
    first = top_k(first, ["anchor_id"], [F.desc("positive_score"), F.col("positive_id")], positives)
    # at most ``positives`` rows an anchor
    lists = first.groupBy(F.col("anchor_id").alias("_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("_positives"))
    found = met(chosen.join(lists, "_id"), hard, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = top_k(found, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.col("negative_id")], negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _sorted(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, with labels and vectors."""
    ids = np.asarray(found.column("_id"))
    order = np.argsort(ids)
    return ids[order], np.array(found.column("_label").to_pylist(), object)[order], _block(found, "_vec")[order]


def _by_label(asked: pa.Table, found: pa.Table) -> Iterator[tuple]:
    """Anchors and rows of each label: ids, vectors and labels of both."""
    a_ids, a_labels, a = _sorted(asked)
    ids, labels, r = _sorted(found)
    for label in sorted(set(a_labels)):
        mine, theirs = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
        if theirs.size:
            yield a_ids[mine], a[mine], a_labels[mine], ids[theirs], r[theirs], labels[theirs]
