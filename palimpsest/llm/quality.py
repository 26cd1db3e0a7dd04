"""Quality scores by naive Bayes support vectors.

Features are indicators of token n-grams (words as written, runs of other characters, and their kinds:
lower, title, upper, digits, mixed), hashed into a table of fixed size. Each indicator is scaled by
the log ratio of the classes' smoothed n-gram counts; a linear model with hinge loss is fitted to the
scaled, length-normalised rows by dual coordinate descent, pulled towards the plain log ratios, and
its margins become probabilities by a logistic curve fitted to margins of rows that the model in
question had not seen (two halves).

The fit uses at most ``SAMPLE`` labelled rows per class, the lowest by a hash of their id; everything
else covers all rows and whole texts. Documents whose labels disagree, labels and ids that are null
are left out of the fit. Null and empty texts have no features and get the score of the bias alone.
Without labelled rows of both classes every score is the share of label 1 (one half if there is none).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import distinct, slices, text_of

#: Most labelled rows of a class that the model is fitted on.
SAMPLE = 4000
#: Size of the feature table; smoothing of counts; weight of the fitted model against plain ratios.
TABLE = 1 << 20
SMOOTHING = 1.0
BLEND = 0.75
COST = 1.0
EPOCHS = 15
REMEMBERED_TOKENS = 1 << 17

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def kind_of(token: str) -> int:
    if token.isalpha():
        return 1 if token.islower() else 2 if token.isupper() and len(token) > 1 else 3 if token[1:].islower() or len(token) == 1 else 4
    return 5 if token.isdigit() else 8 + zlib.crc32(token[:4].encode()) % 1024


class _Tokens(dict):
    """Token to a number that holds its hash and, in the low bits, its kind."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED_TOKENS:
            self.clear()
        data = token.encode()
        self[token] = found = (zlib.crc32(data) << 28 ^ zlib.adler32(data) << 12) & 0xFFFFFFFFFFFFF000 | kind_of(token)
        return found


def features(text: str, known: _Tokens) -> np.ndarray:
    """Sorted distinct places in the feature table."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int32)
    ids = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    kinds = ids & np.uint64(0xFFF)
    grams = [ids * _ODD[0]]
    if len(tokens) > 1:
        grams.append((ids[:-1] * _ODD[1] ^ ids[1:]) * _ODD[0])
    if len(tokens) > 2:
        grams.append(((kinds[:-2] << np.uint64(24)) + (kinds[1:-1] << np.uint64(12)) + kinds[2:] + np.uint64(1)) * _ODD[2])
    found = np.concatenate(grams)
    found = (found ^ found >> np.uint64(31)) * _ODD[1] >> np.uint64(64 - TABLE.bit_length() + 1)
    return distinct(found.astype(np.int32))


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log of the classes' smoothed and normalised indicator counts."""
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == side]), minlength=TABLE) + SMOOTHING for side in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model with squared norm; the bias is a feature of value one."""
    weights, bias = np.zeros(TABLE), 0.0
    alpha, norms = np.zeros(len(rows)), np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(11)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            row, value, sign = rows[i], values[i], signs[i]
            slope = sign * (weights[row] @ value + bias) - 1.0
            new = min(max(alpha[i] - slope / norms[i], 0.0), COST)
            if step := (new - alpha[i]) * sign:
                weights[row] += step * value
                bias += step
                moved += abs(step)
                alpha[i] = new
        if moved < 1e-3 * len(rows):
            break
    return weights, bias


def fit_margins(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights per feature (ratios folded in) and bias: a margin is their mean over a row's root size."""
    ratios = log_ratios(rows, labels)
    values = [ratios[r] / np.sqrt(max(1, r.size)) for r in rows]
    weights, bias = dual_coordinate_descent(rows, values, labels * 2.0 - 1.0)
    used = weights != 0
    plain = np.abs(weights[used]).mean() if used.any() else 0.0
    return (BLEND * weights + (1 - BLEND) * plain) * ratios, bias


def margins(rows: list[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    return np.array([weights[r].sum() / np.sqrt(max(1, r.size)) + bias for r in rows])


def logistic(x: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of a curve from margins to probabilities, with the classes weighted to ``prior``."""
    weight = np.where(labels == 1, prior / max(1, (labels == 1).sum()), (1 - prior) / max(1, (labels == 0).sum()))
    ones, zeros = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -35, 35)))
        error, curve = weight * (p - target), np.maximum(weight * p * (1 - p), 1e-12)
        hessian = np.array([[curve @ (x * x), curve @ x], [curve @ x, curve.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hessian, [error @ x, error.sum()])
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return slope, offset


@dataclass
class Model:
    """A margin's weights and bias, and the curve that makes it a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    if len(set(labels.tolist())) < 2:
        share = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(TABLE, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    half = np.arange(len(rows)) % 2 == 0
    unseen = np.zeros(len(rows))
    for side in (half, ~half):
        other = [r for r, s in zip(rows, side) if not s]
        if len(set(labels[~side].tolist())) == 2:
            unseen[side] = margins([r for r, s in zip(rows, side) if s], *fit_margins(other, labels[~side]))
        else:
            unseen[side] = labels[side] * 2.0 - 1.0
    slope, offset = logistic(unseen, labels, prior)
    weights, bias = fit_margins(rows, labels)
    return Model(weights.astype(np.float32), bias, max(slope, 1e-6), offset)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on ``labels`` (ids and a 0/1 column); call it with the rows that may be learnt from only."""
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    given = given.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z")).where("y = z")
    total = {r.y: r.n for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("_id"), F.col("_id")
    chosen = [given.where(F.col("y") == side).orderBy(*order).limit(sample) for side in (0, 1)]
    # at most twice ``sample`` ids, whatever the size of the tables
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]).select("_id", F.col("y").cast("int").alias("y")))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(chosen, "_id")
    prior = total.get(1, 0) / sum(total.values()) if total else 0.5

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens()
        for batch in slices(batches, "_text"):
            found = [features(t, known).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.record_batch([batch.column("y"), pa.array(batch.column("_id").cast(pa.string())), pa.array(found, pa.binary())], names=["y", "_id", "found"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({(i, y, f) for b in batches for y, i, f in zip(*(b.column(c).to_pylist() for c in ("y", "_id", "found")))})
        model = fit_rows([np.frombuffer(f, np.int32) for _, _, f in got], np.array([y for _, y, _ in got], int), prior)
        numbers = np.array([model.bias, model.slope, model.offset]).tobytes()
        yield pa.record_batch([pa.array([model.weights.tobytes()], pa.binary()), pa.array([numbers], pa.binary())], names=["weights", "numbers"])

    found = rows.mapInArrow(extract, "y int, _id string, found binary")
    model = found.repartition(1).mapInArrow(learn, "weights binary, numbers binary").first()
    return Model(np.frombuffer(model.weights, np.float32), *np.frombuffer(model.numbers, float).tolist())


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each text."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((model.weights, model.bias, model.slope, model.offset))
    kept = [c for c in docs.columns if c != score_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, slope, offset = sent.value
        known = _Tokens()
        for batch in slices(batches, text_col):
            x = margins([features(t or "", known) for t in batch.column(text_col).to_pylist()], weights, bias)
            found = 1 / (1 + np.exp(-np.clip(slope * x + offset, -35, 35)))
            yield pa.record_batch([*batch.select(kept).columns, pa.array(found, pa.float64())], names=[*kept, score_col])

    return docs.select(*kept).mapInArrow(run, f"{fields}, `{score_col}` double")
