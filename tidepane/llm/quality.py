"""Quality classifier (operator 10).

Document statistics (class counts of bytes, repetition of words and lines, lengths) are computed
once per text. Random Fourier features of the standardised statistics approximate a Gaussian
kernel. Every task sums its part of the normal equations, the sums are added up in two levels, and
the ridge solution is one small linear system. Isotonic regression over fixed score bins, counted
over all training rows, turns ridge scores into probabilities.

Defined results: null text counts as empty, and empty texts get the score of their (all zero)
statistics; null labels and null ids do not train; a document with several labels trains with each;
without any training row every score is 0.5; repeated rows are scored alike; other columns stay
with the row where documents are filtered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepane.llm.tables import held_out
from tidepane.sources.shared import stage

FEATURES = 256
GAMMA = 0.35
RIDGE = 1.0
BINS = 1000

_CLASSES = np.full(256, 7)
_CLASSES[128:] = 0
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"()-", b"!?"), 1):
    _CLASSES[list(_bytes)] = _k if _k < 7 else 8
N_STATISTICS = 21


def statistics(text: bytes | None) -> np.ndarray:
    out = np.zeros(N_STATISTICS)
    text = text or b""
    words = text.split()
    if not words:
        return out
    by_byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    out[:9] = np.bincount(_CLASSES, weights=by_byte, minlength=9) / len(text)
    other = by_byte[(_CLASSES == 7)]
    distinct = set(words)
    lines = [x for x in text.split(b"\n") if x]
    out[9] = other.max() / len(text)
    out[10] = np.log1p(len(words))
    out[11] = len(text) / len(words) / 10
    out[12] = len(distinct) / len(words)
    out[13] = sum(map(eq, words, words[1:])) / len(words)
    out[14] = len(set(lines)) / len(lines)
    out[15] = np.log1p(len(words) / len(lines))
    out[16] = len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2)
    out[17] = text.count(b" | ") / len(words)
    out[18] = sum(len(x) == 1 for x in words) / len(words)
    out[19] = max(map(len, distinct)) / 20
    out[20] = sum(len(x) > 20 for x in distinct) / len(distinct)
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(x).astype(np.float32).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["row", "stats"])


def document_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``row`` (a struct of the columns to ``carry``) and ``stats`` (float32 values)."""
    source = docs.select(F.struct(*carry).alias("row"), "text")
    return source.mapInArrow(_statistics, T.StructType([source.schema[0], T.StructField("stats", T.BinaryType())]))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, N_STATISTICS).astype(np.float64)


def _sum_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            values = np.frombuffer(blob)
            total = values.copy() if total is None else total + values
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def summed(df: DataFrame, per_batch: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of ``per_batch`` over all batches: per task first, then in two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                values = per_batch(batch)
                total = values if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    partial = df.mapInArrow(run, "sums binary")
    merged = partial.repartition(8).mapInArrow(_sum_blobs, "sums binary").collect()
    return sum(np.frombuffer(r.sums) for r in merged) if merged else None


class Model:
    """Standardisation, random features, ridge weights and isotonic steps."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.directions = rng.normal(0, np.sqrt(2 * GAMMA / N_STATISTICS * 4), (N_STATISTICS, FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.mean, self.scale = np.zeros(N_STATISTICS), np.ones(N_STATISTICS)
        self.weights: np.ndarray | None = None
        self.steps = (np.array([0.0]), np.array([0.5]))

    def transform(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        features = np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)
        return np.hstack([features, z / 8, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.weights is None else self.transform(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps)


def isotonic(centres: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order; (x, y) to interpolate between."""
    blocks: list[list[float]] = []  # sum of labels, weight, sum of weighted centres
    for c, k, n in zip(centres, ones, counts):
        if n:
            blocks.append([k, n, c * n])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5 * 0.02) / (b[1] + 0.02) for b in blocks])


def fit(training: DataFrame) -> Model:
    """``training``: ``stats`` and ``label`` (0 or 1)."""
    model = Model()
    training = training.select("stats", F.col("label").cast("double").alias("label"))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    total = summed(training, moments)
    if total is None:
        return model
    n, d = total[0], N_STATISTICS
    model.mean = total[1 : d + 1] / n
    model.scale = np.sqrt(np.maximum(total[d + 1 :] / n - model.mean**2, 0)) + 1e-3

    def normal_equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.transform(_matrix(batch.column(0)))
        return np.concatenate([(z.T @ z).ravel(), z.T @ np.asarray(batch.column(1))])

    total = summed(training, normal_equations)
    m = FEATURES + d + 1
    model.weights = np.linalg.solve(total[: m * m].reshape(m, m) + RIDGE * np.eye(m), total[m * m :])

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip(((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        y = np.asarray(batch.column(1))
        return np.concatenate([np.bincount(at, weights=y, minlength=BINS), np.bincount(at, minlength=BINS).astype(float)])

    total = summed(training, binned)
    centres = (np.arange(BINS) + 0.5) * 2 / BINS - 0.5
    model.steps = isotonic(centres, total[:BINS], total[BINS:])
    return model


def _scored(model: Model, of_texts: bool = False):
    """Scores from statistics, or from texts: one Python worker a task, where a second step would take another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _statistics(batches) if of_texts else batches:
            scores = model.score(_matrix(batch.column(1))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    return run


def _training(stats: DataFrame, labels: DataFrame, id_of: Column) -> DataFrame:
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    rows = stats.where(~held_out(id_of)).select(id_of.alias("id"), "stats")
    return stage(rows.join(known, "id").select("stats", "label"), "quality-training")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted`` (1 if the score is at least 0.5)."""
    stats = stage(document_statistics(docs, ["doc_id"]), "quality-statistics")
    model = fit(_training(stats, labels, F.col("row.doc_id")))
    schema = T.StructType([stats.schema[0], T.StructField("score", T.DoubleType())])
    doc_id = F.col("row.doc_id")
    return stats.mapInArrow(_scored(model), schema).select(
        doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """The documents whose score is at least ``at_least``, with all their columns."""
    stats = stage(document_statistics(docs, ["doc_id"]), "quality-statistics")
    model = fit(_training(stats, labels, F.col("row.doc_id")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    schema = T.StructType([rows.schema[0], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_scored(model, of_texts=True), schema).where(F.col("score") >= at_least).select("row.*")
