"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

The sums that fix both classes' means and covariances are gathered over all labelled training rows,
by Spark. Each class covariance is shrunk towards the pooled one and that towards its diagonal; the
Cholesky factors are made once and kept with the model. A text's score comes from the difference of
Gaussian log-densities, by Mahalanobis distances in forward substitutions, and is calibrated: a slope
and a constant are fitted to the training rows' differences, counted in bins of an eighth.

Defined cases: null and empty texts have the statistics of no words and are scored like others; a
label of null or other than 0 and 1 is no label; a class without rows gives the other class's
constant score, no labels at all 0.5; repeated rows are scored each; a null doc_id is scored, not
held out; an empty table gives no rows; memory follows the longest text. Only doc_id and text of docs are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import cut, discard, slices, words
from .linear import newton_logistic, sigmoid
from .statistics import NAMES, transformed

D = len(NAMES)
SHRINK, DIAGONAL = 0.2, 0.1
BIN = 800  # the outermost bin of log-density differences, at 100


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in slices(batch.column("text")):
            x = transformed(t, words(t))
            bounds = pa.array(np.arange(0, x.size + 1, D), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(t.first, len(t)), pa.ListArray.from_arrays(bounds, pa.array(x.reshape(-1)))], names=["doc_id", "x"])


def statistics(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_statistics, "doc_id long, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {y: np.zeros((D + 1, D + 1)) for y in (0, 1)}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy().reshape(-1, D)
        x = np.column_stack([x, np.ones(len(x))])
        y = batch.column("y").to_numpy()
        for c in total:
            total[c] += x[y == c].T @ x[y == c]
    for c, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, c, np.int32)), pa.array(np.arange(m.size, dtype=np.int32)), pa.array(m.reshape(-1))], names=["y", "k", "v"])


def distance(x: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances: the rows of x solved against a lower triangular factor, column by column."""
    z = np.empty_like(x)
    for i in range(x.shape[1]):
        z[:, i] = (x[:, i] - z[:, :i] @ factor[i, :i]) / factor[i, i]
    return (z**2).sum(axis=1)


@dataclass
class Quadratic:
    """Means, Cholesky factors and log-determinants of both classes; None where a class has no rows. platt: slope and constant."""

    prior: float
    parts: tuple | None
    platt: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def of(cls, moments: dict[int, np.ndarray]) -> Quadratic:
        n = {c: m[D, D] for c, m in moments.items()}
        prior = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
        if min(n.values()) < 2:
            return cls(prior, None)
        mean = {c: m[D, :D] / n[c] for c, m in moments.items()}
        cov = {c: m[:D, :D] / n[c] - np.outer(mean[c], mean[c]) for c, m in moments.items()}
        pooled = sum(n[c] * cov[c] for c in cov) / sum(n.values())
        pooled = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled)) + 1e-4 * np.eye(D)
        parts = []
        for c in (0, 1):
            weight = max(SHRINK, D / (D + n[c]))
            factor = np.linalg.cholesky((1 - weight) * cov[c] + weight * pooled + 1e-5 * np.eye(D))
            parts.append((mean[c], factor, 2 * np.log(np.diag(factor)).sum()))
        return cls(prior, tuple(parts))

    def logit(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        density = [-0.5 * (distance(x - mean, factor) + log_det) for mean, factor, log_det in self.parts]
        return density[1] - density[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.platt[0] * self.logit(x) + self.platt[1])


def train(rows: DataFrame) -> Quadratic:
    """rows: x array<double>, y int in (0, 1)."""
    sums = rows.select("x", "y").mapInArrow(_moments, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    moments = {c: np.zeros((D + 1) * (D + 1)) for c in (0, 1)}
    for r in sums:
        moments[r.y][r.k] = r.v
    model = Quadratic.of({c: m.reshape(D + 1, D + 1) for c, m in moments.items()})
    if model.parts is None:
        return model
    bins = rows.select("x", "y").mapInArrow(_bins(model), "bin int, y int").groupBy("bin", "y").count().orderBy("bin", "y").collect()  # 2 * 2 * BIN + 2 rows at most
    at, y, n = (np.array([r[k] for r in bins], float) for k in ("bin", "y", "count"))
    slope, constant = newton_logistic(at[:, None] / 8, y, ridge=1e-4, weight=n)
    return Quadratic(model.prior, model.parts, (max(float(slope), 1e-3), float(constant)))


def _bins(model: Quadratic):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, D)
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.rint(model.logit(x) * 8), -BIN, BIN).astype(np.int32)), batch.column("y")], names=["bin", "y"])

    return run


def _score(model: Quadratic):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, D)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality") -> DataFrame:
    """docs -> (doc_id, score), one row for each row; labels with `training` true are learnt from."""
    stats = cut(statistics(docs), "statistics")
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & training).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = cut(stats.join(y, "doc_id").select("x", "y"), "training")
    model = train(rows)
    discard(rows)
    return stats.mapInArrow(_score(model), "doc_id long, score double")
