"""Quality rules: fixed base rules, then hashed n-gram logistic regression against a fixed threshold.

The model sees shares of hashed words, word pairs and grams of four code points of the whole text,
none of which reaches into another text; lang, source and ids are no inputs. It is trained on labelled rows, on a sample of at most about
``SAMPLE`` of them chosen by hash (in one task; the bound is what allows that), with a fifth of them
held back to calibrate its probabilities (Platt). Scoring runs over all texts in Arrow batches.

Defined cases: a null text has no words, fails the base rules and scores like an empty text; with
one class or no labelled rows the model is the constant share of good rows (1 without rows);
repeated rows are scored each; a null doc_id is passed through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import U64, Texts, Words, mix, slices, words
from .linear import newton_logistic, sigmoid, sparse_logistic
from .statistics import base_counts

SAMPLE = 6000
BITS = 14  # of the word table and of the byte table
SCALE = 50.0
GRAM = 4  # code points
FIXED = 1 << 36  # weights are summed as whole numbers, so that sums do not hang on neighbours
MIN_WORDS, MAX_REPEAT_PERCENT, THRESHOLD = 50, 50, 0.3
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def hashed(t: Texts, w: Words) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Buckets and bounds by text: of words and pairs, then of four code points in a row, in tables side by side.

    Each pair and each gram lies within one text, so a text has the same buckets in any slice.
    """
    h = w.hashes(lower=True)
    shift = U64(64 - BITS)
    pair = h.copy()
    if len(h) > 1:
        pair[:-1] = mix(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
        last = w.doc_first[1:][np.diff(w.doc_first) > 0] - 1
        pair[last] = h[last]
    both = np.stack([h >> shift, pair >> shift], axis=1).reshape(-1).astype(np.int32)
    begin = np.append(np.flatnonzero((t.data & 0xC0) != 0x80), len(t.data))
    points = np.searchsorted(begin, t.offsets)  # code points points[i]:points[i+1] belong to text i
    n = np.maximum(np.diff(points) - GRAM + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(bounds[-1]) + np.repeat(points[:-1] - bounds[:-1], n)
    sums, down = t.sums()
    a, b = begin[at], begin[at + GRAM]
    grams = (sums[b] - sums[a]) * down[a] * U64(0x9E3779B97F4A7C15)
    grams ^= grams >> U64(29)
    grams *= U64(0xBF58476D1CE4E5B9)
    return (both, w.doc_first * 2), ((grams >> shift).astype(np.int32) + (1 << BITS), bounds)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, values, y, order = [], [], [], []
    for batch in batches:
        good = batch.column("good").to_numpy()
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for t in slices(batch.column("text")):
            parts = hashed(t, words(t))
            for i in range(len(t)):
                at, val = [], []
                for bucket, bounds in parts:
                    own, count = np.unique(bucket[bounds[i] : bounds[i + 1]], return_counts=True)
                    at.append(own)
                    val.append(SCALE * count / max(1, count.sum()))
                rows.append(np.concatenate(at).astype(np.int32))
                values.append(np.concatenate(val).astype(np.float32))
            y.extend(good[t.first : t.first + len(t)].tolist())
            order.extend(ids[t.first : t.first + len(t)].tolist())
    if not y:
        return
    # The order of rows must not follow the order in which tasks deliver them.
    by = sorted(range(len(y)), key=lambda i: (order[i], len(rows[i]), y[i]))
    rows, values, y = [rows[i] for i in by], [values[i] for i in by], np.array([y[i] for i in by], float)
    if len(set(y.tolist())) < 2:
        yield _model(np.zeros((2 << BITS) + 1), np.array([0.0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))]))
        return
    back = np.arange(len(y)) % 5 == 4
    if len(set(y[back].tolist())) < 2 or len(set(y[~back].tolist())) < 2:
        back[:] = False
    fit = np.flatnonzero(~back)
    w = sparse_logistic([rows[i] for i in fit], [values[i] for i in fit], y[fit], 2 << BITS)
    held = np.flatnonzero(back) if back.any() else fit
    logit = np.array([values[i] @ w[rows[i]] + w[-1] for i in held])
    yield _model(w, newton_logistic(logit[:, None], y[held], ridge=1e-4))


def _model(w: np.ndarray, platt: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()]), pa.array([platt.tolist()])], names=["weights", "platt"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both tables with the constant, and the calibration (slope, constant)."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("good")).distinct()
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text for each label, whichever way rows or labels repeat, so that the task that trains gets no more than the sample.
    texts = texts.groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    found = texts.repartition(1).mapInArrow(_train, "weights binary, platt array<double>").collect()
    if not found:
        return np.zeros((2 << BITS) + 1, np.float32), np.array([0.0, 20.0])
    return np.frombuffer(found[0].weights, np.float32), np.array(found[0].platt)


def scores(t: Texts, w: Words, weights: np.ndarray, platt: np.ndarray) -> np.ndarray:
    whole = np.rint(weights.astype(np.float64) * FIXED).astype(np.int64)
    logit = np.full(len(t), float(weights[-1]))
    for bucket, bounds in hashed(t, w):
        sums = np.zeros(len(bucket) + 1, np.int64)
        np.cumsum(whole[bucket], out=sums[1:])
        n = np.diff(bounds)
        logit += SCALE * ((sums[bounds[1:]] - sums[bounds[:-1]]) / FIXED) / np.maximum(n, 1)
    return sigmoid(platt[0] * logit + platt[1])


def _score(weights: np.ndarray, platt: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in slices(batch.column("text")):
                w = words(t)
                base = base_counts(t, w)
                failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
                p = scores(t, w, weights, platt)
                cols = [batch.column("doc_id").slice(t.first, len(t)), *(pa.array(base[k].astype(np.int64)) for k in BASE), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *BASE, "base_failed", "quality", "kept"])

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs -> (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept)."""
    weights, platt = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, quality double, kept boolean"
    return rows.mapInArrow(_score(weights, platt, threshold), schema)
