"""Vector codes: each vector's parts as indexes into small codebooks, fitted with whole numbers only.

Vectors become blocks of columns once (a row of the table holds some thousands of vectors as one array
per part and dimension), in a durable table. A round sends the codebooks, bounded by their shape, to an
RDD of the blocks; distances are summed dimension by dimension, and `np.add.at` fills 64-bit tensors of
sums and counts that a reduction tree merges, so the driver gets one tensor whatever the input.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite component are dropped,
and so are vectors that cannot be cut into equal parts or are of another length than the vector with the
smallest id. A null id comes last; repeated ids are ordered by their components and keep a row each.
Fewer vectors than entries make a smaller codebook. Null labels are one group. An empty table gives an
empty result. Components so large that a 64-bit sum could overflow are an error. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

#: Vectors of a block.
BLOCK = 4096
#: Sums of errors of so many labels are broadcast (a few MB); more meet their rows by a shuffle.
LABELS = 100_000


@dataclass
class Codebooks:
    """entries[part, entry, position within part] as whole numbers of 1 / scale."""

    entries: np.ndarray
    scale: int

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code of two hex digits a part stands for."""
        at = np.frombuffer(bytes.fromhex(code), np.uint8)
        return self.entries[np.arange(len(at)), at].ravel() / self.scale


def kept(vectors: DataFrame, column: str = "embedding", id: str = "vec_id", label: str = "label", parts: int = 8) -> DataFrame:
    """(id, label, v array<double>) of the rows that count."""
    v = F.col(column)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & finite).select(F.col(id).alias("id"), F.col(label).alias("label"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    return rows.where(F.size("v") == (len(first[0].v) if first else 0))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """x[part, position, row], entries[part, entry, position] -> squared distances [part, row, entry], a dimension at a time."""
    out = np.zeros((x.shape[0], x.shape[2], entries.shape[1]), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, :, None] - entries[:, None, :, j]
        d *= d
        out += d
    return out


def _block(data: bytes, parts: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(parts, width, -1)


def blocks(rows: DataFrame, parts: int, width: int, scale: int, most: int) -> DataFrame:
    """(ids, labels, data): whole-number vectors in columns, a part after the other."""
    kinds = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) * scale)
                if np.abs(x).max() > most:
                    raise ValueError(f"a component is beyond {most / scale:.3g}")
                data = np.ascontiguousarray(x.astype(np.int64).reshape(-1, parts, width).transpose(1, 2, 0))
                ids, labels = (pa.ListArray.from_arrays([0, part.num_rows], part.column(c)) for c in ("id", "label"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([data.tobytes()], pa.binary())], names=["ids", "labels", "data"])

    return rows.mapInArrow(core.lean(run), f"ids array<{kinds['id'].dataType.simpleString()}>, labels array<{kinds['label'].dataType.simpleString()}>, data binary")


def _tallied(entries: np.ndarray, parts: int, width: int):
    """Adds a block's vectors to (sums, counts) of their nearest entries."""

    def add(held: tuple[np.ndarray, np.ndarray], data: bytes) -> tuple[np.ndarray, np.ndarray]:
        sums, counts = held
        x = _block(data, parts, width)
        near = _distances(x, entries).argmin(axis=2)
        part = np.broadcast_to(np.arange(parts)[:, None], near.shape)
        np.add.at(sums, (part, near), x.transpose(0, 2, 1))
        np.add.at(counts, (part, near), 1)
        return sums, counts

    return add


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a[0][...] += b[0]
    a[1][...] += b[1]
    return a


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, depth: int = 2, **columns: str) -> tuple[Codebooks, DataFrame]:
    """The codebooks, and the blocks that they were fitted on (for encode)."""
    rows = kept(vectors, parts=parts, **columns)
    first = rows.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    width = len(first[0].v) // parts if first else 1
    start = np.floor(np.array([r.v for r in first], float).reshape(len(first), parts, width) * scale)
    most = int((2**62 / (4 * width * max(1, parts))) ** 0.5)  # a vector's squared distances stay below 2**62
    if start.size and np.abs(start).max() > most:
        raise ValueError(f"a component is beyond {most / scale:.3g}")
    held = core.cut(blocks(rows, parts, width, scale, most), "vectors")
    book = start.astype(np.int64).transpose(1, 0, 2)
    if not first:
        return Codebooks(book, scale), held
    # No sum overflows below 2**62 / most vectors, some 30 billion.
    data = held.select("data").rdd.map(lambda r: bytes(r.data))
    for _ in range(rounds):
        zero = (np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64))
        sums, counts = data.treeAggregate(zero, _tallied(book, parts, width), _merged, depth)
        book = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], book)
    return Codebooks(book, scale), held


def encode(held: DataFrame, books: Codebooks) -> DataFrame:
    """blocks -> (id, label, code, error)."""
    parts, _, width = books.entries.shape
    book, types = books.entries, held.schema
    kinds = [types[c].dataType.elementType.simpleString() for c in ("ids", "labels")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                far = _distances(_block(batch.column("data")[i].as_py(), parts, width), book)
                near = far.argmin(axis=2)
                error = np.take_along_axis(far, near[:, :, None], 2)[:, :, 0].sum(axis=0)
                codes = np.ascontiguousarray(near.T.astype(np.uint8)).tobytes().hex()
                size = 2 * parts
                own = batch.slice(i, 1)
                ids, labels = (pc.list_flatten(own.column(c)) for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([codes[k : k + size] for k in range(0, len(codes), size)], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return held.mapInArrow(core.lean(run), f"id {kinds[0]}, label {kinds[1]}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with the sum of errors of its label; nulls are one label. Sums are made before rows meet them, so a hot label is no hot task."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("label_"), "label_error")
    few = totals.count() <= LABELS
    return coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("label_"))).drop("label_")


def compress(vectors: DataFrame, **options) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of all vectors that count."""
    books, held = fit(vectors, **options)
    coded = core.cut(encode(held, books), "codes")
    core.discard(held)
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(books.digest()))
