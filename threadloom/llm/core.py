"""Shared parts of the corpus operators: durable tables, and vectorised words of whole texts.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. All work is done on slices of
bounded size (``SLICE_BYTES``), so memory in a Python worker does not follow the batch; a text
longer than a slice is one by itself, so memory follows the longest text (some tens of bytes a byte).
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a Python worker; rows of long texts else make batches of 64 MB.
BATCH_BYTES = 16 << 20
#: Ids beyond this number are joined by a shuffle; up to it they fit in a broadcast of at most 64 MB.
BROADCAST_IDS = 2_000_000

U64 = np.uint64


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is configured a local session gets one of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="threadloom-"))
    return found.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_BYTES, unless they are held to less already; called where a job of ours begins."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


#: What workers keep from map to map, by the module that keeps it: a function that forgets it.
KEPT: dict[str, Callable[[], None]] = {}


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map over batches. A worker lives on for other stages: at the beginning it forgets what maps of other modules keep, at the end it gives freed memory back (where the C library can)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for module, forget in KEPT.items():
            if module != run.__module__:
                forget()
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def clear_of(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores until no column is called so, whatever the case of letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/threadloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: cuts lineage and survives lost executors."""
    bound_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table made by cut() that no later plan reads."""
    spark = df.sparkSession
    for d in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/threadloom/" in d:
            path = spark._jvm.org.apache.hadoop.fs.Path(d)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only_ids(df: DataFrame, ids: DataFrame, on: str = "doc_id", n: int | None = None) -> DataFrame:
    """Rows of df whose id is among the distinct ids: broadcast while they are few, else a shuffle."""
    n = ids.count() if n is None else n
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, on, "left_semi")


# ---- words of whole texts -------------------------------------------------------------------

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so that powers have inverses modulo 2**64
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RNG = np.random.default_rng(20260911)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=U64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            out = np.full(max(n, 1 << 16), base, U64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Texts:
    """A slice of texts as bytes; offsets[i]:offsets[i+1] is text i (null: empty)."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of a linear form of the bytes, and what a difference of two is multiplied by to hang on content alone."""
        up, down = _powers(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=out[1:])
        return out, down


@dataclass
class Words:
    texts: Texts
    start: np.ndarray
    end: np.ndarray
    doc_first: np.ndarray  # words doc_first[i]:doc_first[i+1] belong to text i

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word: a random linear form of its bytes, then mixed."""
        data = self.texts.data
        up, down = _powers(len(data) + 1)
        sums = np.empty(len(data) + 1, U64)
        sums[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U64))


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Texts of a batch in slices of about limit bytes; a longer text is a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield Texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a)
        a = b


def words(texts: Texts) -> Words:
    data = texts.data
    inside = ~_WS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = texts.offsets[:-1]
    at = at[at < len(data)]
    begins[at] = inside[at]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = at[at > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return Words(texts, start, np.flatnonzero(ends) + 1, np.searchsorted(start, texts.offsets))


def doc_of(doc_first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(doc_first) - 1), np.diff(doc_first))


def text_at(texts: Texts, i: int) -> bytes:
    return texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """An Arrow binary array of consecutive pieces of data, given their lengths in bytes."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def n_words(column: str = "text"):
    """Number of words of a text as an expression; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
