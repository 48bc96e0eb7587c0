"""Line dedup that can be undone: sharded cuckoo filters before exact reference-count tables.

State in the shared folder; each commit has a data folder of its own and writes its record last:
  postings  (key_hi, key_lo, doc_id, delta)    what a batch of documents added (+1) or took away (-1)
  counts    (key_hi, key_lo, refs, first_doc)  exact: for the keys that the batch touched, documents that now hold
                                               the key and the smallest one; the last commit's word on a key holds
  filters   (shard, filter)                    cuckoo filters of the keys that two or more documents hold
  commits   (batch_id, seq, folder, shards, keys, filters)  a batch without a record does not count
A key is the 128-bit hash of a line stripped of ``[\\x20\\x09-\\x0D]`` and with A-Z lower-cased.
A commit inserts the keys that became shared into the stored filters of their shards and deletes those
that no longer are; other shards keep their files. A shard without room is made anew from the exact
table, and all are when keys outgrow the number of shards. An index is opened again by its path, by any
process; of two writers at once the second fails. Earlier documents are never read again, only their
postings of touched keys.

Documents are filtered in two steps: the keys of their lines meet the cuckoo filter of their shard, which
tells almost all unique lines, and the exact table decides the rest, so a false hit of a filter never
drops a line. A shard with many rows, as one with a very frequent line, is dealt over several groups by
document, each with a copy of the filter. Keys of documents that were just added are read from their batch.

Defined cases: null or empty text is one empty line; keys below 10 code points never count; of a
doc_id that comes twice, its rows count as one document; a row with null doc_id keeps all its lines
and adds nothing; removing what was never added leaves no trace; empty tables give empty results.
Other columns are not read. Memory follows the longest text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import BROADCAST_IDS, U64, clear_of, cut, discard, exists, lean, new_path
from .cuckoo import CuckooFilter

WHITE = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MIN_CHARS = 10
SHARD_KEYS = 1 << 18
#: Rows of keys that meet a copy of their shard's filter at once, about.
PROBE_ROWS = 1 << 17
#: Shards whose numbers of groups are broadcast; more meet their rows by a shuffle.
FEW_SHARDS = 200_000
KEYS = "key_hi long, key_lo long, doc_id long"
COUNTS = "key_hi long, key_lo long, refs long, first_doc long"
COMMIT = "batch_id string, seq long, folder string, shards long, keys long, filters map<long,string>"


def line_keys(text: str | None, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """The 128-bit key of each line, None where a line is too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        line = line.strip(WHITE)
        # A code point has four bytes at most.
        long = len(line) >= 4 * min_chars or len(line) >= min_chars and len(line.decode("utf-8", "surrogatepass")) >= min_chars
        out.append(xxhash.xxh3_128_digest(line.translate(LOWER)) if long else None)
    return out


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pair = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).astype(np.int64)
    return pair[:, 0], pair[:, 1]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, ids = [], []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            own = set(line_keys(text.as_py()))
            own.discard(None)
            keys.extend(own)
            ids.extend([i] * len(own))
        hi, lo = _halves(keys)
        yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(ids, pa.int64())], names=["key_hi", "key_lo", "doc_id"])


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def postings(docs: DataFrame) -> DataFrame:
    return _plain(docs).where("doc_id is not null").mapInArrow(lean(_keys), KEYS)


def _new_filter(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The filter of one shard, from all its shared keys; a shard has SHARD_KEYS keys, about."""
    made = CuckooFilter.of(rows["key_lo"].to_numpy())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "filter": pa.array([made.to_bytes()], pa.binary())})


def _changed_filter(key: tuple[pa.Scalar, ...], changes: pa.Table, old: pa.Table) -> pa.Table:
    """A shard's stored filter with the keys that became shared and without those that no longer are; empty where it has no room."""
    shard, lo, up = key[0].as_py(), changes["key_lo"].to_numpy().astype(U64), changes["shared"].to_numpy(zero_copy_only=False)
    stored = CuckooFilter.from_bytes(old["filter"][0].as_py()) if old.num_rows else CuckooFilter(len(lo))
    for k in lo[~up].tolist():
        stored.remove(k)
    fits = stored.room() >= up.sum() and stored.add_all(lo[up])
    return pa.table({"shard": pa.array([shard], pa.int64()), "filter": pa.array([stored.to_bytes() if fits else b""], pa.binary())})


def _probe(key: tuple[pa.Scalar, ...], rows: pa.Table, filters: pa.Table) -> pa.Table:
    """The rows whose key the filter of their shard may hold."""
    rows = rows.select(["doc_id", "key_hi", "key_lo"])
    if not filters.num_rows or not rows.num_rows:
        return rows.slice(0, 0)
    held = CuckooFilter.from_bytes(filters["filter"][0].as_py())
    return rows.filter(pa.array(held.contains(rows["key_lo"].to_numpy().astype(U64))))


def _shard_of(shards: int):
    return F.shiftright("key_hi", 20).bitwiseAND(F.lit(shards - 1)).cast("long")


def _shard(shards: int):
    return _shard_of(shards).alias("shard")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, n_lines, n_dropped = [], [], []
        for text, drop in zip(batch.column("text"), batch.column("drop"), strict=True):
            text = text.as_py() or ""
            lines = text.split("\n")
            n_lines.append(len(lines))
            if drop.is_valid and len(drop):
                gone = set(drop.as_py())
                lines = [line for line, k in zip(lines, line_keys(text), strict=True) if k is None or k not in gone]
                text = "\n".join(lines)
            n_dropped.append(n_lines[-1] - len(lines))
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])


class LineIndex:
    """Exact counts of lines with cuckoo filters before them. add() and remove() are each other's inverse.

    A batch is committed once: a batch_id that was committed already changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        """Opens the index of that path, or begins one; without a path it begins one in the shared folder."""
        self.spark, self.path = spark, path or new_path(spark, "lines")

    def commits(self) -> list:
        """The commits in order, a small row each."""
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        return self.spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{self.path}/commits").orderBy("seq").collect()

    def add(self, docs: DataFrame, batch_id: str) -> None:
        self._commit(docs, batch_id, 1)

    def remove(self, docs: DataFrame, batch_id: str) -> None:
        """Takes documents away that were added before; docs needs their doc_id and text."""
        self._commit(docs, batch_id, -1)

    def counts(self, done: list | None = None) -> DataFrame:
        """(key_hi, key_lo, refs, first_doc) of all keys that some document holds: of each key what was said last."""
        done = self.commits() if done is None else done
        if not done:
            return self.spark.createDataFrame([], COUNTS)
        said = lambda c: self.spark.read.schema(COUNTS).parquet(f"{c.folder}/counts")
        if len(done) == 1:
            return said(done[0]).where("refs > 0")
        every = None
        for c in done:
            part = said(c).withColumn("seq", F.lit(c.seq))
            every = part if every is None else every.union(part)
        last = every.groupBy("key_hi", "key_lo").agg(F.max(F.struct("seq", "refs", "first_doc")).alias("s"))
        return last.select("key_hi", "key_lo", "s.refs", "s.first_doc").where("refs > 0")

    def _commit(self, docs: DataFrame, batch_id: str, sign: int) -> None:
        done = self.commits()
        if any(c.batch_id == batch_id for c in done):
            return
        folder = f"{self.path}/data/{len(done)}-{uuid.uuid4().hex}"
        given = postings(docs).withColumn("delta", F.lit(sign))
        if sign < 0:  # only what is held can be taken away
            given = cut(given.distinct(), "given")
            held = self._live(done, given.select("key_hi", "key_lo").distinct())
            given = given.join(held, ["key_hi", "key_lo", "doc_id"], "left_semi")
        given.write.parquet(f"{folder}/postings")
        new = self._postings(folder)
        tally = F.count("*").alias("refs"), F.min("doc_id").alias("first_doc")
        if not done:
            fresh = new.distinct() if self._repeats(docs) else new
            fresh.groupBy("key_hi", "key_lo").agg(*tally).write.parquet(f"{folder}/counts")
        else:
            touched = cut(new.select("key_hi", "key_lo").distinct(), "touched")
            live = self._live(done, touched, new)
            now = touched.join(live.groupBy("key_hi", "key_lo").agg(*tally), ["key_hi", "key_lo"], "left")
            now.select("key_hi", "key_lo", F.coalesce("refs", F.lit(0)).alias("refs"), "first_doc").write.parquet(f"{folder}/counts")
        fresh = self.spark.read.schema(COUNTS).parquet(f"{folder}/counts")
        if not done:
            keys = fresh.where("refs > 1").count()
            shards, files = self._all_filters(fresh, keys, folder)
        else:
            was = self.counts(done).join(touched, ["key_hi", "key_lo"], "left_semi").select("key_hi", "key_lo", F.col("refs").alias("was"))
            turned = fresh.join(was, ["key_hi", "key_lo"], "left").where((F.col("refs") > 1) != (F.coalesce("was", F.lit(0)) > 1))
            turned = cut(turned.select("key_hi", "key_lo", (F.col("refs") > 1).alias("shared")), "turned")
            sums = turned.agg(F.count_if("shared"), F.count_if(~F.col("shared"))).first()
            keys, shards, files = done[-1].keys + sums[0] - sums[1], done[-1].shards, dict(done[-1].filters)
            if keys > 4 * shards * SHARD_KEYS:
                shards, files = self._all_filters(self._with(done, fresh), keys, folder)
            elif sums[0] + sums[1]:
                files = self._some_filters(turned, self._with(done, fresh), shards, files, folder)
            discard(touched)
            discard(turned)
        record = self.spark.createDataFrame([(batch_id, len(done), folder, shards, keys, files)], COMMIT)
        record.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/commits/{len(done)}")

    def _postings(self, folder: str) -> DataFrame:
        return self.spark.read.schema(f"{KEYS}, delta int").parquet(f"{folder}/postings")

    def _live(self, done: list, keys: DataFrame, new: DataFrame | None = None) -> DataFrame:
        """(key_hi, key_lo, doc_id) that stand after the commits and the new postings, of these keys. A document holds a key that it was given more often than it lost it."""
        few = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
        held = self.spark.createDataFrame([], f"{KEYS}, delta int") if new is None else new.distinct()
        for c in done:
            held = held.union(self._postings(c.folder).join(few, ["key_hi", "key_lo"], "left_semi").distinct())
        return held.groupBy("key_hi", "key_lo", "doc_id").agg(F.sum("delta").alias("n")).where("n > 0").drop("n")

    def _with(self, done: list, fresh: DataFrame) -> DataFrame:
        """The counts as they are with a batch that has no record yet."""
        return self.counts(done).join(fresh, ["key_hi", "key_lo"], "left_anti").union(fresh.where("refs > 0"))

    def _all_filters(self, counts: DataFrame, keys: int, folder: str) -> tuple[int, dict[int, str]]:
        shards = 1 << max(0, keys // SHARD_KEYS).bit_length()
        keyed = counts.where("refs > 1").select(_shard(shards), "key_lo")
        keyed.groupBy("shard").applyInArrow(_new_filter, "shard long, filter binary").write.parquet(f"{folder}/filters")
        made = self.spark.read.schema("shard long, filter binary").parquet(f"{folder}/filters")
        return shards, {r.shard: f"{folder}/filters" for r in made.select("shard").collect()}

    def _some_filters(self, turned: DataFrame, counts: DataFrame, shards: int, files: dict[int, str], folder: str) -> dict[int, str]:
        """New files for the shards that a batch changes; a file of several shards is read for its own only."""
        changes = turned.select(_shard(shards), "key_lo", "shared")
        hit = [r.shard for r in changes.select("shard").distinct().collect()]
        old = self._stored({s: files[s] for s in hit if s in files})
        made = changes.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_changed_filter, "shard long, filter binary")
        made = cut(made, "changed")
        full = made.where(F.length("filter") == 0).select("shard")
        again = counts.where("refs > 1").select(_shard(shards), "key_lo").join(F.broadcast(full), "shard", "left_semi").groupBy("shard").applyInArrow(_new_filter, "shard long, filter binary")
        made.where(F.length("filter") > 0).union(again).write.parquet(f"{folder}/filters")
        discard(made)
        return files | dict.fromkeys(hit, f"{folder}/filters")

    def _stored(self, files: dict[int, str]) -> DataFrame:
        """(shard, filter) of these shards, each from the file that a commit names for it."""
        out = self.spark.createDataFrame([], "shard long, filter binary")
        for path in sorted(set(files.values())):
            own = [s for s, p in files.items() if p == path]
            out = out.union(self.spark.read.schema("shard long, filter binary").parquet(path).where(F.col("shard").isin(own)))
        return out

    @staticmethod
    def _repeats(docs: DataFrame) -> bool:
        """Whether a doc_id comes twice, so that rows must not be counted as documents."""
        return bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))

    def _keys_of(self, docs: DataFrame, batch_id: str | None) -> DataFrame:
        """(key_hi, key_lo, doc_id) of docs; of a batch that added just these, as it was written."""
        if batch_id is not None:
            for c in self.commits():
                if c.batch_id == batch_id:
                    return self._postings(c.folder).drop("delta")
            raise ValueError(f"there is no batch {batch_id!r}")
        return cut(postings(docs), "keys")

    def _probed(self, keys: DataFrame, shards: int, stored: DataFrame) -> DataFrame:
        """The rows of keys that the stored filters may hold."""
        sharded = keys.withColumn("shard", _shard_of(shards))
        groups = sharded.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("groups"))
        groups = F.broadcast(groups) if shards <= FEW_SHARDS else groups
        rows = sharded.join(groups, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int"))
        copies = stored.join(groups, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        given = rows.select("shard", "part", "doc_id", "key_hi", "key_lo").groupBy("shard", "part")
        return given.cogroup(copies.select("shard", "part", "filter").groupBy("shard", "part")).applyInArrow(_probe, "doc_id long, key_hi long, key_lo long")

    def drops(self, docs: DataFrame, batch_id: str | None = None) -> DataFrame:
        """(doc_id, drop): the keys that each document must lose, as 16-byte strings. batch_id: the batch that added just these documents, if one did."""
        done = self.commits()
        if not done:
            return self.spark.createDataFrame([], "doc_id long, drop array<binary>")
        maybe = self._probed(self._keys_of(docs, batch_id), done[-1].shards, self._stored(done[-1].filters))
        exact = maybe.join(self.counts(done).where("refs > 1"), ["key_hi", "key_lo"]).where("doc_id <> first_doc")
        key = F.concat(*(F.to_binary(F.lpad(F.hex(c), 16, "0"), F.lit("hex")) for c in ("key_hi", "key_lo")))
        return exact.select("doc_id", key.alias("key")).groupBy("doc_id").agg(F.collect_set("key").alias("drop"))

    def dedup(self, docs: DataFrame, batch_id: str | None = None) -> DataFrame:
        """docs -> (doc_id, text, n_lines, n_dropped), one row for each row of docs, text without its dropped lines; batch_id as of drops."""
        drops = cut(self.drops(docs, batch_id), "drops")
        return _plain(docs).join(drops, "doc_id", "left").mapInArrow(lean(_rewrite), "doc_id long, text string, n_lines long, n_dropped long")

    def rewrite(self, docs: DataFrame, batch_id: str | None = None) -> DataFrame:
        """All columns of docs, whatever their names, each row's text without its dropped lines; a null text stays null; batch_id as of drops."""
        id_, drop = clear_of(docs.columns, "line_id", "line_drop")
        drops = cut(self.drops(docs, batch_id), "drops").select(F.col("doc_id").alias(id_), F.col("drop").alias(drop))
        met = docs.join(drops, docs["doc_id"].cast("long") == drops[id_], "left").drop(id_)
        return met.mapInArrow(lean(_rewrite_in_place(drop)), docs.schema)


def _rewrite_in_place(drop: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [n for n in batch.schema.names if n != drop]
            text = batch.column("text")
            pair = pa.RecordBatch.from_arrays([text, text, batch.column(drop)], names=["doc_id", "text", "drop"])
            texts = pc.if_else(text.is_null(), pa.scalar(None, pa.string()), next(_rewrite(iter([pair]))).column("text"))
            yield pa.RecordBatch.from_arrays([texts.cast(text.type) if n == "text" else batch.column(n) for n in names], names=names)

    return run


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Line dedup of one table: all its documents are added to an empty index and filtered by it."""
    index = LineIndex(docs.sparkSession)
    index.add(docs, "all")
    return index.dedup(docs, "all")
