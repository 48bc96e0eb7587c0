"""Token counts as rollups that are kept up by signed deltas.

State in the shared folder; each commit has data folders of its own:
  batch   (doc_id, source, lang, version, docs, tokens)  what a batch says of the ids it touches; docs 0: gone
  ledger  (bucket, doc_id, source, lang, version, docs, tokens)  what holds now, in buckets of a hash of the id
  deltas  (source, lang, version, docs, tokens)          what the batch adds to the totals, signed
  commits (batch_id, seq, deltas, buckets)               written last; a batch without it does not count
A batch is inserts, deletes and revisions. For the ids it touches, what the ledger holds is taken
away and what the batch holds is added, so totals are sums of deltas and nothing is counted twice.
Only the buckets that a batch touches are read and written anew; a commit names the folder of each
bucket, so earlier batches are never read again. Committing a batch_id again changes nothing; a batch
that broke off is written anew when it is sent again. Of two writers at once the second fails, and
sends its batch again.

Defined cases: null text has no tokens but counts as a document; null source or language is a group;
a null doc_id can be inserted only; repeated rows of a batch add up, and a delete beside an insert or
revision of the same id in one batch gives way; deleting an unknown id does
nothing, revising one inserts it; op is read without regard to case and outer blanks, and a row whose
op is null or none of the three changes nothing; an empty batch commits without deltas. Other columns
are not read. Memory follows the longest text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import cut, discard, exists, new_path

LEDGER = "doc_id long, source string, lang string, version string, docs long, tokens long"
WORDS = "words"
OPS = ("insert", "delete", "revise")
DELTAS = "source string, lang string, version string, docs long, tokens long"
COMMIT = "batch_id string, seq long, deltas string, buckets map<int,string>"
BUCKETS = 32
_ENCODINGS: dict = {}


def rank_file(path: str) -> bytes:
    """A file of ranks (base64 and number on each line), as bytes to be sent to executors."""
    with open(path, "rb") as f:
        return f.read()


def _encoding(pattern: str, data: bytes):
    import base64

    import tiktoken

    key = hash(data)
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        _ENCODINGS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def _count(tokenizers: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {}
        for version, sent in tokenizers.items():
            if sent is None:
                counters[version] = lambda text: len(text.encode("utf-8", "replace").split())
            else:
                pattern, data = sent
                counters[version] = lambda text, e=_encoding(pattern, data.value): len(e.encode_ordinary(text))
        for batch in batches:
            op = batch.column("op").to_pylist()
            keep = pa.array([i for i, x in enumerate(op) if x != "delete"], pa.int64())
            texts = [x.as_py() or "" for x in batch.column("text").take(keep)]
            keys = [batch.column(c).take(keep) for c in ("doc_id", "source", "lang")]
            for version, count in counters.items():
                n = len(texts)
                yield pa.RecordBatch.from_arrays([*keys, pa.array([version] * n, pa.string()), pa.array([1] * n, pa.int64()), pa.array([count(x) for x in texts], pa.int64())], names=["doc_id", "source", "lang", "version", "docs", "tokens"])

    return run


class TokenRollup:
    """Totals of documents and tokens by source, language and tokenizer version.

    tokenizers: version -> None for words between ``[\\x20\\x09-\\x0D]``, or (pattern, path of a rank file).
    """

    def __init__(self, spark: SparkSession, tokenizers: dict[str, tuple[str, str] | None] | None = None, path: str | None = None, buckets: int = BUCKETS):
        """buckets of a ledger that exists are as it was made; path is a folder that all executors see."""
        self.spark, self.path = spark, path or new_path(spark, "tokens")
        given = {WORDS: None} if tokenizers is None else tokenizers
        self.tokenizers = {v: x and (x[0], spark.sparkContext.broadcast(rank_file(x[1]))) for v, x in given.items()}
        at = f"{self.path}/made"
        if not exists(spark, at):
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(at)
        self.buckets = spark.read.schema("buckets int").parquet(at).first().buckets

    def _commits(self) -> list:
        """The commits in order, a small row each."""
        if not exists(self.spark, f"{self.path}/commits"):
            return []
        return self.spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{self.path}/commits").orderBy("seq").collect()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """changes (op: insert, delete or revise; doc_id, source, lang, text). False if it was committed before."""
        done = self._commits()
        if any(c.batch_id == batch_id for c in done):
            return False
        seq, folder = len(done), f"{self.path}/data/{len(done)}-{uuid.uuid4().hex}"
        held: dict[int, str] = dict(done[-1].buckets) if done else {}
        changes = changes.select(F.lower(F.trim("op")).alias("op"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        changes = changes.where(F.col("op").isin(*OPS) & (F.col("doc_id").isNotNull() | (F.col("op") == "insert")))
        counted = changes.mapInArrow(_count(self.tokenizers), LEDGER)
        gone = changes.where("op = 'delete'").select("doc_id", *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "version")), F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("tokens"))
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")
        counted.union(gone).withColumn("bucket", bucket).write.parquet(f"{folder}/batch")
        new = self.spark.read.schema(f"{LEDGER}, bucket int").parquet(f"{folder}/batch")
        known = new.where("doc_id is not null")
        touched = [r.bucket for r in known.select("bucket").distinct().collect()]  # no more than buckets
        signed = new.where("docs > 0").select("source", "lang", "version", "docs", "tokens")
        rows = known.where("docs > 0").select("bucket", "doc_id", "source", "lang", "version", "docs", "tokens")
        if old := [f"{held[b]}/bucket={b}" for b in touched if b in held]:
            ids = known.select("doc_id").distinct().withColumn("hit", F.lit(True))
            before = self.spark.read.schema(LEDGER).parquet(*old).join(ids, "doc_id", "left")
            before = cut(before.withColumn("bucket", bucket), "before")
            signed = signed.union(before.where("hit").select("source", "lang", "version", -F.col("docs"), -F.col("tokens")))
            rows = rows.union(before.where("hit is null").select(rows.columns))
        signed.groupBy("source", "lang", "version").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0").write.parquet(f"{folder}/deltas")
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/ledger")
        if old:
            discard(before)
        left = {r.bucket for r in self.spark.read.schema(f"{LEDGER}, bucket int").parquet(f"{folder}/ledger").select("bucket").distinct().collect()}
        for b in touched:
            held.pop(b, None)
            if b in left:
                held[b] = f"{folder}/ledger"
        record = self.spark.createDataFrame([(batch_id, seq, f"{folder}/deltas", held)], COMMIT)
        record.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/commits/{seq}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens) of what is committed; groups without documents are left out."""
        done = self._commits()
        if not done:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long")
        deltas = self.spark.read.schema(DELTAS).parquet(*(c.deltas for c in done))
        out = deltas.groupBy("source", "lang", F.col("version").alias("tokenizer_version")).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return out.where("n_docs <> 0 or n_tokens <> 0")
