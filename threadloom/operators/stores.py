"""Label and rating stores as append-only events; manifests; published versions."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import content_hash
from ..schemas import DIMENSIONS, FLAGS, INTENTS, LABEL, REASONS, ROUTES


def latest(events: DataFrame, key: str, at: str = "updated_at") -> DataFrame:
    """The last event of each key; ties go to the greatest row."""
    rest = [c for c in events.columns if c not in (key, at)]
    return events.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("e")).select(key, *(F.col(f"e.{c}").alias(c) for c in rest), F.col(f"e.{at}").alias(at))


def label_violations(labels: DataFrame, known: DataFrame, key: str = "tweet_id") -> DataFrame:
    """(key, violations) of labels with values outside their domains or ids that are not known."""
    bad = lambda c, domain: F.when(~F.coalesce(F.col(c), F.lit("")).isin("", *domain), f"invalid {c}")
    tests = F.array(F.when(F.col("known_").isNull(), "unknown id"), bad("intent", INTENTS), bad("route", ROUTES), bad("reason", REASONS), bad("flag", FLAGS))
    out = labels.join(known.select(key).distinct().withColumn("known_", F.lit(True)), key, "left")
    return out.select(key, F.filter(tests, lambda x: x.isNotNull()).alias("violations")).where(F.size("violations") > 0)


def complete_labels(labels: DataFrame) -> DataFrame:
    return labels.where("coalesce(intent, '') <> '' and coalesce(route, '') <> ''")


def rating_violations(ratings: DataFrame) -> DataFrame:
    """(rating_id, violations): scores that are neither blank nor 0, 1, 2, and flags that are neither blank nor boolean."""
    bad = [F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "1", "2"), f"invalid {c}") for c in DIMENSIONS]
    bad.append(F.when(~F.lower(F.coalesce(F.col("critical_failure").cast("string"), F.lit(""))).isin("", "true", "false"), "invalid critical_failure"))
    return ratings.select("rating_id", F.filter(F.array(*bad), lambda x: x.isNotNull()).alias("violations")).where(F.size("violations") > 0)


def drift(old: dict, new: dict, keys: tuple[str, ...]) -> list[str]:
    """Names of settings that a frozen manifest holds otherwise."""
    return [k for k in keys if old.get(k) != new.get(k)]


def freeze(spark: SparkSession, path: str, manifest: dict, keys: tuple[str, ...]) -> None:
    """Writes a manifest once; a later run with other settings is an error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        held = {r["key"]: r["value"] for r in spark.read.json(path, "key string, value string").collect()}
        if changed := drift(held, {k: str(v) for k, v in manifest.items()}, keys):
            raise ValueError(f"run settings changed: {changed}; choose another folder")
        return
    spark.createDataFrame([(k, str(v)) for k, v in sorted(manifest.items())], "key string, value string").coalesce(1).write.mode("errorifexists").json(path)


def packet_id(rows: DataFrame, *order: str, most: int = 100_000) -> str:
    """SHA-256 over the rows in order, each by its own hash of all columns; for packets to be labelled, so more rows than `most` are an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"a packet has {most} rows at most")
    hashed = rows.select(F.struct(*order).alias("k"), content_hash(*rows.columns).alias("h"))
    ordered = hashed.agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("a"))
    return ordered.select(F.sha2(F.array_join(F.transform("a", lambda x: x["h"]), ""), 256).alias("id")).first().id


def publish(df: DataFrame, path: str) -> None:
    """Replaces a table by a renamed new version; the former one stays beside it as `.bak`. Snapshots has no moment without a table; this has one between two renames.

    A rename that the file system refuses is an error, and the former table is put back. The older backup goes last.
    """
    spark = df.sparkSession
    make, mark = spark._jvm.org.apache.hadoop.fs.Path, uuid.uuid4().hex
    fresh, final, backup, older = make(f"{path}.{mark}"), make(path), make(f"{path}.bak"), make(f"{path}.bak.{mark}")
    df.write.mode("errorifexists").parquet(fresh.toString())
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        if fs.exists(backup) and not fs.rename(backup, older):
            raise OSError(f"{backup} could not be moved away")
        if not fs.rename(final, backup):
            raise OSError(f"{final} could not be moved away")
    if not fs.rename(fresh, final):
        if fs.exists(backup):
            fs.rename(backup, final)
        raise OSError(f"{fresh} could not be put in the place of {final}")
    fs.delete(older, True)


class LabelStore:
    """Labels as a log of events: updates, restorations and compacted states, each a folder that is written whole and never changed.

    The state after an event is what a replay of the log up to it gives. packet (tweet_id) names what may be labelled; packet_id and
    guide tell which packet and which guide the labels are for, and an export of others is refused. Events are numbered from 1;
    a writer that finds its number taken fails and leaves nothing.
    """

    FIELDS = ("intent", "route", "reason", "flag", "notes")
    ROW = f"tweet_id string, {LABEL}"

    def __init__(self, spark: SparkSession, path: str, packet: DataFrame, packet_id: str, guide: str):
        self.spark, self.path, self.packet, self.packet_id, self.guide = spark, path.rstrip("/"), packet.select(F.col("tweet_id").cast("string").alias("tweet_id")), packet_id, guide

    def log(self) -> list:
        """(seq, kind, base) of the events in order; base: the event that a restoration goes back to, or up to which a state is compacted."""
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        top = make(f"{self.path}/events")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(top)]
        found = [n.split("-") for n in names if n[0] not in "._"]
        return sorted((int(seq), kind, int(base)) for seq, kind, base in found)

    def _write(self, rows: DataFrame, kind: str, base: int) -> int:
        """An event's folder, complete as soon as it has its name."""
        seq = max((s for s, _, _ in self.log()), default=0) + 1
        make = self.spark._jvm.org.apache.hadoop.fs.Path
        part, final = (make(f"{self.path}/{x}") for x in (f"_part-{uuid.uuid4().hex}", f"events/{seq:012d}-{kind}-{base}"))
        fs = part.getFileSystem(self.spark._jsc.hadoopConfiguration())
        rows.coalesce(1).write.parquet(part.toString())
        fs.mkdirs(final.getParent())
        if any(s >= seq for s, _, _ in self.log()) or not fs.rename(part, final):
            fs.delete(part, True)
            raise Conflict(f"{self.path} has an event {seq} already")
        return seq

    def _rows(self, event: tuple) -> DataFrame:
        seq, kind, base = event
        return self.spark.read.schema(self.ROW).parquet(f"{self.path}/events/{seq:012d}-{kind}-{base}")

    def update(self, labels: DataFrame) -> int:
        """Appends labels (tweet_id, intent, route, ..., updated_at); one that breaks a domain or is outside the packet refuses all of them. Gives the event's number."""
        given = [F.col(c).cast("string").alias(c) if c in labels.columns else F.lit(None).cast("string").alias(c) for c in ("tweet_id", *self.FIELDS, "updated_at")]
        rows = labels.select(*given)
        bad = label_violations(rows, self.packet).limit(20).collect()
        if bad:
            raise ValueError("; ".join(f"{r.tweet_id}: {', '.join(r.violations)}" for r in bad))
        return self._write(rows, "update", 0)

    def state(self, upto: int | None = None) -> DataFrame:
        """(tweet_id, fields, updated_at): of each id the last label, as of an event (the last one by default). Later events win; within one the later updated_at."""
        log = [e for e in self.log() if upto is None or e[0] <= upto]
        while log and log[-1][1] == "restore":  # the state is that of the event that was gone back to
            target = log[-1][2]
            log = [e for e in log if e[0] <= target]
        begin = max((i for i, (_, kind, _) in enumerate(log) if kind in ("restore", "state")), default=None)
        parts = []
        if begin is not None:
            seq, kind, base = log[begin]
            before = self.state(base) if kind == "restore" else self._rows(log[begin])
            parts.append(before.withColumn("seq_", F.lit(seq)))
            log = log[begin + 1 :]
        parts += [self._rows(e).withColumn("seq_", F.lit(e[0])) for e in log if e[1] == "update"]
        every = self.spark.createDataFrame([], f"{self.ROW}, seq_ int")
        for p in parts:
            every = every.unionByName(p)
        last = every.groupBy("tweet_id").agg(F.max(F.struct("seq_", "updated_at", *self.FIELDS)).alias("e"))
        return last.select("tweet_id", *(F.col(f"e.{c}").alias(c) for c in (*self.FIELDS, "updated_at")))

    def restore(self, seq: int) -> int:
        """Goes back to the state after an event, as an event of its own."""
        if seq and seq not in {s for s, _, _ in self.log()}:
            raise ValueError(f"there is no event {seq}")
        return self._write(self.spark.createDataFrame([], self.ROW), "restore", seq)

    def compact(self) -> int:
        """Writes the present state as an event, from which later states are worked out."""
        last = max((s for s, _, _ in self.log()), default=0)
        return self._write(self.state(), "state", last)

    def complete(self) -> bool:
        """Whether all of the packet has an intent and a route."""
        return self.packet.join(complete_labels(self.state()), "tweet_id", "left_anti").isEmpty()

    def export(self, path: str) -> None:
        """The present state as JSON lines, with what it is for."""
        told = self.state().withColumns({"packet_id": F.lit(self.packet_id), "guide_version": F.lit(self.guide)})
        told.write.mode("errorifexists").json(path)

    def load(self, path: str) -> int:
        """Makes an export the present state, if it is for this packet and guide and keeps the rules."""
        rows = self.spark.read.schema(f"{self.ROW}, packet_id string, guide_version string").json(path)
        other = rows.where(~(F.col("packet_id").eqNullSafe(F.lit(self.packet_id)) & F.col("guide_version").eqNullSafe(F.lit(self.guide))))
        if not other.isEmpty():
            raise ValueError("the export is for another packet or guide")
        bad = label_violations(rows, self.packet).limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0].tweet_id}: {', '.join(bad[0].violations)}")
        return self._write(rows.select("tweet_id", *self.FIELDS, "updated_at"), "state", 0)


class Conflict(Exception):
    """Another writer has published since the version that this one began from."""


class Snapshots:
    """A table as numbered versions: data in folders that never change, and a log with one entry for each version.

    A version counts from the moment when its entry gets its name, which the file system does at once and refuses if the
    name is taken; so readers always find a whole table, and of two writers with the same number the later one is told.
    A reader is pinned to the version that it read, until vacuum takes that version away.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._make = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._make(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        log = self._make(f"{self.path}/log")
        if not self._fs.exists(log):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(log))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def latest(self) -> int:
        """The number of the last version; 0 before the first."""
        return max(self.versions(), default=0)

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._make(f"{self.path}/log/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last one by default; later versions do not change what this gives."""
        entry = self._entry(self.latest() if version is None else version)
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self.path}/{entry['folder']}")

    def publish(self, df: DataFrame, after: int | None = None) -> int:
        """Writes a version and gives its number. after: the version that df was made from; Conflict if it is no longer the last."""
        after = self.latest() if after is None else after
        folder = f"data/{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.path}/{folder}")
        try:
            return self._commit(after + 1, {"folder": folder, "schema": json.loads(df.schema.json())})
        except Conflict:
            self._fs.delete(self._make(f"{self.path}/{folder}"), True)
            raise

    def restore(self, version: int) -> int:
        """Makes an earlier version the last one again, as a new entry for the same data."""
        return self._commit(self.latest() + 1, self._entry(version))

    def _commit(self, version: int, entry: dict) -> int:
        jvm = self.spark._jvm
        final, part = self._make(f"{self.path}/log/{version:020d}.json"), self._make(f"{self.path}/log/.{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            if self._fs.exists(final) or version != self.latest() + 1:
                raise Conflict(f"{self.path} has version {self.latest()}, not {version - 1}")
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
            try:
                context.rename(self._fs.makeQualified(part), self._fs.makeQualified(final), options)
            except Py4JJavaError as e:
                if "FileAlreadyExists" in str(e.java_exception):
                    raise Conflict(f"{self.path} has a version {version} already") from None
                raise
        finally:
            self._fs.delete(part, False)
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Takes away all versions but the last `keep`, entries first, and data that none of the rest names (also of writers that broke off)."""
        if keep < 1:
            raise ValueError("the last version stays")
        every = self.versions()
        for v in every[:-keep]:
            self._fs.delete(self._make(f"{self.path}/log/{v:020d}.json"), False)
        named = {self._entry(v)["folder"] for v in every[-keep:]}
        data = self._make(f"{self.path}/data")
        for f in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if f"data/{f.getPath().getName()}" not in named:
                self._fs.delete(f.getPath(), True)
