"""Scans and sinks: zipped CSV archives, JSON documents, keyed maps, Markdown tables."""

from __future__ import annotations

import csv
import io
import math
import os
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, new_path


def unzip_once(archive: str, staging: str, name: str = "twcs.csv") -> str:
    """The one CSV of that name in a local archive, unpacked beside a temporary name and renamed."""
    with zipfile.ZipFile(archive) as z:
        found = [x for x in z.namelist() if os.path.basename(x) == name]
        if len(found) != 1:
            raise ValueError(f"the archive holds {len(found)} files named {name}")
        os.makedirs(staging, exist_ok=True)
        target = os.path.join(staging, name)
        if not os.path.exists(target):
            with z.open(found[0]) as src, open(f"{target}.part", "wb") as out:
                while block := src.read(1 << 20):
                    out.write(block)
            os.replace(f"{target}.part", target)
    return target


COLUMNS = ("tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an unpacked CSV archive, typed; texts may hold line breaks and doubled quotes. Spark reads such a file in one task; read_zip does not."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return _typed(raw)


def _typed(raw: DataFrame) -> DataFrame:
    ids = F.transform(T.id_list(F.coalesce("response_tweet_id", F.lit(""))), lambda x: F.try_to_number(x, F.lit("9999999999999999999")).cast("bigint"))
    parent = F.trim(F.coalesce("in_response_to_tweet_id", F.lit("")))
    return raw.select(
        F.col("tweet_id").cast("bigint").alias("tweet_id"), "author_id", (F.lower("inbound") == "true").alias("inbound"), T.archive_time(F.col("created_at")).alias("created_at"), "text",
        ids.alias("response_ids"), F.when(parent != "", parent).cast("bigint").alias("parent_id"),
    )


def read_zip(spark: SparkSession, path: str, name: str = "twcs.csv", chunk: int = 4 << 20) -> DataFrame:
    """Rows of the one CSV of that name in a zipped archive that Spark can read, typed; no file is unpacked to a local folder."""
    return _typed(quoted_csv(zip_member(spark, path, name, chunk), COLUMNS))


def zip_member(spark: SparkSession, path: str, name: str, chunk: int = 4 << 20) -> DataFrame:
    """(pos, data): the bytes of the one member of that name in pieces of `chunk` bytes, in a table. A zipped stream can be unpacked in one task only; the archive itself, zipped, has to be below 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    found = [x for x in z.namelist() if os.path.basename(x) == name]
                    if len(found) != 1:
                        raise ValueError(f"the archive holds {len(found)} files named {name}")
                    with z.open(found[0]) as member:
                        pos = 0
                        while data := member.read(chunk):
                            yield pa.RecordBatch.from_arrays([pa.array([pos]), pa.array([data], pa.binary())], names=["pos", "data"])
                            pos += 1

    chunks = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "pos long, data binary")
    out = new_path(spark, "chunks")
    chunks.write.option("parquet.block.size", 2 * chunk).parquet(out)  # so that later tasks read a few pieces each
    return spark.read.schema("pos long, data binary").parquet(out)


#: Pieces whose running state is worked out in one group; the states of the groups are scanned before.
GROUP = 4096
#: What a piece tells: its quotes, and for a beginning outside and inside of quotes where its first and last records end (-1: none does).
_TOLD = "pos long, quotes long, first0 long, last0 long, first1 long, last1 long"


def _breaks(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(quotes, ends of lines outside of quotes if the piece begins outside, and if it begins inside)."""
    raw = np.frombuffer(data, np.uint8)
    seen = np.cumsum(raw == ord('"'))
    ends = np.flatnonzero(raw == ord("\n"))
    inside = seen[ends] % 2 == 1
    return int(seen[-1]) if len(seen) else 0, ends[~inside] + 1, ends[inside] + 1


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for pos, data in zip(batch.column("pos").to_pylist(), batch.column("data"), strict=True):
            quotes, *ends = _breaks(data.as_py())
            rows.append((pos, quotes, *(int(e[i]) if len(e) else -1 for e in ends for i in (0, -1))))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in _TOLD.split(", ")])


def _scanned(told: DataFrame) -> DataFrame:
    """(pos, first, last, owner): where the records of a piece lie, by the quotes before it, and the last piece before it in which a record ends (-1: none)."""
    grouped = told.withColumn("grp", F.floor(F.col("pos") / GROUP))

    def before(name: str, fold, start: int, rows: DataFrame) -> DataFrame:
        """rows with what fold gives over all earlier rows: within groups, and over groups before."""
        groups = rows.groupBy("grp").agg(fold(F.col("x_")).alias("g_"))
        earlier = groups.select("grp", fold(F.col("g_")).over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)).alias("h_"))
        own = fold(F.col("x_")).over(Window.partitionBy("grp").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        both = rows.withColumn("o_", own).join(earlier, "grp").withColumn("a_", F.array("o_", "h_"))
        known = F.filter("a_", lambda x: x.isNotNull())
        total = F.aggregate(known, F.lit(start).cast("long"), lambda a, x: a + x) if fold is F.sum else F.coalesce(F.array_max(known), F.lit(start))
        return both.withColumn(name, total).drop("x_", "o_", "h_", "a_")

    inside = before("quotes_before", F.sum, 0, grouped.withColumn("x_", F.col("quotes")))
    odd = F.col("quotes_before") % 2 == 1
    placed = inside.withColumns({"first": F.when(odd, F.col("first1")).otherwise(F.col("first0")), "last": F.when(odd, F.col("last1")).otherwise(F.col("last0"))})
    return before("owner", F.max, -1, placed.withColumn("x_", F.when(F.col("last") >= 0, F.col("pos")))).select("pos", "first", "last", "owner")


def _records(data: bytes) -> list[list[str]]:
    csv.field_size_limit(1 << 30)
    return [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")) if r]


def _fields(rows: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["fields"])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records that begin and end in one piece."""
    for batch in batches:
        for data, first, last in zip(batch.column("data"), batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True):
            if 0 <= first < last:
                yield _fields(_records(data.as_py()[first:last]))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each piece: a beginning that belongs to a record of an earlier piece, an end whose record goes on."""
    for batch in batches:
        out = []
        for pos, data, first, last, owner in zip(*(batch.column(c).to_pylist() for c in ("pos", "data", "first", "last", "owner")), strict=True):
            out += [(owner, pos, data[:first] if first >= 0 else data)] + ([(pos, pos, data[last:])] if last >= 0 else [])
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["owner", "pos", "data"])


def _joined(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
    """The record that goes over pieces, from its parts in order; a piece's own end comes before later beginnings."""
    rows = sorted(zip(parts["pos"].to_pylist(), parts["data"].to_pylist(), strict=True))
    return pa.Table.from_batches([_fields(_records(b"".join(d for _, d in rows)))])


def quoted_csv(chunks: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """chunks (pos, data) of one UTF-8 CSV with a header -> the named columns as strings; fields may be quoted and then hold line breaks and doubled quotes.

    Whether a piece begins inside of quotes follows from the number of quotes before it: pieces are counted apart, the
    counts scanned, and then each piece is cut where its records end. Records that go over pieces are put together from their
    parts. Columns that the header lacks are null; quotes may stand in quoted fields only.
    """
    spans = cut(_scanned(cut(chunks.mapInArrow(_told, _TOLD), "told")), "spans")
    placed = chunks.join(spans, "pos")
    whole = placed.mapInArrow(_bodies, "fields array<string>")
    edges = cut(placed.mapInArrow(_edges, "owner long, pos long, data binary"), "edges")
    # A record that ends where its piece does has an empty rest; the header is the record before the first end.
    over = edges.where("owner >= 0").groupBy("owner").applyInArrow(_joined, "fields array<string>")
    top = edges.where("owner < 0").groupBy("owner").applyInArrow(_joined, "fields array<string>").first()
    header = [x.strip() for x in top.fields] if top else []
    at = {c: header.index(c) for c in columns if c in header}
    return whole.union(over).select(*(F.get("fields", F.lit(at[c])).alias(c) if c in at else F.lit(None).cast("string").alias(c) for c in columns))


def stage(rows: DataFrame, path: str) -> DataFrame:
    """Rows as Parquet, written once, for all later passes."""
    rows.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents under a given schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_keyed(spark: SparkSession, path: str, field: str, value: str, key: str) -> DataFrame:
    """A document whose field maps ids to structs -> one row for each id."""
    doc = spark.read.schema(f"{field} map<string, struct<{value}>>").json(path, multiLine=True)
    return doc.select(F.explode(field).alias(key, "v")).select(key, "v.*")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; a NaN in any floating column is an error, found before anything is written."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    if floats:
        bad = F.lit(False)
        for c in floats:
            bad = bad | F.isnan(c)
        if df.where(bad).limit(1).count():
            raise ValueError("a value is not a number")
    df.write.mode("errorifexists").json(path)


def markdown(report: DataFrame, title: str = "", most: int = 10_000) -> str:
    """A report as a Markdown table, floats with three digits, null as a dash. A report of more rows than `most` is an error, as it is made on the driver."""

    def cell(x) -> str:
        if x is None or isinstance(x, float) and math.isnan(x):
            return "–"
        return f"{x:.3f}" if isinstance(x, float) else str(x)

    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the report has more than {most} rows")
    lines = [f"## {title}", ""] if title else []
    lines += ["| " + " | ".join(report.columns) + " |", "|" + "---|" * len(report.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def worksheet(examples: DataFrame, ids: list[str]) -> str:
    """The named examples in the given order as a sheet with blanks to fill in."""
    order = examples.sparkSession.createDataFrame(list(enumerate(ids)), "ord int, tweet_id string")
    rows = order.join(examples.select("tweet_id", "message"), "tweet_id", "left").orderBy("ord").collect()
    return "\n".join(f"### {r.ord + 1}. {r.tweet_id}\n\n{r.message or '(absent)'}\n\nIntent: ____  Route: ____  Reason: ____\n" for r in rows)
