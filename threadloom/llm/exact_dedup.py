"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame only.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Rows are
counted by the length of the normalised text and a hash of its first 64 code points, both made where a
row is read; rows of lengths that occur once, and then of prefixes that do, are done. Only the others
have their whole text hashed with SHA-256 and are grouped by it. Groups above a hundred-thousandth of all
such rows, of which there are fewer than a hundred thousand, meet their rows by a broadcast, so no hot
digest is shuffled. Of equal texts the row with most code points in the original text stays, then the
smallest doc_id. Texts are never shuffled, only these keys are.

Defined cases: a null text counts as empty, and all such texts are equal; a null doc_id loses each
tie; of fully repeated rows each one with the doc_id that stays is kept, as nothing tells them
apart; a long text is hashed by itself where it is read; an empty table gives no rows. Only doc_id and
text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import BROADCAST_IDS, cut, discard

PREFIX = 64
HOT, MANY = 1_000, 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_duplicates(docs: DataFrame, hash_all: bool = False) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, keep_id, group_size, kept, text_sha256), one row for each row.

    text_sha256 is null for rows that were told apart before their whole text was needed, unless
    hash_all asks for the digest of each row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("normal", normalised(F.col("text")))
    rows = rows.select("doc_id", "normal", F.length("text").alias("cps"), F.length("normal").alias("len"), F.xxhash64(F.substring("normal", 1, PREFIX)).alias("prefix"))
    counts = cut(rows.groupBy("len", "prefix").agg(F.count("*").alias("n")), "counts")
    lengths = counts.groupBy("len").agg(F.sum("n").alias("m")).where("m > 1").select("len")
    rivals = cut(counts.where("n > 1").join(lengths, "len", "left_semi").select("len", "prefix", F.lit(True).alias("rival")), "rivals")
    n = rivals.count()
    told = rows.join(F.broadcast(rivals) if n <= BROADCAST_IDS else rivals, ["len", "prefix"], "left")
    sha = F.sha2(F.col("normal").cast("binary"), 256)
    told = cut(told.select("doc_id", "cps", "rival", (sha if hash_all else F.when(F.col("rival"), sha)).alias("text_sha256")), "told")
    discard(counts)
    alone = told.where("rival is null").select("doc_id", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("size"))
    told = told.where("rival")  # only these join by their digest, which each of them has
    order = F.struct((-F.col("cps")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("id"))
    groups = told.groupBy("text_sha256").agg(F.min(order).alias("best"), F.count("*").alias("size")).where("size > 1")
    groups = cut(groups, "groups")
    hot_size = max(HOT, told.count() // MANY)
    hot = F.broadcast(groups.where(F.col("size") > hot_size))
    met = told.join(hot, "text_sha256").select("doc_id", "text_sha256", "best", "size")
    cold = told.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(groups.where(F.col("size") <= hot_size), "text_sha256", "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.id"))
    out = met.union(cold.select("doc_id", "text_sha256", "best", "size")).select("doc_id", "text_sha256", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    out = out.union(alone)
    return out.select("doc_id", "keep_id", F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
