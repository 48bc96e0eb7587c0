"""Samples by seeded hash ranks: the same rows whatever the partitions are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def hash_key(seed: int, *columns: str) -> Column:
    """An order that looks random and can be told again: MD5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def numbered(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """A number from 1 in the order of columns, over all rows, without ordering them in one task.

    Rows are dealt by ranges and written; each range counts on from the number of rows before it.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    inside = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return parts.join(F.broadcast(start), "part_").withColumn(name, (F.col("start_") + inside).cast("long")).drop("part_", "start_")


def hash_rank(df: DataFrame, key: str, seed: int = 42, by: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """A rank from 1 in hash order, within each group of `by` if given."""
    if not by:
        return numbered(df.withColumn("hash_", hash_key(seed, key)), "hash_", key, name=name).drop("hash_")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(hash_key(seed, key), key)))


def sample_per_group(df: DataFrame, key: str, by: tuple[str, ...], n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, fewer where there are fewer."""
    return hash_rank(df, key, seed, by).where(F.col("rank") <= n).drop("rank")


def one_per_group(df: DataFrame, key: str, by: tuple[str, ...], seed: int = 42) -> DataFrame:
    return sample_per_group(df, key, by, 1, seed)


def quota(df: DataFrame, rank: str, quotas: dict[str, int]) -> DataFrame:
    """Rows in rank order fill the named quotas one after the other; the rest is left out."""
    first = df.orderBy(rank).limit(sum(quotas.values())).withColumn("place_", F.row_number().over(Window.orderBy(rank)))
    split, upto = F.when(F.lit(False), ""), 0
    for name, n in quotas.items():
        upto += n
        split = split.when(F.col("place_") <= upto, name)
    return first.withColumn("split", split).drop("place_")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """A batch number from 0 for each `size` rows in order."""
    return numbered(df, order, name="n_").withColumn("batch", F.floor((F.col("n_") - 1) / size).cast("int")).drop("n_")
