"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import cut, discard


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free sum of hashes: equal marks mean equal edge sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these neighbours."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (u, v): component is the least node reachable.

    Edges with a null end are left out; loops and repeats change nothing; no edges: no rows. Each
    round is written to the shared folder. No node's neighbours meet in one row or task: hubs are
    handled by an aggregate with partial sums and a join that Spark can split.
    """
    now = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        after = cut(small_star(large_star(now)), "edges")
        discard(now)
        before, mark, now = mark, _mark(after), after
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
