"""Mixing of sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words by
weight; a target stops at CAP times its source's size and the excess is shared again by weight, down
to the level at which nothing is above. Sources are numbered by ranges and the level is found by
sums over all sources, so no task holds them all.

Rates: document rates w in [0, CAP] are as near as can be to one copy each, in relative entropy
(sum of w log w - w + 1), with the source's expected words equal to its target. The optimum is an
exponential tilt, w = min(CAP, exp(m * size)), with one multiplier m for each source, the dual's
variable. The dual is convex; Newton iterations with a bracket solve it for all sources at once: in
each, Spark sums value and slope over the histogram (source, size) and moves all multipliers.

Copies: rates are rounded by systematic sampling along falling size: cells of (source, size bin,
hash) have their start from the cells before, so no source is ordered in one task. What a source
still lacks or has too much is made up with single copies of few documents of fitting sizes, a
bounded choice for each source. All sums that decide are of whole numbers, so reruns agree.

Defined cases: null source is a source; null or wordless text has size 0 and takes nothing; an empty
table gives no rows; a null doc_id is a document; of repeated rows each is a document, and a
correction of one falls on all its repeats. Only doc_id, source and text are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from .core import clear_of, cut, discard, n_words

CAP = 3
ONE = 1 << 30  # a whole copy in fixed point
BINS = 8  # for each doubling of the size
CELL, CELLS = 2_000, 4_096  # documents of one cell, about, and the most cells of a bin
CHOICES = 4  # documents of a bin that corrections may choose from
SMALL = 200_000  # rows of a table that is broadcast, some 20 MB; beyond it the join is a shuffle
SUM = 1 << 20  # a word in the dual's sums, which are of whole numbers
ROUNDS, CLOSE = 100, 1e-9


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight and target."""
    ranked = numbered(sources.withColumn("nil_", F.col("source").isNull()), "nil_", "source", name="n_").drop("nil_")
    out = cut(ranked.withColumns({"weight": (F.col("n_") - 1) % 3 + 1, "cap": F.col("source_size") * CAP}).drop("n_"), "weights")
    # Sources at their cap leave the sharing until the level stands; it only rises, and few values are ever met.
    level, full = None, F.lit(False)
    while True:
        every = out.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not every[0] or not every[2]:
            break
        after = (every[0] - (every[1] or 0)) / every[2]
        if after == level:
            break
        level = after
        full = F.col("cap") / F.col("weight") < level
    share = F.col("weight") * F.lit(float(level or 0))
    return out.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), share).alias("target"))


def rate(m: Column, size: Column, mean: Column) -> Column:
    """The tilted rate of a document; m is the exponent at its source's mean size, infinite at a bound."""
    tilt = F.least(F.lit(float(CAP)), F.exp(F.least(F.lit(50.0), m * size / mean)))
    return F.when(size == 0, 0.0).when(m == float("inf"), float(CAP)).when(m == float("-inf"), 0.0).otherwise(tilt)


def multipliers(hist: DataFrame, sources: DataFrame) -> DataFrame:
    """hist (source, size, n), sources (source, source_size, target) -> (of, mean, target, m): the dual's solution of each source.

    Each round is one sum over the histogram and one table of a row for each source.
    """
    hist = hist.where("size > 0")
    s = sources.count()
    size, words = F.col("size"), F.col("size") * F.col("n")
    means = hist.groupBy("source").agg((F.sum(words) / F.sum("n")).alias("mean")).withColumnRenamed("source", "s_")
    now = sources.join(means, F.col("source").eqNullSafe(F.col("s_")), "left").select(F.col("source").alias("of"), F.coalesce("mean", F.lit(1.0)).alias("mean"), "target", "source_size")
    bound = F.when(F.col("target") <= 0, float("-inf")).when(F.col("target") >= CAP * F.col("source_size") * (1 - CLOSE), float("inf"))
    now = cut(now.select("of", "mean", "target", F.coalesce(bound, F.lit(0.0)).alias("m"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high"), bound.isNotNull().alias("done")), "dual")
    for _ in range(ROUNDS):
        if now.where("not done").isEmpty():
            break
        open_ = now.where("not done").select("of", "mean", F.col("m").alias("at"))
        w = rate(F.col("at"), size, F.col("mean"))
        whole = lambda x: F.sum(F.floor(x * SUM).cast("decimal(38,0)"))
        free = F.when(w < CAP, words * w * size / F.col("mean")).otherwise(0.0)
        met = hist.join(_small(open_, s), F.col("source").eqNullSafe(F.col("of")))
        sums = met.groupBy("of").agg((whole(words * w) / SUM).cast("double").alias("value"), (whole(free) / SUM).cast("double").alias("slope")).withColumnRenamed("of", "s_")
        gap = F.col("value") - F.col("target")
        near = F.abs(gap) <= CLOSE * F.col("target") + F.lit(1e-3)
        low, high = F.when(gap < 0, F.col("m")).otherwise(F.col("low")), F.when(gap < 0, F.col("high")).otherwise(F.col("m"))
        step = F.col("m") - F.try_divide(gap, F.col("slope"))
        moved = F.when(step.isNotNull() & (step > low) & (step < high), step).otherwise((low + high) / 2)
        stuck = (high - low) < 1e-13 * F.greatest(F.lit(1.0), F.abs("m"))
        fresh = now.join(_small(sums, s), F.col("of").eqNullSafe(F.col("s_")), "left")
        hold = F.col("done") | F.coalesce(near, F.lit(True))
        fresh = fresh.select("of", "mean", "target", F.when(hold, F.col("m")).otherwise(moved).alias("m"), F.when(hold, F.col("low")).otherwise(low).alias("low"), F.when(hold, F.col("high")).otherwise(high).alias("high"), (hold | stuck).alias("done"))
        after = cut(fresh, "dual")
        discard(now)
        now = after
    return now.select("of", "mean", "target", "m")


def _correct(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Single copies to add or take, largest fitting first, so that a source's words meet its target."""
    rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending")])
    left, ids, change = rows["lack"][0].as_py(), [], []
    for size, doc_id, copies in zip(*(rows[c].to_pylist() for c in ("size", "doc_id", "copies")), strict=True):
        sign = 1 if left > 0 else -1
        if abs(left - sign * size) < abs(left) and 0 <= copies + sign <= CAP:
            ids.append(doc_id)
            change.append(sign)
            left -= sign * size
    return pa.table({"source": pa.array([key[0].as_py()] * len(ids), pa.string()), "doc_id": pa.array(ids, pa.int64()), "change": pa.array(change, pa.int32())})


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL else df


def mix_plan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text) -> (doc_id, source, size, source_size, target, copies), one row for each row."""
    text = F.col("text").cast("string")
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("tie")), "sized")
    hist = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = cut(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "sources")
    s = sources.count()
    known = multipliers(hist, sources).select(F.col("of").alias("s_"), "mean", "m")
    known = cut(sources.join(_small(known, s), F.col("source").eqNullSafe(F.col("s_"))).select(F.col("source").alias("of"), "source_size", "target", "mean", "m"), "multipliers")
    rows = sized.join(_small(known, s), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("fixed", F.least(F.floor(rate(F.col("m"), F.col("size"), F.col("mean")) * ONE).cast("long"), F.lit(CAP * ONE)))
    cells = min(CELLS, max(1, (hist.agg(F.sum("n")).first()[0] or 0) // (CELL * BINS)))
    rows = rows.withColumns({"bin": F.floor(F.log2(F.col("size") + 1) * BINS).cast("int"), "cell": F.pmod("tie", F.lit(cells)).cast("int")})
    rows = rows.withColumn("part", F.col("fixed") % ONE)
    totals = rows.groupBy("source", "bin", "cell").agg(F.sum("part").alias("sum"))
    earlier = Window.partitionBy("source").orderBy(F.desc("bin"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut(totals.select(F.col("source").alias("s_"), F.col("bin").alias("b_"), F.col("cell").alias("c_"), (F.coalesce(F.sum("sum").over(earlier), F.lit(0)) % ONE + ONE // 2).alias("start")), "cells")
    rows = rows.join(_small(totals, totals.count()), F.col("source").eqNullSafe(F.col("s_")) & (F.col("bin") == F.col("b_")) & (F.col("cell") == F.col("c_"))).drop("s_", "b_", "c_")
    inside = Window.partitionBy("source", "bin", "cell").orderBy(F.desc("size"), "tie", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("start") + F.sum("part").over(inside)
    copies = F.floor(F.col("fixed") / ONE) + F.floor(upto / ONE) - F.floor((upto - F.col("part")) / ONE)
    plan = cut(rows.withColumn("copies", F.least(copies, F.lit(CAP)).cast("int")).select("doc_id", "source", "size", "source_size", "target", "copies", "bin"), "plan")

    lack = plan.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("lack"))
    choice = Window.partitionBy("source", "bin").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "copies")
    few = plan.where("size > 0 and doc_id is not null").withColumn("k", F.row_number().over(choice)).where(F.col("k") <= CHOICES)
    few = few.join(_small(lack.withColumnRenamed("source", "of"), s), F.col("source").eqNullSafe(F.col("of"))).select("source", "doc_id", "size", "copies", "lack")
    changes = few.groupBy("source").applyInArrow(_correct, "source string, doc_id long, change int").select(F.col("source").alias("of"), F.col("doc_id").alias("id_"), "change")
    changes = cut(changes.groupBy("of", "id_").agg(F.first("change").alias("change")), "changes")
    out = plan.join(_small(changes, changes.count()), (F.col("doc_id") == F.col("id_")) & F.col("source").eqNullSafe(F.col("of")), "left")
    copies = F.greatest(F.lit(0), F.least(F.lit(CAP), F.col("copies") + F.coalesce("change", F.lit(0)))).cast("int")
    for x in (sized, hist, sources, known, totals):
        discard(x)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the plan says; all columns of docs stay, whatever their names."""
    columns = docs.columns
    of, id_, size, copies, id2, of2, size2, copy = clear_of(columns, "of", "id", "size", "copies", "own_id", "own_of", "own_size", "copy")
    own = [F.col("doc_id").cast("long").alias(id2), F.col("source").cast("string").alias(of2), n_words("text").alias(size2)]
    plan = mix_plan(docs).select(F.col("doc_id").alias(id_), F.col("source").alias(of), F.col("size").alias(size), F.col("copies").alias(copies))
    plan = cut(plan.where(F.col(copies) > 0).groupBy(id_, of, size).agg(F.max(copies).alias(copies)), "copies")
    same = F.col(id2).eqNullSafe(F.col(id_)) & F.col(of2).eqNullSafe(F.col(of)) & (F.col(size2) == F.col(size))
    met = docs.select("*", *own).join(plan, same)
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*columns)
