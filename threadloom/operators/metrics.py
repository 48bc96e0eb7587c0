"""Reports: classification, routing, agreement of raters, ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import rate_or_null, rate_or_zero, wilson
from ..schemas import DIMENSIONS


def joined_gold(predictions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Predictions with their gold rows; a prediction without one is an error."""
    missing = predictions.join(gold, key, "left_anti").limit(1).count()
    if missing:
        raise ValueError("a prediction has no gold label")
    return predictions.join(gold, key)


def per_class(pairs: DataFrame, classes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pairs (truth, predicted, *by), classes (class) -> precision, recall, f1 and support of each class.

    Every class of the dimension has a row in every group, those that never occur with zeros.
    """
    counts = pairs.groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"))
    counts = counts.withColumn("side", F.explode(F.array(F.struct(F.lit("t").alias("k"), F.col("truth").alias("class")), F.struct(F.lit("p").alias("k"), F.col("predicted").alias("class")))))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("side.k") == k, F.col("n"))), F.lit(0))
    hit = F.coalesce(F.sum(F.when((F.col("side.k") == "t") & (F.col("truth") == F.col("predicted")), F.col("n"))), F.lit(0))
    found = counts.groupBy(*by, F.col("side.class").alias("class")).agg(hit.alias("tp"), of("p").alias("said"), of("t").alias("support"))
    every = pairs.select(*by).distinct().crossJoin(F.broadcast(classes)) if by else classes
    out = every.join(found, [*by, "class"], "left").fillna(0, ["tp", "said", "support"])
    precision, recall = rate_or_zero(F.col("tp"), F.col("said")), rate_or_zero(F.col("tp"), F.col("support"))
    f1 = rate_or_zero(2 * F.col("tp"), F.col("said") + F.col("support"))
    return out.select(*by, "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.col("support").cast("long").alias("support"))


def macro_f1(report: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean of f1 over all classes of the report, absent ones included."""
    return report.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def routing(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """rows (truth, predicted, route, gold_route, *by) -> accuracy and routing figures of each group."""
    auto, need = F.col("route") == "auto_handle", F.col("gold_route") == "escalate"
    n = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("predicted")).alias("right"), F.count_if(auto).alias("auto_count"),
        F.count_if(need).alias("escalation_required"), F.count_if(need & (F.col("route") == "escalate")).alias("caught"), F.count_if(auto & need).alias("disagreements"),
    )
    low, high = wilson(F.col("disagreements"), F.col("auto_count"))
    return n.select(
        *by, "n", rate_or_null(F.col("right"), F.col("n")).alias("accuracy"), "auto_count", rate_or_null(F.col("auto_count"), F.col("n")).alias("auto_coverage"), "escalation_required",
        rate_or_null(F.col("caught"), F.col("escalation_required")).alias("escalation_recall"), "disagreements",
        rate_or_null(F.col("disagreements"), F.col("auto_count")).alias("disagreement_rate"), low.alias("wilson_low"), high.alias("wilson_high"),
    )


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reply_kind", F.lit("unknown")).alias("reply_kind")).agg(F.count("*").alias("n"))


def error_rows(rows: DataFrame) -> DataFrame:
    """Rows outside dev whose intent or route differs from gold."""
    return rows.where((F.col("split") != "dev") & ((F.col("truth") != F.col("predicted")) | (F.col("gold_route") != F.col("route"))))


def label_audit(labels: DataFrame) -> DataFrame:
    """Labels whose reason speaks for one route while they name the other."""
    easy = F.col("reason").startswith("safe_") | F.col("reason").startswith("supported_")
    known = F.coalesce(F.col("reason"), F.lit("")) != ""
    return labels.where(known & ((easy & (F.col("route") == "escalate")) | (~easy & (F.col("route") == "auto_handle"))))


# ---- ratings --------------------------------------------------------------------------------


def typed_ratings(raw: DataFrame) -> DataFrame:
    """Ratings read as text: scores that are 0, 1 or 2 and flags that are true or false; others are null."""
    score = lambda c: F.when(F.expr(f"try_cast({c} as int)").isin(0, 1, 2), F.expr(f"try_cast({c} as int)"))
    keep = [c for c in raw.columns if c not in (*DIMENSIONS, "critical_failure")]
    return raw.select(*keep, *(score(c).alias(c) for c in DIMENSIONS), F.expr("try_cast(critical_failure as boolean)").alias("critical_failure"))


def complete(ratings: DataFrame) -> DataFrame:
    holds = F.col("critical_failure").isNotNull()
    for c in DIMENSIONS:
        holds = holds & F.col(c).isin(0, 1, 2)
    return ratings.where(holds)


def overall_pass():
    """No critical failure, no zero, six of eight at least."""
    total = sum((F.col(c) for c in DIMENSIONS[1:]), F.col(DIMENSIONS[0]))
    valid = F.least(*DIMENSIONS) >= 1
    return F.coalesce(valid & ~F.coalesce("critical_failure", F.lit(False)) & (total >= 6), F.lit(False))


def rating_summary(ratings: DataFrame, by: str = "system") -> DataFrame:
    passed = overall_pass()
    return ratings.groupBy(by).agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in DIMENSIONS), F.count_if(passed).alias("pass_count"), F.avg(passed.cast("int")).alias("pass_rate"),
        F.count_if("critical_failure").alias("critical_count"), F.avg(F.col("critical_failure").cast("int")).alias("critical_rate"),
    )


def fresh_report(ratings: DataFrame, expected: int) -> DataFrame:
    """One row of counts and means over complete ratings; too few of them is an error. fresh_failures names the ratings."""
    done = complete(ratings)
    n = done.count()
    if n != expected:
        raise ValueError(f"ratings are incomplete: {n}/{expected}")
    total = sum((F.col(c) for c in DIMENSIONS[1:]), F.col(DIMENSIONS[0]))
    passed = overall_pass()
    return done.agg(
        F.count("*").alias("n"), F.count_if(passed).alias("pass_count"), F.avg(passed.cast("int")).alias("pass_rate"), F.count_if("critical_failure").alias("critical_failure_count"),
        F.count_if(total < 8).alias("nonperfect_count"), *(F.avg(c).alias(f"mean_{c}") for c in DIMENSIONS),
    )


def fresh_failures(ratings: DataFrame) -> DataFrame:
    """(rating_id, failed, critical) of the complete ratings that are not perfect, a row each."""
    total = sum((F.col(c) for c in DIMENSIONS[1:]), F.col(DIMENSIONS[0]))
    return complete(ratings).where((total < 8) | ~overall_pass()).select("rating_id", (~overall_pass()).alias("failed"), F.col("critical_failure").alias("critical"))


def agreement(human: DataFrame, judge: DataFrame) -> DataFrame:
    """Both (rating_id, four scores) -> n, exact agreement and linearly weighted kappa of each dimension.

    kappa = 1 - observed / expected mean distance; null for one pair or fewer, for a single value in
    all, and where the expected distance is 0. Every dimension has a row.
    """
    long = lambda df, name: df.select("rating_id", F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col(d).alias("s")) for d in DIMENSIONS))).alias("x")).select("rating_id", F.col("x.d").alias("dimension"), F.col("x.s").alias(name))
    pairs = long(human, "a").join(long(judge, "b"), ["rating_id", "dimension"]).where("a in (0, 1, 2) and b in (0, 1, 2)")
    at = lambda c, k: F.count_if(F.col(c) == k).cast("double")
    n = pairs.groupBy("dimension").agg(
        F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.sum(F.abs(F.col("a") - F.col("b"))).cast("double").alias("apart"),
        *(at(c, k).alias(f"{c}{k}") for c in "ab" for k in range(3)), F.least(F.min("a"), F.min("b")).alias("low"), F.greatest(F.max("a"), F.max("b")).alias("high"),
    )
    expected = sum((abs(i - j) * F.col(f"a{i}") * F.col(f"b{j}") for i in range(3) for j in range(3) if i != j), F.lit(0.0)) / F.col("n")
    kappa = F.when((F.col("n") > 1) & (F.col("low") < F.col("high")), 1 - F.try_divide(F.col("apart"), expected))
    every = human.sparkSession.createDataFrame([(d,) for d in DIMENSIONS], "dimension string")
    out = every.join(n.select("dimension", "n", rate_or_null(F.col("same"), F.col("n")).alias("exact_agreement"), kappa.alias("weighted_kappa")), "dimension", "left")
    return out.select("dimension", F.coalesce("n", F.lit(0)).alias("n"), "exact_agreement", "weighted_kappa")


def critical_agreement(human: DataFrame, judge: DataFrame) -> DataFrame:
    """Pairs with both flags: agreement, misses and recall of critical failures."""
    pairs = human.select("rating_id", F.col("critical_failure").alias("h")).join(judge.select("rating_id", F.col("critical_failure").alias("j")), "rating_id").where("h is not null and j is not null")
    n = pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("h") == F.col("j")).alias("same"), F.count_if(F.col("h") & ~F.col("j")).alias("missed"), F.count_if("h").alias("human_critical"))
    return n.select("pairs", rate_or_null(F.col("same"), F.col("pairs")).alias("exact_agreement"), "missed", "human_critical", rate_or_null(F.col("human_critical") - F.col("missed"), F.col("human_critical")).alias("recall"))
