"""Queries over predictions, ratings and raters; each with its SQL.

The tables hold no predictions, so both sides make the same ones: a rule over text lengths predicts
labels.quality, routes follow toxicity, and two raters score documents by arithmetic on ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rates import wilson
from ..operators import classify, gate, metrics, stores
from ..schemas import DIMENSIONS, INTENTS
from ..session import table

QUERIES, ORACLE_SQL = {}, {}
_CLASSES = ("0", "1", "2")  # 2 never occurs: an absent class counts


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    gold = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("truth"), F.when(F.col("toxic") == 1, "escalate").otherwise("auto_handle").alias("gold_route"))
    said = docs.withColumns({"predicted": F.when(F.col("n_chars") > 600, "1").otherwise("0"), "route": F.when(F.col("n_chars") % 3 == 0, "auto_handle").otherwise("escalate"), "split": F.when(F.col("doc_id") % 4 == 0, "dev").otherwise("test")})
    return said.join(gold, "doc_id")


_ROWS = """r AS (SELECT d.doc_id, d.source, d.lang, quality::VARCHAR AS truth, CASE WHEN toxic = 1 THEN 'escalate' ELSE 'auto_handle' END AS gold_route, CASE WHEN n_chars > 600 THEN '1' ELSE '0' END AS predicted,
  CASE WHEN n_chars % 3 = 0 THEN 'auto_handle' ELSE 'escalate' END AS route, CASE WHEN d.doc_id % 4 = 0 THEN 'dev' ELSE 'test' END AS split FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_REPORT = f"""{_ROWS},
c AS (SELECT * FROM (VALUES ('0'), ('1'), ('2')) AS v(class)),
m AS (SELECT s.split, c.class, count(*) FILTER (WHERE r.truth = c.class AND r.predicted = c.class) AS tp, count(*) FILTER (WHERE r.predicted = c.class) AS said, count(*) FILTER (WHERE r.truth = c.class) AS support
  FROM (SELECT DISTINCT split FROM r) s CROSS JOIN c LEFT JOIN r ON r.split = s.split GROUP BY s.split, c.class),
p AS (SELECT split, class, coalesce(tp::DOUBLE / nullif(said, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(said + support, 0), 0) AS f1, support FROM m)"""


def _report(spark: SparkSession, d: str) -> DataFrame:
    classes = spark.createDataFrame([(c,) for c in _CLASSES], "class string")
    return metrics.per_class(_rows(spark, d), classes, ("split",))


@query(f"WITH {_REPORT} SELECT split, class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM p")
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).select("split", "class", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {_REPORT} SELECT split, round(avg(f1), 9) AS macro_f1 FROM p GROUP BY split")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_f1(_report(spark, d), ("split",)).select("split", F.round("macro_f1", 9).alias("macro_f1"))


_WILSON = "CASE WHEN {n} > 0 THEN round({f}({b}, (({s}::DOUBLE / {n} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n})) {sign} 1.96 * sqrt({s}::DOUBLE / {n} * (1 - {s}::DOUBLE / {n}) / {n} + 3.8416 / (4 * {n}::DOUBLE * {n})) / (1 + 3.8416 / {n})), 9) END"
_LOW = _WILSON.format(n="{n}", s="{s}", f="greatest", b="0.0", sign="-")
_HIGH = _WILSON.format(n="{n}", s="{s}", f="least", b="1.0", sign="+")


@query(f"""
WITH {_ROWS}, g AS (SELECT split, lang, count(*) AS n, count(*) FILTER (WHERE truth = predicted) AS ok, count(*) FILTER (WHERE route = 'auto_handle') AS a, count(*) FILTER (WHERE gold_route = 'escalate') AS need,
  count(*) FILTER (WHERE gold_route = 'escalate' AND route = 'escalate') AS caught, count(*) FILTER (WHERE gold_route = 'escalate' AND route = 'auto_handle') AS d FROM r GROUP BY split, lang)
SELECT split, lang, n, round(ok::DOUBLE / n, 9) AS accuracy, a AS auto_count, round(a::DOUBLE / n, 9) AS auto_coverage, need AS escalation_required, round(caught::DOUBLE / nullif(need, 0), 9) AS escalation_recall, d AS disagreements,
  round(d::DOUBLE / nullif(a, 0), 9) AS disagreement_rate, {_LOW.format(n='a', s='d')} AS wilson_low, {_HIGH.format(n='a', s='d')} AS wilson_high FROM g""")
def routing_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.routing(_rows(spark, d), ("split", "lang"))
    floats = [c for c, t in out.dtypes if t == "double"]
    return out.select(*(F.round(c, 9).alias(c) if c in floats else c for c in out.columns))


@query(f"""WITH t AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS s FROM documents GROUP BY source) SELECT source, {_LOW.format(n='n', s='s')} AS low, {_HIGH.format(n='n', s='s')} AS high FROM t""")
def wilson_interval(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("s"))
    low, high = wilson(F.col("s"), F.col("n"))
    return t.select("source", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("SELECT coalesce(CASE WHEN turn % 3 = 0 THEN NULL ELSE role END, 'unknown') AS reply_kind, count(*) AS n FROM conversations GROUP BY 1")
def reply_kind_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.kind_counts(table(spark, d, "conversations").select(F.when(F.col("turn") % 3 != 0, F.col("role")).alias("reply_kind")))


@query(f"WITH {_ROWS} SELECT doc_id, truth, predicted, gold_route, route FROM r WHERE split <> 'dev' AND (truth <> predicted OR gold_route <> route)")
def error_rows(spark: SparkSession, d: str) -> DataFrame:
    return metrics.error_rows(_rows(spark, d)).select("doc_id", "truth", "predicted", "gold_route", "route")


_AUDIT = "(SELECT doc_id, CASE WHEN quality = 1 THEN 'safe_clarification' WHEN toxic = 1 THEN 'sensitive_safety' ELSE 'supported_general_help' END AS reason, CASE WHEN toxic = 1 OR doc_id % 5 = 0 THEN 'escalate' ELSE 'auto_handle' END AS route FROM labels)"


@query(f"SELECT doc_id, reason, route FROM {_AUDIT} WHERE ((reason LIKE 'safe\\_%' ESCAPE '\\' OR reason LIKE 'supported\\_%' ESCAPE '\\') AND route = 'escalate') OR (reason NOT LIKE 'safe\\_%' ESCAPE '\\' AND reason NOT LIKE 'supported\\_%' ESCAPE '\\' AND route = 'auto_handle')")
def label_audit(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("quality") == 1, "safe_clarification").when(F.col("toxic") == 1, "sensitive_safety").otherwise("supported_general_help")
    route = F.when((F.col("toxic") == 1) | (F.col("doc_id") % 5 == 0), "escalate").otherwise("auto_handle")
    return metrics.label_audit(table(spark, d, "labels").select("doc_id", reason.alias("reason"), route.alias("route")))


@query("""SELECT doc_id FROM documents WHERE n_chars % 7 = 0 OR (n_chars > 600 AND n_chars <= 900)""")
def replay_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old = docs.select("doc_id", F.lit("a").alias("draft"), F.when(F.col("n_chars") > 600, "auto_handle").otherwise("escalate").alias("route"))
    new = docs.select("doc_id", F.when(F.col("n_chars") % 7 == 0, F.lit(None).cast("string")).otherwise("a").alias("draft"), F.when(F.col("n_chars") > 900, "auto_handle").otherwise("escalate").alias("route"))
    return gate.replay_diff(old, new, "doc_id").select("doc_id")


@query("SELECT source AS label, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, min(doc_id) LIMIT 1")
def majority_baseline(spark: SparkSession, d: str) -> DataFrame:
    return classify.majority(table(spark, d, "documents").select(F.col("source").alias("label"), "doc_id"), "label", "doc_id")


@query()
def classifier_fit(spark: SparkSession, d: str) -> DataFrame:
    """Languages predicted from texts: dev rows train, all rows are predicted."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), F.when(F.col("doc_id") % 4 == 0, "dev").otherwise("test").alias("split"))
    return classify.IntentClassifier(docs.where("split = 'dev'")).predict(docs).join(docs.select("id", "label", "split"), "id")


# ---- raters ---------------------------------------------------------------------------------

_SCORES = {"correctness": 7, "grounding": 5, "usefulness": 11, "routing_privacy": 13}


def _rater(spark: SparkSession, d: str, shift: int) -> DataFrame:
    docs = table(spark, d, "documents")
    score = lambda k: F.when((F.col("doc_id") + shift) % 17 == 0, None).otherwise((F.floor(F.col("doc_id") * k / 3) + F.when(F.col("n_chars") % 4 == 0, shift).otherwise(0)) % 3).cast("int")
    return docs.select(F.col("doc_id").cast("string").alias("rating_id"), "source", *(score(k).alias(c) for c, k in _SCORES.items()), F.when(F.col("doc_id") % 19 == 0, None).otherwise((F.col("n_chars") + shift) % 6 == 0).alias("critical_failure"))


def _rater_sql(shift: int) -> str:
    each = ", ".join(f"CASE WHEN (doc_id + {shift}) % 17 = 0 THEN NULL ELSE ((doc_id * {k}) // 3 + CASE WHEN n_chars % 4 = 0 THEN {shift} ELSE 0 END) % 3 END::INTEGER AS {c}" for c, k in _SCORES.items())
    return f"(SELECT doc_id::VARCHAR AS rating_id, source, {each}, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE (n_chars + {shift}) % 6 = 0 END AS critical_failure FROM documents)"


_AGREE = " UNION ALL ".join(
    f"""SELECT '{c}' AS dimension, count(*) AS n, round(avg((a.{c} = b.{c})::INT), 9) AS exact_agreement, round(1 - avg(abs(a.{c} - b.{c})) / (
  SELECT sum(abs(i.x - j.y) * i.n * j.n)::DOUBLE / (sum(i.n * j.n)) FROM (SELECT a.{c} AS x, count(*) AS n FROM h a JOIN j b USING (rating_id) WHERE a.{c} IS NOT NULL AND b.{c} IS NOT NULL GROUP BY 1) i,
  (SELECT b.{c} AS y, count(*) AS n FROM h a JOIN j b USING (rating_id) WHERE a.{c} IS NOT NULL AND b.{c} IS NOT NULL GROUP BY 1) j), 9) AS weighted_kappa
  FROM h a JOIN j b USING (rating_id) WHERE a.{c} IS NOT NULL AND b.{c} IS NOT NULL"""
    for c in DIMENSIONS
)


@query(f"WITH h AS (SELECT * FROM {_rater_sql(0)}), j AS (SELECT * FROM {_rater_sql(1)}) {_AGREE}")
def weighted_kappa(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.agreement(_rater(spark, d, 0), _rater(spark, d, 1))
    return out.select("dimension", "n", F.round("exact_agreement", 9).alias("exact_agreement"), F.round("weighted_kappa", 9).alias("weighted_kappa"))


@query(f"""
WITH p AS (SELECT h.critical_failure AS h, j.critical_failure AS j FROM {_rater_sql(0)} h JOIN {_rater_sql(1)} j USING (rating_id) WHERE h.critical_failure IS NOT NULL AND j.critical_failure IS NOT NULL)
SELECT count(*) AS pairs, round(avg((h = j)::INT), 9) AS exact_agreement, count(*) FILTER (WHERE h AND NOT j) AS missed, count(*) FILTER (WHERE h) AS human_critical,
  round((count(*) FILTER (WHERE h AND j))::DOUBLE / nullif(count(*) FILTER (WHERE h), 0), 9) AS recall FROM p""")
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.critical_agreement(_rater(spark, d, 0), _rater(spark, d, 1))
    return out.select("pairs", F.round("exact_agreement", 9).alias("exact_agreement"), "missed", "human_critical", F.round("recall", 9).alias("recall"))


_TOTAL = " + ".join(DIMENSIONS)
_PASS = f"coalesce(least({', '.join(DIMENSIONS)}) >= 1 AND NOT critical_failure AND {_TOTAL} >= 6, false)"
_DONE = " AND ".join(f"{c} IS NOT NULL" for c in (*DIMENSIONS, "critical_failure"))


@query(f"SELECT rating_id, {_PASS} AS passed FROM {_rater_sql(0)} WHERE {_DONE}")
def overall_pass(spark: SparkSession, d: str) -> DataFrame:
    return metrics.complete(_rater(spark, d, 0)).select("rating_id", metrics.overall_pass().alias("passed"))


@query(f"""SELECT source, count(*) AS n, {', '.join(f'round(avg({c}), 9) AS mean_{c}' for c in DIMENSIONS)}, count(*) FILTER (WHERE {_PASS}) AS pass_count, round(avg({_PASS}::INT), 9) AS pass_rate,
  count(*) FILTER (WHERE critical_failure) AS critical_count, round(avg(critical_failure::INT), 9) AS critical_rate FROM {_rater_sql(0)} WHERE {_DONE} GROUP BY source""")
def rating_summary(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.rating_summary(metrics.complete(_rater(spark, d, 0)), "source")
    return out.select(*(F.round(c, 9).alias(c) if t == "double" else c for c, t in out.dtypes))


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE {_PASS}) AS pass_count, count(*) FILTER (WHERE {_TOTAL} < 8) AS nonperfect_count, count(*) FILTER (WHERE critical_failure) AS critical_failure_count
  FROM {_rater_sql(0)} WHERE {_DONE}""")
def fresh_report(spark: SparkSession, d: str) -> DataFrame:
    done = metrics.complete(_rater(spark, d, 0))
    return metrics.fresh_report(done, done.count()).select("n", "pass_count", "nonperfect_count", "critical_failure_count")


@query(f"SELECT rating_id, NOT {_PASS} AS failed, critical_failure AS critical FROM {_rater_sql(0)} WHERE {_DONE} AND ({_TOTAL} < 8 OR NOT {_PASS})")
def fresh_failures(spark: SparkSession, d: str) -> DataFrame:
    return metrics.fresh_failures(_rater(spark, d, 0))


@query("""WITH r AS (SELECT d.doc_id, n_chars % 7 = 0 AS changed, toxic = 1 AS critical FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT count(*) AS n, count(*) FILTER (WHERE changed) AS drafts_changed, count(*) FILTER (WHERE critical) AS previously_critical, count(*) FILTER (WHERE changed AND critical) AS previously_critical_changed FROM r""")
def replay_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    new = docs.select("doc_id", F.when(F.col("n_chars") % 7 == 0, F.lit(None).cast("string")).otherwise("a").alias("draft"))
    return gate.replay_summary(docs.select("doc_id", F.lit("a").alias("draft")), new, "doc_id", table(spark, d, "labels").where("toxic = 1").select("doc_id"))


@query("""SELECT conv_id, last_role, last_text FROM (SELECT conv_id, role AS last_role, md5(text) AS last_text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""")
def store_latest(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("last_role"), F.md5("text").alias("last_text"))
    return stores.latest(events, "conv_id", "turn").select("conv_id", "last_role", "last_text")


_NAMES = ", ".join(f"'{i}'" for i in INTENTS)


@query(f"SELECT doc_id::VARCHAR AS tweet_id, concat_ws(',', CASE WHEN doc_id % 9 = 0 THEN 'unknown id' END, CASE WHEN lang NOT IN ('', {_NAMES}) AND lang <> 'en' THEN 'invalid intent' END) AS violations FROM documents WHERE doc_id % 9 = 0 OR lang <> 'en'")
def label_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("tweet_id", F.col("doc_id").cast("string"))
    labels = docs.select("tweet_id", F.when(F.col("lang") == "en", INTENTS[0]).otherwise(F.col("lang")).alias("intent"), F.lit("escalate").alias("route"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("flag"))
    return stores.label_violations(labels, docs.where("doc_id % 9 <> 0")).select("tweet_id", F.array_join("violations", ",").alias("violations"))
