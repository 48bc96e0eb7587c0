"""All queries of the library by name, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import modelcall, threads
from ..session import cut
from . import pipelines, relational_queries, report_queries, text_queries
from .relational_queries import _number as number


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.offline_evaluation(spark, sf_dir)


def agent_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns through the gated agent: earlier turns as context, the most similar answered turns of other conversations as evidence, offline client."""
    turns = relational_queries._turns(spark, sf_dir)
    pairs = threads.reply_pairs(turns).select(F.col("customer_id").alias("id"), F.col("customer_text").alias("message"), F.col("support_text").alias("reply"))
    asked = cut(turns.where("inbound").select("id", F.col("text").alias("message"), "conv_id", F.col("ts").alias("turn")), "asked")
    found = pipelines.Precedents.of(pairs).found(asked.select("id", F.coalesce("message", F.lit("")).alias("text")), 5, "query.conv_id <> id.conv_id", lambda id: number(id).cast("string"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, -1)
    context = turns.select("id", "conv_id", F.col("ts").alias("turn"), "text").withColumn("context", F.collect_list("text").over(before)).select("id", "context")
    examples = asked.join(context, "id").join(found, "id", "left").select(number(F.col("id")).alias("id"), "message", "context", F.lit(False).alias("context_flagged"), F.coalesce(F.col("evidence").cast(pipelines.RECORDS), F.array().cast(pipelines.RECORDS)).alias("evidence"))
    out = pipelines.gated_agent(examples, client=modelcall.offline_citing_stub)
    return out.select("id", "intent", "route", "reason", "draft", "reply_kind", "model", "api_error", "evidence_ids", "output_check_violations", "style_version")


QUERIES = {**text_queries.QUERIES, **relational_queries.QUERIES, **report_queries.QUERIES, "offline_evaluation": flagship, "agent_run": agent_run}
ORACLE_SQL = {**text_queries.ORACLE_SQL, **relational_queries.ORACLE_SQL, **report_queries.ORACLE_SQL}
