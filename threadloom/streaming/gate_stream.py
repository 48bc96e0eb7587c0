"""The gate over a stream: an extension; the rules hold no state, so a stream is gated like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.gate import gate

SCHEMA = "id long, message string, intent string, route string, reason string, draft string, evidence_ids array<string>, reply_kind string, allowed_ids array<string>, context_flagged boolean"


def gated_stream(spark: SparkSession, folder: str, copy: dict[str, str] | None = None) -> DataFrame:
    """Model outputs that arrive as JSON files in a folder, gated."""
    return gate(spark.readStream.schema(SCHEMA).json(folder), copy)


def run_available(gated: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived, each file once, and ends."""
    query = gated.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
