"""The live agent: messages that arrive as files are answered by batches, each with retrieval, calls and the gate.

A batch is answered by the same plan as a table. Its rows are written beside and get the batch's name at once: a batch
that is tried again after a fault finds its name taken and does nothing, or writes the same rows anew. Answers of the
model are in the ledger before they are used, so a batch that is tried again does not ask for them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import Ledger
from ..plans.pipelines import Precedents, answered

MESSAGES = "id string, message string, context array<string>, context_flagged boolean"


def commit_batch(rows: DataFrame, out: str, batch: int) -> bool:
    """Writes a batch once; false if it stands already."""
    spark = rows.sparkSession
    make = spark._jvm.org.apache.hadoop.fs.Path
    final, part = make(f"{out}/batch={batch}"), make(f"{out}/_part-{uuid.uuid4().hex}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        return False
    rows.write.parquet(part.toString())
    if not fs.rename(part, final):
        fs.delete(part, True)
        if not fs.exists(final):
            raise OSError(f"{part} could not be named {final}")
        return False
    return True


def live_agent(spark: SparkSession, folder: str, out: str, checkpoint: str, precedents: Precedents, ledger: Ledger, files: int = 100, **options) -> StreamingQuery:
    """Answers the messages (see MESSAGES) that have arrived as JSON files in a folder, up to `files` of them a batch, and ends."""
    arrived = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files).json(folder)

    def each(messages: DataFrame, batch: int) -> None:
        commit_batch(answered(messages, precedents, ledger=ledger, **options), out, batch)

    query = arrived.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
