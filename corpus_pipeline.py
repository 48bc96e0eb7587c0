"""A corpus pipeline out of the operators of threadloom.llm.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of documents, and any others.

Defined cases: null and empty texts are clean, have no lines to lose, are linked with nothing, weigh
nothing (so the mix takes none of them) and would encode to the end id; a null doc_id is never a
copy; a null source is a source of its own; repeated rows stay until near copies are dropped and, as
they have one id, beyond it; an empty table stays empty in each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import core, line_dedup, minhash, mixing, pieces, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    model = toxicity.train(docs, core.table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that an earlier document holds; documents stay, n_chars follows the text (of a null text it stays)."""
    index = line_dedup.LineIndex(spark)
    index.add(docs, "all")
    n_chars = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return index.rewrite(docs, "all").withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (0.8 or more) the document with the smallest id stays."""
    groups = minhash.near_duplicates(docs, percent=80)
    gone = core.cut(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= core.BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the end id."""
    return pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Toxicity is a trained model and encoding has no SQL: the pipeline is tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole table of documents."""
    docs = core.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = core.cut(stage(spark, docs, sf_dir), name)
    return docs
