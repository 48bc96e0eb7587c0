"""Multinomial logistic regression over TF-IDF, with balanced weights, and majority baselines."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import cut, new_path
from .retrieval import VECTOR, TfIdf, term_rows

#: Rows of a training partition: each of many iterations is a job over all partitions.
PARTITION_ROWS = 5000


def train_guard(examples: DataFrame) -> None:
    """Only rows of the dev split may train."""
    if examples.where("split is null or split <> 'dev'").limit(1).count():
        raise ValueError("training may only use development examples")


def majority(labels: DataFrame, label: str, position: str) -> DataFrame:
    """The most common label; of equally common ones the one seen first."""
    counts = labels.groupBy(label).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select(label, "n")


class IntentClassifier:
    """C = 1, class-balanced, no feature scaling: regParam is 1 / (C * n). Classes are in alphabetical order."""

    def __init__(self, examples: DataFrame, max_features: int = 15_000, c: float = 1.0, iterations: int = 1000):
        """examples (id, text, label, split); the fitted terms are bounded by max_features."""
        train_guard(examples)
        examples = cut(examples.select("id", "text", "label"), "examples")
        n = examples.count()
        self.space = TfIdf.fit(examples.select("id", "text"), max_features=max_features)
        spark, size = examples.sparkSession, self.space.idf.count()
        counts = {r.label: r.n for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
        self.classes = sorted(counts)
        dims = spark.createDataFrame([(k, float(i), n / (len(counts) * counts[k])) for i, k in enumerate(self.classes)], "label string, y double, weight double")
        v = F.coalesce("v", F.array().cast(VECTOR))
        by_term = F.sort_array(v)
        sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.transform(by_term, lambda x: (x["t"] - 1).cast("int")).alias("indices"), F.transform(by_term, lambda x: x["w"]).alias("values"))
        rows = examples.join(F.broadcast(dims), "label").join(self.space.weights, "id", "left").select(sparse.alias("features"), "y", "weight")
        path = new_path(spark, "training")
        rows.coalesce(max(1, n // PARTITION_ROWS)).write.parquet(path)
        # The columns of a sparse vector are read again as one.
        schema = StructType([StructField("features", VectorUDT()), StructField("y", DoubleType()), StructField("weight", DoubleType())])
        model = LogisticRegression(labelCol="y", weightCol="weight", regParam=1 / (c * n), elasticNetParam=0, standardization=False, maxIter=iterations, family="multinomial", tol=1e-6)
        self.model: LogisticRegressionModel = model.fit(spark.read.schema(schema).parquet(path))
        self.size, self.start = size, self.model.interceptVector.toArray().tolist()
        self.pull = cut(spark.createDataFrame([(t + 1, x) for t, x in enumerate(self.model.coefficientMatrix.toArray().T.tolist())], "t long, pull array<double>"), "coefficients")

    def predict(self, docs: DataFrame) -> DataFrame:
        """docs (id, text) -> (id, intent, confidence); ties go to the first class. The coefficients, bounded by max_features, meet the terms in a broadcast.

        Products and the length of a text's vector are summed side by side, so that no vector is gathered and taken apart again.
        """
        held = self.space.idf.join(F.broadcast(self.pull), "t").select("term", "idf", "pull")
        rows = term_rows(docs.select("id", "text"), self.space.ngrams).join(F.broadcast(held), "term").select("id", ((1 + F.log("tf")) * F.col("idf")).alias("w"), "pull")
        each = [F.sum(F.col("w") * F.get("pull", F.lit(i))).alias(f"z{i}") for i in range(len(self.classes))]
        sums = rows.groupBy("id").agg(*each, F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        z = F.array(*(F.coalesce(F.col(f"z{i}") / F.col("norm"), F.lit(0.0)) + b for i, b in enumerate(self.start)))
        out = docs.select("id").join(sums, "id", "left").select("id", z.alias("z")).withColumn("top", F.array_max("z"))
        total = F.aggregate("z", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
        intent = F.element_at(F.array(*map(F.lit, self.classes)), F.array_position("z", F.col("top")).cast("int"))
        return out.select("id", intent.alias("intent"), (1 / total).alias("confidence"))
