"""A small supervised workflow: split, logistic regression, report, save, predict."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """By the hash of a key, so that a row is on the same side in every run and partitioning."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < F.lit(round(share * 1_000_000))
    return df.filter(at), df.filter(~at)


def fit(train: DataFrame, features: list[str], label: str, max_iter: int = 1000) -> PipelineModel:
    """Logistic regression with unit ridge over all rows, as the usual defaults of single-node libraries have it."""
    n = train.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=1.0 / max(n, 1), standardization=False)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), lr]).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("chance", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def confusion(predicted: DataFrame, label: str) -> DataFrame:
    return predicted.groupBy(F.col(label).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def report(predicted: DataFrame, label: str) -> DataFrame:
    """One row: accuracy and, of class 1, precision, recall and F1."""
    y, p = F.col(label) == 1, F.col("prediction") == 1
    c = predicted.agg(F.count("*").alias("n"), F.count_if(y == p).alias("right"), F.count_if(y & p).alias("tp"), F.count_if(p).alias("said"), F.count_if(y).alias("are"))
    part = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return c.select("n", part("right", "n").alias("accuracy"), part("tp", "said").alias("precision"), part("tp", "are").alias("recall"), (2 * F.col("tp") / F.nullif(F.col("said") + F.col("are"), F.lit(0))).alias("f1"))
