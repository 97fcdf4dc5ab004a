"""Predicting large orders from their lines; rows only, as no SQL fits a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import learning
from tessera.sources.tables import table

FEATURES = ["lines", "quantity", "discount", "parts"]


def features(spark, sf_dir) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.countDistinct("l_partkey").cast("double").alias("parts"), F.sum("l_extendedprice").alias("total"))
    return x.withColumn("label", (F.col("total") > 200_000).cast("double"))


def _predicted(spark, sf_dir):
    train, test = learning.split(features(spark, sf_dir), "l_orderkey")
    return learning.predict(learning.fit(train, FEATURES, "label"), test)


def classification_report(spark, sf_dir):
    return learning.report(_predicted(spark, sf_dir), "label")


def confusion_matrix(spark, sf_dir):
    return learning.confusion(_predicted(spark, sf_dir), "label")


def predictions(spark, sf_dir):
    return _predicted(spark, sf_dir).select("l_orderkey", "prediction", "chance")


QUERIES = {f"a4_{f.__name__}": f for f in (classification_report, confusion_matrix, predictions)}
ORACLE: dict[str, str] = {}
