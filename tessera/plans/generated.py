"""Generated landing rows through the quality rules; rows only, as the defects come from Spark's hash."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import order_quality as oq
from tessera.sources import generators

#: The rule that must find each kind of defect.
EXPECTED = {
    "missing_field": "DQ01", "bad_number": "DQ02", "bad_quantity": "DQ03", "bad_amount": "DQ06", "amount_mismatch": "DQ07", "bad_email": "DQ08",
    "bad_timestamp": "DQ09", "bad_status": "DQ10", "duplicate_id": "DQ11",
}


def defect_detection(spark, sf_dir):
    """By kind of defect: rows, and how many the rules found; rows without one must be good."""
    e = oq.evaluate(generators.orders(spark, 48))
    return e.groupBy(F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("n"), F.count_if(F.col("quality_status") == "BAD").alias("bad"))


def sensor_kinds(spark, sf_dir):
    return generators.sensors(spark).groupBy("event_type").agg(F.count("*").alias("n"), F.max("reading_value").alias("hi"), F.min(F.unix_seconds("arrival_time") - F.unix_seconds("timestamp")).alias("least_delay"))


def event_versions(spark, sf_dir):
    one = lambda v: generators.order_events(spark, 100, v).select(F.lit(v).alias("version"), F.size(F.json_object_keys(F.col("value").cast("string"))).alias("fields"))
    return one(1).unionByName(one(2)).unionByName(one(3)).groupBy("version", "fields").agg(F.count("*").alias("n"))


QUERIES = {f"gen_{f.__name__}": f for f in (defect_detection, sensor_kinds, event_versions)}
ORACLE: dict[str, str] = {}
