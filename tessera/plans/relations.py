"""Queries over runs, numbered lists, roles, candidates and updates, derived from `events`, `customer`, `orders` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relations as rel
from tessera.sources.tables import table
from tessera.streaming.upkeep import backfill

NAMES = ["Asha", "Ben", "Chen", "Dana", "Eli"]
ROLES = ["click", "view", "purchase"]


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 7).alias("run_id"))


def latest_run(spark, sf_dir):
    """Event types of the last run that succeeded; run 6 failed."""
    e = _runs(spark, sf_dir)
    runs = e.select("run_id").distinct().withColumn("status", F.when(F.col("run_id") == 6, "failed").otherwise("succeeded"))
    return rel.latest_run(e, runs, "run_id", F.col("status") == "succeeded").groupBy("run_id", "event_type").agg(F.count("*").alias("n"))


def by_place(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return rel.by_place(c, F.col("id") % 6, NAMES, "name")


def by_role(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return rel.by_role(e, ["user_id"], "event_type", ROLES, F.col("event_id")).withColumnRenamed("view", "viewed")


def candidates(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rel.candidates(x, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")])


def update_from(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    new = o.filter("id % 3 = 0").select("id", F.concat(F.lit("checked "), "status").alias("status"))
    return rel.update_from(o, new, "id", ["status"])


def earliest_copies(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.select(F.lit("t").alias("_KAFKA_TOPIC"), (F.col("user_id") % 3).alias("_KAFKA_PARTITION"), F.col("event_id").alias("_KAFKA_OFFSET"), F.lit("b").alias("_INGESTED_AT"), "event_type")
    again = m.withColumn("_INGESTED_AT", F.when(F.col("_KAFKA_OFFSET") % 2 == 0, "a").otherwise("c")).withColumn("event_type", F.concat(F.lit("again "), "event_type"))
    return backfill(m.unionByName(again), ["_KAFKA_PARTITION", "_KAFKA_OFFSET", "_INGESTED_AT", "event_type"], ["not_there"]).groupBy("event_type", F.col("_INGESTED_AT").alias("copy")).agg(F.count("*").alias("n"))


QUERIES = {f"rel_{f.__name__}": f for f in (latest_run, by_place, by_role, candidates, update_from, earliest_copies)}
ORACLE = {
    "rel_latest_run": "WITH e AS (SELECT *, user_id % 7 AS run_id FROM events) SELECT run_id, event_type, count(*) AS n FROM e WHERE run_id = (SELECT max(run_id) FROM e WHERE run_id <> 6) GROUP BY ALL",
    "rel_by_place": f"SELECT c_custkey AS id, {NAMES}[c_custkey % 6 + 1] AS name FROM customer",
    "rel_by_role": "SELECT user_id, min(event_id) FILTER (WHERE event_type = 'click') AS click, min(event_id) FILTER (WHERE event_type = 'view') AS viewed, min(event_id) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id",
    "rel_candidates": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey) AS candidate_count FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1",
    "rel_update_from": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'checked ' || o_orderstatus ELSE o_orderstatus END AS status, o_custkey AS customer FROM orders",
    "rel_earliest_copies": "SELECT CASE WHEN event_id % 2 = 0 THEN 'again ' || event_type ELSE event_type END AS event_type, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS copy, count(*) AS n FROM events GROUP BY ALL",
}
