"""Event messages: one copy of at-least-once data, gaps, latency, health, windows over time, and sensor anomalies, over `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up, z_score
from tessera.functions.times import epoch_ms
from tessera.operators.aggregates import duplicates, gaps
from tessera.operators.windows import latest
from tessera.sources.tables import table

#: The same text for both engines: every 10th message is delivered twice, every 15th has no id.
_MESSAGES = """SELECT 'orders' AS topic, user_id % 3 AS part, event_id AS at_offset, CASE WHEN event_id % 15 = 0 THEN NULL ELSE concat('e', event_id - event_id % 2) END AS business_id, ts, value, event_type, 0 AS copy FROM events
UNION ALL SELECT 'orders', user_id % 3, event_id, CASE WHEN event_id % 15 = 0 THEN NULL ELSE concat('e', event_id - event_id % 2) END, ts, value, event_type, 1 FROM events WHERE event_id % 10 = 0"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, part, at_offset, business_id, ts, value, event_type, copy (1: delivered again), ingested_ms."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    m = spark.sql(_MESSAGES)
    return m.withColumn("ingested_ms", epoch_ms(F.col("ts")) + 1500 + F.col("at_offset") % 7 * 1000 + F.col("copy") * 60000)


_M = f"m AS (SELECT *, epoch_ms(ts) + 1500 + at_offset % 7 * 1000 + copy * 60000 AS ingested_ms FROM ({_MESSAGES}))"
COORDINATES = ["topic", "part", "at_offset"]


def latest_by_coordinates(spark, sf_dir):
    return latest(messages(spark, sf_dir), COORDINATES, [F.col("ingested_ms").desc()]).select(*COORDINATES, "copy", "value")


def unique_by_business_key(spark, sf_dir):
    """Messages without an id fall back to their coordinates, so they never collapse into one. Unknown times, parts and offsets come last."""
    key = F.coalesce("business_id", F.concat_ws(":", *COORDINATES))
    return latest(messages(spark, sf_dir).withColumn("key", key), ["key"], [F.col(c).asc_nulls_last() for c in ("ingested_ms", "part", "at_offset")]).select("key", "at_offset", "value")


def copied_messages(spark, sf_dir):
    return duplicates(messages(spark, sf_dir), COORDINATES)


def offset_gaps(spark, sf_dir):
    return gaps(messages(spark, sf_dir), ["topic", "part"], "at_offset")


def latency(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("ms", F.col("ingested_ms") - epoch_ms(F.col("ts")))
    return m.groupBy("part").agg(F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"), F.min("ms").alias("min_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms"))


def health(spark, sf_dir):
    return messages(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.countDistinct(*COORDINATES).alias("distinct_messages"), F.countDistinct("business_id").alias("distinct_ids"), F.count_if(F.col("business_id").isNull()).alias("without_id"), F.max("ingested_ms").alias("last_ms"))


def tumbling(spark, sf_dir):
    """Six-hour windows; the batch form of the streaming query."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"))
    return w.select(F.unix_seconds("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    return s.select("user_id", F.unix_micros("first").alias("first_us"), "n")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("device_id"), F.col("value").cast("decimal(18,2)").alias("value"))


def scored(spark, sf_dir):
    """Each reading with its z-score over all; mean and deviation are one row of exact sums."""
    r = readings(spark, sf_dir)
    n, s, q = F.count("value"), F.sum("value").cast("double"), F.sum((F.col("value") * F.col("value")).cast("decimal(38,4)")).cast("double")
    stats = r.agg((s / n).alias("mean"), F.sqrt((q - s * s / n) / (n - 1)).alias("deviation"))
    z = z_score(F.col("value").cast("double"), "mean", "deviation")
    return r.join(F.broadcast(stats)).select("event_id", "device_id", "value", half_up(z, 6).alias("z"), F.when(F.abs(z) > 3, "YES").otherwise("NO").alias("anomaly"))


def anomaly_summary(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("anomaly") == "YES").alias("anomalies"), F.max("value").alias("greatest"))


def device_extremes(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("device_id").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


QUERIES = {f"a9_{f.__name__}": f for f in (latest_by_coordinates, unique_by_business_key, copied_messages, offset_gaps, latency, health, tumbling, sessions)}
QUERIES |= {"a3_scored": scored, "a3_anomaly_summary": anomaly_summary, "a3_device_extremes": device_extremes}
_S = """r AS (SELECT event_id, user_id AS device_id, CAST(value AS DECIMAL(18,2)) AS value FROM events),
t AS (SELECT CAST(sum(value) AS DOUBLE) / count(value) AS mean, sqrt((CAST(sum(CAST(value * value AS DECIMAL(38,4))) AS DOUBLE) - CAST(sum(value) AS DOUBLE) * CAST(sum(value) AS DOUBLE) / count(value)) / (count(value) - 1)) AS deviation FROM r),
z AS (SELECT event_id, device_id, value, (CAST(value AS DOUBLE) - mean) / deviation AS z FROM r, t)"""
ORACLE = {
    "a9_latest_by_coordinates": f"WITH {_M} SELECT topic, part, at_offset, copy, value FROM m QUALIFY row_number() OVER (PARTITION BY topic, part, at_offset ORDER BY ingested_ms DESC) = 1",
    "a9_unique_by_business_key": f"WITH {_M} SELECT coalesce(business_id, concat_ws(':', topic, part, at_offset)) AS key, at_offset, value FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY ingested_ms, part, at_offset) = 1",
    "a9_copied_messages": f"WITH {_M} SELECT topic, part, at_offset, count(*) AS copies FROM m GROUP BY ALL HAVING count(*) > 1",
    "a9_offset_gaps": f"WITH {_M} SELECT topic, part, max(at_offset) - min(at_offset) + 1 - count(DISTINCT at_offset) AS missing FROM m GROUP BY ALL",
    "a9_latency": f"WITH {_M} SELECT part, CAST(sum(ingested_ms - epoch_ms(ts)) AS BIGINT) AS total_ms, max(ingested_ms - epoch_ms(ts)) AS max_ms, min(ingested_ms - epoch_ms(ts)) AS min_ms, CAST(quantile_disc(ingested_ms - epoch_ms(ts), 0.95) AS DOUBLE) AS p95_ms FROM m GROUP BY part",
    "a9_health": f"WITH {_M} SELECT count(*) AS n_rows, count(DISTINCT (topic, part, at_offset)) AS distinct_messages, count(DISTINCT business_id) AS distinct_ids, count(*) FILTER (WHERE business_id IS NULL) AS without_id, max(ingested_ms) AS last_ms FROM m",
    "a9_tumbling": "SELECT CAST(epoch(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS window_start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY ALL",
    "a9_sessions": """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS fresh FROM events),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS n FROM b GROUP BY user_id, s""",
    "a3_scored": f"WITH {_S} SELECT event_id, device_id, value, CAST(round(CAST(z AS DECIMAL(38,10)), 6) AS DECIMAL(28,6)) AS z, CASE WHEN abs(z) > 3 THEN 'YES' ELSE 'NO' END AS anomaly FROM z",
    "a3_anomaly_summary": f"WITH {_S} SELECT count(*) AS n, count(*) FILTER (WHERE abs(z) > 3) AS anomalies, max(value) AS greatest FROM z",
    "a3_device_extremes": f"WITH {_S} SELECT device_id, count(*) AS n, min(value) AS lo, max(value) AS hi FROM r GROUP BY device_id",
}
