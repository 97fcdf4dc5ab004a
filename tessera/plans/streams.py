"""Streaming queries run to the end of what there is: windows, one copy of repeated messages, the evolving loader, change capture."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table
from tessera.streaming import cdc, loader, windows


def _folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    folder = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)  # when the application ends
    return folder


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _last(stream: DataFrame, folder: str) -> DataFrame:
    """The complete result after the last batch."""
    put = lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/result")
    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/result")


def tumbling(spark, sf_dir):
    w = windows.tumbling(_events(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,2)")), "ts", "6 hours", "1 hour", ["event_type"], "value")
    return _last(w, _folder(spark)).select(F.unix_seconds("start").alias("window_start"), "event_type", "n", F.col("total").cast("decimal(38,2)").alias("total"))


def once(spark, sf_dir):
    """Every message twice in, once out."""
    e, folder = _events(spark, sf_dir), _folder(spark)
    windows.collected(windows.once(e.unionByName(e), "ts", "400 days", ["event_id"]), folder)
    return spark.read.parquet(f"{folder}/rows").groupBy("event_type").agg(F.count("*").alias("n"))


def _messages(spark, sf_dir):
    e, k = _events(spark, sf_dir), F.col("event_id")
    body = F.to_json(F.struct(
        F.concat(F.lit("e"), k).alias("event_id"), F.concat(F.lit("O"), F.col("user_id")).alias("order_id"), F.col("user_id").alias("customer_id"), F.when(k % 50 == 0, "two").otherwise((k % 5).cast("string")).alias("quantity_text"),
        F.when(k % 3 == 0, F.col("value")).alias("extra field"),
    ))
    body = F.regexp_replace(body, '"quantity_text":"([0-9])"', '"quantity":$1')
    body = F.regexp_replace(body, '"quantity_text"', '"quantity"')
    body = F.when(k % 40 == 7, F.lit("{broken")).otherwise(body)
    return e.select(F.lit("k").cast("binary").alias("key"), body.cast("binary").alias("value"), F.lit("orders").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), k.alias("offset"), F.col("ts").alias("timestamp"))


def loaded(spark, sf_dir):
    """By partition: rows in the evolving table, values of the column that the messages brought, and dead letters."""
    job = loader.Loader(spark, _folder(spark))
    job.run(_messages(spark, sf_dir)).awaitTermination()
    good = job.table().groupBy(F.col("_KAFKA_PARTITION").alias("part")).agg(F.count("*").alias("loaded"), F.count("EXTRA_FIELD").alias("extra"), F.sum("QUANTITY").alias("quantity"))
    dead = job.dead_letters().groupBy(F.col("_KAFKA_PARTITION").alias("part")).agg(F.count("*").alias("dead"))
    return good.join(dead, "part", "left").withColumn("dead", F.coalesce("dead", F.lit(0)))


def changes(spark, sf_dir):
    """Change events by what becomes of them."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    hexes = F.md5(k.cast("string"))
    uid = F.concat_ws("-", *[F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    after = F.struct(F.when(k % 11 == 0, "no-uuid").otherwise(uid).alias("event_id"), F.lit("2026-10-06T17:53:49.370999+05:30").alias("event_time"), F.concat(F.lit("O"), k).alias("order_id"), F.col("o_custkey").alias("customer_id"), F.when(k % 13 == 0, "backfill").otherwise("app").alias("record_source"))
    op = F.element_at(F.array(*map(F.lit, ("c", "c", "u", "d", "x"))), (k % 5 + 1).cast("int"))
    raw = o.select(k.alias("id"), F.to_json(F.struct(op.alias("op"), F.struct(F.lit("order_events").alias("table")).alias("source"), after.alias("after"))).cast("binary").alias("value"))
    return cdc.classified(raw).groupBy("action", "reason").agg(F.count("*").alias("n"))


QUERIES = {f"stream_{f.__name__}": f for f in (tumbling, once, loaded, changes)}
ORACLE = {
    "stream_tumbling": "SELECT CAST(epoch(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS window_start, event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total FROM events GROUP BY ALL",
    "stream_once": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "stream_loaded": "SELECT CAST(user_id % 3 AS INT) AS part, count(*) FILTER (WHERE ok) AS loaded, count(*) FILTER (WHERE ok AND event_id % 3 = 0) AS extra, CAST(sum(event_id % 5) FILTER (WHERE ok) AS BIGINT) AS quantity, count(*) FILTER (WHERE NOT ok) AS dead FROM (SELECT *, event_id % 40 <> 7 AND event_id % 50 <> 0 AS ok FROM events) GROUP BY 1",
    "stream_changes": """SELECT action, reason, count(*) AS n FROM (SELECT CASE WHEN o IN (2, 3) OR (o < 2 AND k % 13 = 0) THEN 'skip' WHEN o = 4 OR k % 11 = 0 THEN 'reject' ELSE 'forward' END AS action,
        CASE WHEN o = 2 THEN 'update' WHEN o = 3 THEN 'delete' WHEN o = 4 THEN 'unknown operation' WHEN k % 13 = 0 THEN 'backfill row' WHEN k % 11 = 0 THEN 'event_id is not a UUID' END AS reason FROM (SELECT o_orderkey AS k, o_orderkey % 5 AS o FROM orders)) GROUP BY ALL""",
}
