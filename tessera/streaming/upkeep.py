"""What keeps streams and the tables behind them going: retries, draining, refreshes of what has changed, freshness."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import order_quality as oq

#: Parts that a curated table is kept in; a refresh writes only those that new rows fall into.
PARTS = 64


def with_retries(action: Callable[[], None], first: float = 1.0, most: float = 60.0, stop: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Runs the action until it succeeds, with waits that double up to `most`. False if asked to stop after a failure: the batch then
    stays uncommitted and is read again at the next start. While it waits the query takes no further batch."""
    wait = first
    while True:
        try:
            action()
            return True
        except Exception:
            if stop():
                return False
            sleep(wait)
            wait = min(2 * wait, most)


def drain(query) -> None:
    """Loads what has arrived, then stops."""
    query.processAllAvailable()
    query.stop()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def refresh(landed: DataFrame, path: str) -> int:
    """Brings the evaluated table at `path` up to date with landed rows and returns how many parts were written.

    A row's verdict depends on other rows only through its order_id, so the parts of the order_ids that are new since the last
    refresh are evaluated again from all their rows, and nothing else is read or written. No clock is read: a refresh that runs
    again gives the same table.
    """
    spark = landed.sparkSession
    rows = landed.withColumn("_part", F.pmod(F.xxhash64("order_id"), F.lit(PARTS)).cast("int"))
    touched = None
    if _exists(spark, path):
        until = spark.read.parquet(path).agg(F.max("loaded_at")).first()[0]
        touched = [r[0] for r in rows.filter(F.col("loaded_at") > F.lit(until)).select("_part").distinct().collect()]  # PARTS at most
        rows = rows.filter(F.col("_part").isin(touched))
    parts = rows.select("_part").distinct().count()
    if touched is None or touched:
        out = oq.evaluate(rows.drop("_part")).withColumn("_part", F.pmod(F.xxhash64("order_id"), F.lit(PARTS)).cast("int"))
        out.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    return parts


def is_fresh(landed: DataFrame, path: str) -> bool:
    """Whether the table at `path` reflects the last landed row."""
    last = lambda df: df.agg(F.max("loaded_at")).first()[0]
    return last(landed) == last(landed.sparkSession.read.parquet(path))


def backfill(table: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """The earliest copy of each message of an evolved table: the required columns, and of the optional ones those that there are.

    A missing required column raises ValueError.
    """
    if missing := [c for c in required if c not in table.columns]:
        raise ValueError(f"columns are missing: {missing}")
    columns = [*required, *[c for c in optional if c in table.columns]]
    first = F.min_by(F.struct(*columns), F.struct("_INGESTED_AT", *columns))
    return table.groupBy("_KAFKA_TOPIC", "_KAFKA_PARTITION", "_KAFKA_OFFSET").agg(first.alias("r")).select("r.*")
