"""Windows over event time with late data, and one copy of repeated messages, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums in windows; rows that come over `late` behind the latest are left out, and windows close then."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(stream: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """The first copy of each message; state is kept for `late` only."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def collected(stream: DataFrame, path: str, mode: str = "append"):
    """Runs a stream over all there is now and writes its rows to `path`."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/_checkpoint").option("path", f"{path}/rows").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
