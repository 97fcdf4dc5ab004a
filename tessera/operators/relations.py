"""Joins and updates by what rows mean: the latest run, places in a list, roles, candidates, one table set from another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a client may ask for at once.
CLIENT_ROWS = 100_000


def latest_run(rows: DataFrame, runs: DataFrame, run: str, succeeded: Column) -> DataFrame:
    """The rows of the last run that succeeded; one row is broadcast. Without such a run there are none."""
    last = runs.filter(succeeded).agg(F.max(run).alias("_last"))
    return rows.join(F.broadcast(last), F.col(run) == F.col("_last")).drop("_last")


def by_place(df: DataFrame, place: Column, values: list[str], name: str) -> DataFrame:
    """The value at a 0-based place of a short list, null beyond it: an array in the plan instead of a join with a numbered table."""
    return df.withColumn(name, F.get(F.array(*map(F.lit, values)), place.cast("int")))


def by_role(df: DataFrame, keys: list[str], role: str, roles: list[str], value: Column) -> DataFrame:
    """A column for each role with the least value that a key has in it: one pass instead of a join for each role."""
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(role) == r, value)).alias(r) for r in roles])


def candidates(df: DataFrame, groups: list[str], by: list[Column]) -> DataFrame:
    """The first row of each group with the number of rows that it was chosen from; both windows share one sort."""
    w = Window.partitionBy(*groups)
    return df.withColumn("_rn", F.row_number().over(w.orderBy(*by))).withColumn("candidate_count", F.count("*").over(w)).filter("_rn = 1").drop("_rn")


def update_from(target: DataFrame, source: DataFrame, key: str, values: list[str]) -> DataFrame:
    """target with the values of the source's row of the same key; rows without one stay as they are. source has each key once."""
    new = source.select(key, F.lit(True).alias("_new"), *[F.col(v).alias(f"_s_{v}") for v in values])
    both = target.join(new, key, "left")
    return both.select(*[F.when(F.col("_new"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def remember(df: DataFrame, name: str = "last_result") -> DataFrame:
    """Keeps a result under a name for the queries after it; worked out once."""
    kept = df.persist()
    kept.createOrReplaceTempView(name)
    return kept


def to_client(df: DataFrame, most: int = CLIENT_ROWS) -> list[dict]:
    """The rows as dictionaries, arrays as lists. A result of over `most` rows raises ValueError instead of filling the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write them to a table instead")
    return [r.asDict(recursive=True) for r in rows]


def guarded(spark: SparkSession, inputs: dict[str, Callable[[], DataFrame]], action: Callable[[], DataFrame]) -> DataFrame:
    """The action's result, if none of the inputs changed while it ran; else RuntimeError. The inputs are
    functions that open a table, since an open one keeps the files that it found; each is read once before and after."""

    def digests() -> dict[str, tuple]:
        out = {}
        for name, opened in inputs.items():
            df = opened()
            line = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
            out[name] = tuple(df.agg(F.count("*"), F.sum(line)).first())
        return out

    before = digests()
    result = action()
    if changed := [k for k, v in digests().items() if v != before[k]]:
        raise RuntimeError(f"inputs are read-only, but these changed: {changed}")
    return result
