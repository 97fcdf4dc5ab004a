"""Windows over groups: ranks, top rows, duplicates, previous days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, groups: list[str], by: list[Column], name: str, how: str = "rank") -> DataFrame:
    """Adds rank, dense_rank or row_number of `by` within groups."""
    return df.withColumn(name, getattr(F, how)().over(Window.partitionBy(*groups).orderBy(*by)).cast("long"))


def top(df: DataFrame, groups: list[str], by: list[Column], n: int, name: str, how: str = "rank") -> DataFrame:
    """The rows of rank 1 to n; Spark turns the filter into a limit for each group before the shuffle."""
    return ranked(df, groups, by, name, how).filter(F.col(name) <= n)


def latest(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row for each key: the first by `by`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")


def occurrence(df: DataFrame, key: str, by: list[Column], name: str) -> DataFrame:
    """Number of the row among those of its key in order of arrival; null keys have none.

    Null keys are spread over many windows, since they may be most of the table.
    """
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not dict(df.dtypes)[c].startswith(("map", "variant"))]), F.lit(1024)))
    w = Window.partitionBy(key, "_spread").orderBy(*by)
    return df.withColumn("_spread", spread).withColumn(name, F.when(F.col(key).isNotNull(), F.row_number().over(w)).cast("long")).drop("_spread")


def group_max_where(df: DataFrame, groups: list[str], value: Column, condition: Column, name: str) -> DataFrame:
    """MAX(value) FILTER (WHERE condition) OVER groups."""
    return df.withColumn(name, F.max(F.when(condition, value)).over(Window.partitionBy(*groups)))


def previous_day(df: DataFrame, day: str, values: list[str], prefix: str = "previous_") -> DataFrame:
    """Adds the values of exactly the day before; null if that day has no row."""
    before = df.select(F.date_add(day, 1).alias(day), *[F.col(v).alias(prefix + v) for v in values])
    return df.join(before, day, "left")


def trailing_days(df: DataFrame, day: str, value: Column, days: int, name: str) -> DataFrame:
    """Mean of value over the days present among the `days` days before; a self-join on the few dates, not one window over all."""
    past = df.select(F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, days))).alias(day), value.alias("_v"))
    return df.join(past.groupBy(day).agg(F.avg("_v").alias(name), F.count("_v").alias(name + "_days")), day, "left").withColumn(name + "_days", F.coalesce(name + "_days", F.lit(0)).cast("long"))
