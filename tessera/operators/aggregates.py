"""Aggregations beyond a plain group-by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_share(df: DataFrame, value: str, name: str, scale: float = 100.0) -> DataFrame:
    """Adds each row's share of the total of an aggregated (so small) table."""
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(name, F.lit(scale) * F.col(value).cast("double") / F.nullif(total.cast("double"), F.lit(0.0)))


def count_histogram(df: DataFrame, key: str, per: str, n: str) -> DataFrame:
    """How many keys have 1, 2, ... rows."""
    return df.groupBy(key).agg(F.count("*").alias(per)).groupBy(per).agg(F.count("*").alias(n))


def rollup_labelled(df: DataFrame, key: str, aggs: list[Column], label: str) -> DataFrame:
    """GROUP BY ROLLUP(key) with the total row named `label`; a null key stays apart from the total."""
    out = df.rollup(key).agg(F.grouping(key).alias("_total"), *aggs)
    return out.withColumn(key, F.when(F.col("_total") == 1, F.lit(label)).otherwise(F.col(key))).drop("_total")


def duplicates(df: DataFrame, keys: list[str], n: str = "copies") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(n)).filter(F.col(n) > 1)


def gaps(df: DataFrame, groups: list[str], number: str, name: str = "missing") -> DataFrame:
    """Numbers that a gapless sequence from least to greatest would have besides."""
    return df.groupBy(*groups).agg((F.max(number) - F.min(number) + 1 - F.countDistinct(number)).cast("long").alias(name))


def joined_codes(df: DataFrame, groups: list[str], code: str, sep: str, name: str) -> DataFrame:
    """`code(n)` of all codes, most frequent first, ties by code."""
    counts = df.groupBy(*groups, code).agg(F.count("*").alias("_n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("o"), F.col(code).alias("c"))))
    return counts.groupBy(*groups).agg(F.array_join(F.transform(parts, lambda x: F.concat(x["c"], F.lit("("), (-x["o"]).cast("string"), F.lit(")"))), sep).alias(name))


def checksum(df: DataFrame, columns: list[str], name: str = "checksum") -> DataFrame:
    """One digest of a whole table, whatever its order, without gathering its rows: count, and the sum of 60-bit row digests."""
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]))
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(part), F.lit(0)).cast("string")).alias(name))


def pivot_fields(df: DataFrame, key: list[str], field: str, names: list[str], value: str) -> DataFrame:
    """Long to wide: a column for each of the named fields."""
    return df.groupBy(*key).pivot(field, names).agg(F.max(value))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of all pairs of columns in one pass."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(items).alias("x")).select("x.a", "x.b", "x.r")


def value_counts(df: DataFrame, column: str, n: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(n))


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value that isn't null, of ties the least."""
    return value_counts(df.filter(F.col(column).isNotNull()), column, "_n").orderBy(F.desc("_n"), column).limit(1).select(F.col(column).alias("mode"))
