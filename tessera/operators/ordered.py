"""Window functions over one global order, without putting the whole table into one task.

Rows are dealt by a bucket that rises with the order. Buckets are cut at quantiles of a random sample of the order's columns, twice as
many as there are shuffle partitions, so they follow the data and the size that the cluster is set for. Within a bucket an ordinary
window works; what crosses buckets (the rows before it, or how many there are) comes from a table with a few rows for each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample for each bucket, and buckets at most.
SAMPLED, MOST_BUCKETS = 30, 10_000


def with_bucket(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds _bucket, which never falls as the order rises; rows that agree in the order share one.

    The bounds go to the rows as one row of two levels, so that a row is compared with the square root of their number.
    """
    spark = df.sparkSession
    n = min(MOST_BUCKETS, max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    key = F.struct(*[F.col(c) for c in order])
    sample = df.select(key.alias("k")).orderBy(F.rand(7)).limit(SAMPLED * n).orderBy("k").collect()
    bounds = list(dict.fromkeys(r.k for r in sample[SAMPLED::SAMPLED]))
    if not bounds:
        return df.withColumn("_bucket", F.lit(0))
    step = max(1, round(len(bounds) ** 0.5))
    kind = df.select(key.alias("k")).schema["k"].dataType.simpleString()
    heads, inner = bounds[::step], [[], *[bounds[i + 1 : i + step] for i in range(0, len(bounds), step)]]
    table = F.broadcast(spark.createDataFrame([(heads, inner)], f"_heads array<{kind}>, _inner array<array<{kind}>>"))  # MOST_BUCKETS keys
    below = lambda keys: F.size(F.filter(keys, lambda b: b <= key))
    at = df.crossJoin(table).withColumn("_head", below(F.col("_heads")))
    bucket = F.col("_head") * F.lit(step) + below(F.get("_inner", F.col("_head")))
    return at.withColumn("_bucket", bucket).drop("_heads", "_inner", "_head")


def _neighbour(df: DataFrame, value: str, order: list[str], name: str, step: int) -> DataFrame:
    """The value one row before (step 1) or after (step -1) in the global order."""
    keys = [F.col(c) for c in order] if step > 0 else [F.col(c).desc() for c in order]
    at = with_bucket(df, order)
    inside = Window.partitionBy("_bucket").orderBy(*keys)
    edge = F.max_by if step > 0 else F.min_by
    edges = at.groupBy("_bucket").agg(edge(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("edge"))
    across = Window.orderBy(F.col("_bucket") if step > 0 else F.col("_bucket").desc())
    edges = edges.select("_bucket", F.lag("edge.v").over(across).alias("_before"))
    out = at.withColumn("_row", F.row_number().over(inside)).withColumn("_near", F.lag(value).over(inside)).join(F.broadcast(edges), "_bucket")  # a row for each bucket
    return out.withColumn(name, F.when(F.col("_row") == 1, F.col("_before")).otherwise(F.col("_near"))).select(*df.columns, name)


def _total(value: str, order: list[str]) -> list[str]:
    """The order with the value last: rows that agree in all of it have the same value, so any order among them gives the same rows."""
    return order if value in order else [*order, value]


def global_lag(df: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """LAG(value) over the order; ties are in the order of the value."""
    return _neighbour(df, value, _total(value, order), name, 1)


def global_lead(df: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """LEAD(value) over the order; ties are in the order of the value."""
    return _neighbour(df, value, _total(value, order), name, -1)


def global_rank(df: DataFrame, value: str, name: str, groups: list[str] | None = None) -> DataFrame:
    """RANK() OVER (PARTITION BY groups ORDER BY value DESC).

    Equal values are counted before anything is sorted, so neither a group nor a value can be too large for a task.
    """
    groups = groups or []
    counts = with_bucket(df.groupBy(*groups, value).agg(F.count("*").alias("_n")), [value])
    totals = counts.groupBy(*groups, "_bucket").agg(F.sum("_n").alias("_all"))
    above = Window.partitionBy(*groups).orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*groups, "_bucket").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_above", F.coalesce(F.sum("_all").over(above), F.lit(0))).drop("_all")
    ranks = counts.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(totals, [*groups, "_bucket"])
    ranks = ranks.select(*groups, value, (F.col("_above") + F.col("_before") + 1).cast("long").alias(name))
    return df.join(ranks, [*groups, value]).select(*df.columns, name)


def global_moving_sum(df: DataFrame, value: str, order: list[str], preceding: int, name: str, n_name: str) -> DataFrame:
    """Sum and count of value over ROWS BETWEEN `preceding` PRECEDING AND CURRENT ROW of the global order; ties are in the order of the value."""
    order = _total(value, order)
    at = with_bucket(df, order)
    inside = Window.partitionBy("_bucket").orderBy(*order)
    back = Window.partitionBy("_bucket").orderBy(*[F.col(c).desc() for c in order])
    tails = at.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= preceding)
    tails = tails.groupBy("_bucket").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(value).alias("_v")))).alias("_tail"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # the last rows of all earlier buckets; each bucket gives `preceding` at most
    context = tails.withColumn("_all", F.flatten(F.collect_list("_tail").over(earlier.rowsBetween(-preceding, -1))))
    context = context.select("_bucket", F.transform(F.slice(F.reverse("_all"), 1, preceding), lambda x: x["_v"]).alias("_before"))
    frame = inside.rowsBetween(-preceding, 0)
    out = at.withColumn("_row", F.row_number().over(inside)).withColumn("_sum", F.sum(value).over(frame)).withColumn("_n", F.count(value).over(frame))
    out = out.join(F.broadcast(context), "_bucket")  # a row for each bucket
    missing = F.greatest(F.lit(0), F.lit(preceding + 1) - F.col("_row"))
    borrowed = F.slice("_before", 1, missing)
    kind = dict(df.dtypes)[value]
    add = F.aggregate(borrowed, F.lit(0).cast("decimal(38,2)" if kind.startswith("decimal") else "double"), lambda a, x: (a + F.coalesce(x, F.lit(0))).cast("decimal(38,2)" if kind.startswith("decimal") else "double"))
    return out.withColumn(name, F.col("_sum") + add).withColumn(n_name, (F.col("_n") + F.size(F.filter(borrowed, lambda x: x.isNotNull()))).cast("long")).select(*df.columns, name, n_name)
