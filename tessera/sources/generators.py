"""Deterministic rows for tests and trials: orders with known defects, sensors with late and odd readings, order events by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of defects; shares of odd readings.
DEFECTS = ("missing_field", "bad_number", "bad_quantity", "bad_amount", "amount_mismatch", "bad_email", "bad_timestamp", "bad_status", "duplicate_id")
DEFECT_SHARE = 0.08
ANOMALY, BACKDATED, LATE = 0.01, 0.03, 0.05
#: Weight of each hour of a day in IST.
HOUR_WEIGHTS = (0.3, 0.2, 0.2, 0.2, 0.2, 0.3, 0.5, 0.7, 0.9, 1.1, 1.2, 1.3, 1.3, 1.2, 1.1, 1.0, 1.0, 1.1, 1.3, 1.5, 1.5, 1.3, 0.9, 0.5)


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the row alone, so that any partitioning gives the same rows."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1_000_003)) / 1_000_003.0


def rows_in_hour(seed: int, hour: Column, low: int = 80, high: int = 150) -> Column:
    """Volume of an hour: by hour of the day in IST, a tenth more at weekends, some jitter, within bounds."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), hour)
    weight = F.element_at(F.array(*map(F.lit, HOUR_WEIGHTS)), F.hour(local) + 1)
    weekend = F.when(F.dayofweek(local).isin(1, 7), 1.1).otherwise(1.0)
    size = (low + high) / 2 * weight * weekend * (0.9 + 0.2 * uniform(seed, hour.cast("string")))
    return F.greatest(F.lit(low), F.least(F.lit(high), F.round(size).cast("int")))


def orders(spark: SparkSession, hours: int, seed: int = 42, start: str = "2026-05-01 00:00:00") -> DataFrame:
    """Text columns of a landing file and `defect`, null for rows without one."""
    h = spark.range(hours).select(F.expr(f"TIMESTAMP_NTZ '{start}' + make_dt_interval(0, CAST(id AS INT))").alias("hour"))
    r = h.select("hour", F.explode(F.sequence(F.lit(1), rows_in_hour(seed, F.col("hour")))).alias("n"))
    u = lambda k: uniform(seed + k, F.col("hour").cast("string"), F.col("n"))
    defect = F.when(u(1) < DEFECT_SHARE, F.element_at(F.array(*map(F.lit, DEFECTS)), (F.floor(u(2) * len(DEFECTS)) + 1).cast("int")))
    quantity, price = (F.floor(u(3) * 5) + 1).cast("int"), F.round(F.lit(50) + u(4) * 950, 2).cast("decimal(10,2)")
    r = r.withColumns({"defect": defect, "q": quantity, "p": price}).withColumn("a", (F.col("q") * F.col("p")).cast("decimal(12,2)"))
    stamp = F.date_format("hour", "yyyyMMddHH")
    own = F.concat(F.lit("ORD-"), stamp, F.lpad(F.col("n").cast("string"), 4, "0"))
    bad = lambda kind, value, good: F.when(F.col("defect") == kind, value).otherwise(good)
    ts = F.date_format(F.col("hour") + F.expr("make_dt_interval(0, 0, CAST(n % 60 AS INT), 0)"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return r.select(
        bad("duplicate_id", F.concat(F.lit("ORD-"), stamp, F.lit("0001")), own).alias("order_id"), bad("bad_timestamp", F.lit("2026-13-45T25:61:00Z"), ts).alias("order_ts"),
        F.concat(F.lit("CUST-"), F.lpad(F.floor(u(5) * 500).cast("string"), 4, "0")).alias("customer_id"), bad("missing_field", F.lit(None).cast("string"), F.concat(F.lit("Customer "), F.floor(u(5) * 500).cast("string"))).alias("customer_name"),
        bad("bad_email", F.lit("local@@domain"), F.concat(F.lit("c"), F.floor(u(5) * 500).cast("string"), F.lit("@example.org"))).alias("customer_email"), F.concat(F.lit("P"), F.floor(u(6) * 40).cast("string")).alias("product_id"), F.lit("General").alias("product_category"),
        bad("bad_number", F.lit("two"), bad("bad_quantity", F.lit("0"), F.col("q").cast("string"))).alias("quantity"), F.col("p").cast("string").alias("unit_price"),
        bad("bad_amount", F.lit("-5.00"), bad("amount_mismatch", (F.col("a") + 50).cast("string"), bad("bad_quantity", F.lit("0.01"), F.col("a").cast("string")))).alias("amount"), F.lit("INR").alias("currency"), F.lit("UPI").alias("payment_method"),
        bad("bad_status", F.lit("UNKNOWN"), F.lit("PLACED")).alias("order_status"), F.lit("Pune").alias("city"), F.date_format("hour", "yyyy-MM-dd HH:mm").alias("batch_ts"), "defect",
        F.concat(F.lit("orders_"), F.date_format("hour", "yyyyMMdd_HH"), F.lit(".csv")).alias("source_file"), F.col("n").cast("long").alias("source_row"), (F.col("hour") + F.expr("INTERVAL 2 HOUR")).alias("loaded_at"),
    )


def sensors(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """device_id, timestamp (of the event), arrival_time, reading_value, event_type."""
    u = lambda k: uniform(seed + k, F.col("id"))
    kind = F.when(u(1) < ANOMALY, "SENSOR_ANOMALY").when(u(1) < ANOMALY + BACKDATED, "BACKDATED").when(u(1) < ANOMALY + BACKDATED + LATE, "LATE").otherwise("NORMAL")
    arrival = F.timestamp_seconds(F.lit(1_780_000_000) + F.col("id") * 60)
    back = F.when(F.col("event_type") == "BACKDATED", 86400 + F.floor(u(2) * 86400)).when(F.col("event_type") == "LATE", 300 + F.floor(u(2) * 3300)).otherwise(0)
    r = spark.range(n).withColumn("event_type", kind).withColumn("arrival_time", arrival)
    value = F.when(F.col("event_type") == "SENSOR_ANOMALY", 70 + u(3) * 40).otherwise(22 + u(3) * 16)
    return r.select(F.concat(F.lit("SENSOR_"), (F.col("id") % 5 + 1).cast("string")).alias("device_id"), F.timestamp_seconds(F.unix_seconds("arrival_time") - back).alias("timestamp"), "arrival_time", F.round(value, 2).alias("reading_value"), "event_type")


def order_events(spark: SparkSession, n: int, version: int = 1, seed: int = 42) -> DataFrame:
    """key, value: messages of schema version 1 to 3 as JSON text."""
    u = lambda k: uniform(seed + k, F.col("id"))
    hexes = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    uuid = F.concat_ws("-", *[F.substring(hexes, a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    fields = [uuid.alias("event_id"), F.date_format(F.timestamp_seconds(F.lit(1_790_000_000) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_time"), F.concat(F.lit("ORD-"), (F.col("id") % 997).cast("string")).alias("order_id"), F.floor(u(1) * 1000).cast("int").alias("customer_id"), F.element_at(F.array(*map(F.lit, ("pen", "book", "lamp"))), (F.floor(u(2) * 3) + 1).cast("int")).alias("product"), (F.floor(u(3) * 5) + 1).cast("int").alias("quantity"), F.round(1 + u(4) * 99, 2).alias("unit_price"), F.lit("NEW").alias("status")]
    if version > 1:
        fields += [F.lit("CARD").alias("payment_method"), F.round(u(5) * 30, 1).alias("discount_pct")]
    if version > 2:
        fields += [F.lit("GOLD").alias("loyalty_tier"), (u(6) < 0.2).alias("is_gift"), F.struct(F.lit("Pune").alias("city"), F.lit("MH").alias("state"), F.lit("411001").alias("pincode")).alias("shipping_address")]
    return spark.range(n).select(F.struct(*fields).alias("e")).select(F.col("e.order_id").cast("binary").alias("key"), F.to_json("e").cast("binary").alias("value"))
