"""Quality rules for landed orders, the daily report over them, and its keyed upsert.

A rule is a code and a condition; a null condition passes. One evaluated table feeds good and bad rows alike, so they can't disagree.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up, parse_decimal
from tessera.operators.windows import occurrence

#: The business columns, the order states, the rule codes.
REQUIRED = (
    "order_id", "order_ts", "customer_id", "customer_name", "customer_email", "product_id", "product_category", "quantity",
    "unit_price", "amount", "currency", "payment_method", "order_status", "city", "batch_ts",
)
STATES = ("PLACED", "SHIPPED", "DELIVERED", "CANCELLED", "RETURNED")
#: Fixed value: the pattern of an address.
EMAIL = r"^(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,})$"
TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"
CODES = (
    "DQ01_REQUIRED_FIELDS", "DQ02_QUANTITY_NUMERIC", "DQ03_QUANTITY_POSITIVE", "DQ04_UNIT_PRICE_NUMERIC", "DQ05_AMOUNT_NUMERIC", "DQ06_AMOUNT_POSITIVE",
    "DQ07_AMOUNT_MATCH", "DQ08_EMAIL_VALID", "DQ09_ORDER_TS_NOT_FUTURE", "DQ10_STATUS_VALID", "DQ11_DUPLICATE_ORDER_ID",
)
TOLERANCE = "0.01"


def parsed(landed: DataFrame, shifted_before: str | None = None, zone: str = "America/Los_Angeles") -> DataFrame:
    """Adds typed twins of the text columns; loads before `shifted_before` were stamped in `zone` and are turned to UTC."""
    loaded = F.col("loaded_at")
    if shifted_before:
        loaded = F.when(loaded < F.lit(shifted_before).cast("timestamp_ntz"), F.convert_timezone(F.lit(zone), F.lit("UTC"), loaded)).otherwise(loaded)
    return landed.select(
        "*", F.try_to_timestamp("order_ts", F.lit(TIMESTAMP)).cast("timestamp_ntz").alias("order_at"), loaded.alias("loaded_utc"),
        *[parse_decimal(c).alias(f"{c}_value") for c in ("quantity", "unit_price", "amount")],
    )


def rules() -> list[tuple[str, Column]]:
    missing = F.col(REQUIRED[0]).isNull()
    for c in REQUIRED[1:]:
        missing = missing | F.col(c).isNull()
    unread = lambda c: F.col(c).isNotNull() & F.col(f"{c}_value").isNull()
    quantity, price, amount = (F.col(f"{c}_value") for c in ("quantity", "unit_price", "amount"))
    off = F.abs(amount.cast("decimal(38,8)") - (quantity.cast("decimal(18,4)") * price.cast("decimal(18,4)")).cast("decimal(38,8)")) > F.lit(TOLERANCE).cast("decimal(4,2)")
    late = F.col("order_ts").isNotNull() & (F.col("order_at").isNull() | (F.col("order_at") > F.col("loaded_utc")))
    found = (
        missing, unread("quantity"), quantity <= 0, unread("unit_price"), unread("amount"), amount <= 0, off,
        ~F.col("customer_email").rlike(EMAIL), late, ~F.col("order_status").isin(*STATES), F.col("occurrence") > 1,
    )
    return list(zip(CODES, found, strict=True))


def evaluate(landed: DataFrame, shifted_before: str | None = None) -> DataFrame:
    """Adds occurrence, failed (codes in rule order), quality_status and quality_reason. No clock is read: reruns agree."""
    typed = occurrence(parsed(landed, shifted_before), "order_id", [F.col("loaded_at"), F.col("source_file"), F.col("source_row")], "occurrence")
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules()]))
    out = typed.withColumn("failed", failed)
    return out.withColumn("quality_status", F.when(F.size("failed") == 0, "GOOD").otherwise("BAD")).withColumn("quality_reason", F.nullif(F.array_join("failed", ";"), F.lit("")))


def completeness(evaluated: DataFrame) -> DataFrame:
    """One row: totals, shares, and whether every landed row came through once with a status that fits its reason."""
    good, bad = F.count_if(F.col("quality_status") == "GOOD"), F.count_if(F.col("quality_status") == "BAD")
    one = evaluated.agg(
        F.count("*").alias("total_rows"), good.alias("good_rows"), bad.alias("bad_rows"), F.countDistinct("source_file", "source_row").alias("distinct_keys"),
        F.count_if((F.col("quality_status") == "GOOD") != F.col("quality_reason").isNull()).alias("inconsistent"),
    )
    share = lambda c: half_up(F.lit(100.0) * F.col(c) / F.nullif(F.col("total_rows"), F.lit(0)), 2)
    return one.select("*", share("good_rows").alias("good_pct"), share("bad_rows").alias("bad_pct"), ((F.col("good_rows") + F.col("bad_rows") == F.col("total_rows")) & (F.col("distinct_keys") == F.col("total_rows"))).alias("complete"))


def reconcile(expected: DataFrame, curated: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join on the keys: rows that differ, and rows on one side only."""
    a, b = expected.select(*keys, F.lit(True).alias("_a"), *[F.col(v).alias(f"_a_{v}") for v in values]), curated.select(*keys, F.lit(True).alias("_b"), *[F.col(v).alias(f"_b_{v}") for v in values])
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}"))
    return a.join(b, keys, "full").agg(
        F.count_if(F.col("_a").isNotNull()).alias("raw_rows"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & differs).alias("mismatched"),
        F.count_if(F.col("_b").isNull()).alias("not_curated"), F.count_if(F.col("_a").isNull()).alias("not_raw"),
    )


def daily_report(evaluated: DataFrame, zone: str = "Asia/Kolkata", bad_threshold: float = 10.0, volume_threshold: float = 25.0) -> DataFrame:
    """A row for each business day of `zone`: counts, shares, reasons, the day before, seven days, status and remarks."""
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("loaded_utc")))
    rows = evaluated.withColumn("report_date", day)
    per = rows.groupBy("report_date").agg(F.count("*").alias("total"), F.count_if(F.col("quality_status") == "GOOD").alias("good"), F.count_if(F.col("quality_status") == "BAD").alias("bad"), F.countDistinct("source_file").alias("files"))
    codes = rows.select("report_date", F.explode("failed").alias("code")).groupBy("report_date", "code").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("code").alias("code"))))
    reasons = codes.groupBy("report_date").agg(listed.alias("listed")).select("report_date", F.array_join(F.transform("listed", lambda x: F.concat_ws("=", x["code"], (-x["o"]).cast("string"))), "; ").alias("reasons"))
    pct = lambda a, b: half_up(F.lit(100.0) * F.col(a) / F.nullif(F.col(b), F.lit(0)), 2)
    per = per.withColumn("good_pct", pct("good", "total")).withColumn("bad_pct", pct("bad", "total")).join(reasons, "report_date", "left")
    before = per.select(F.date_add("report_date", 1).alias("report_date"), F.col("total").alias("previous_total"))
    past = per.select(F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k"), "report_date", "total", "bad_pct").select(F.expr("date_add(report_date, k)").alias("report_date"), F.col("report_date").alias("past"), F.col("total").alias("t"), F.col("bad_pct").alias("b"))
    past = past.groupBy("report_date").agg(F.count("*").alias("n"), F.sum("t").alias("st"), F.sum("b").alias("sb"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("past", "t"))), lambda x: F.concat_ws(":", F.date_format(x["past"], "MM-dd"), x["t"].cast("string"))), " | ").alias("history"))
    x = per.join(before, "report_date", "left").join(past, "report_date", "left")
    x = x.withColumn("change", F.col("total") - F.col("previous_total")).withColumn("change_pct", pct("change", "previous_total")).withColumn("days", (F.coalesce("n", F.lit(0)) + 1).cast("long"))
    x = x.withColumn("avg_total", half_up((F.coalesce("st", F.lit(0)) + F.col("total")).cast("double") / F.col("days"), 2)).withColumn("avg_bad", half_up((F.coalesce(F.col("sb").cast("double"), F.lit(0.0)) + F.col("bad_pct").cast("double")) / F.col("days"), 2))
    x = x.withColumn("trend", F.concat_ws(" | ", "history", F.concat_ws(":", F.date_format("report_date", "MM-dd"), F.col("total").cast("string"))))
    x = x.withColumn("status", F.when((F.col("total") == 0) | (F.col("bad_pct") >= bad_threshold), "WARNING").otherwise("HEALTHY"))
    text = lambda c: F.col(c).cast("string")
    rate = F.when(F.col("bad_pct") >= bad_threshold, F.concat(F.lit("BAD rate "), text("bad_pct"), F.lit("% reaches the threshold."))).otherwise(F.concat(F.lit("BAD rate "), text("bad_pct"), F.lit("% is below the threshold.")))
    volume = (
        F.when(F.col("previous_total").isNull(), " No day before to compare.")
        .when(F.col("change_pct") >= volume_threshold, F.concat(F.lit(" Volume rose by "), text("change_pct"), F.lit("%.")))
        .when(F.col("change_pct") <= -volume_threshold, F.concat(F.lit(" Volume fell by "), text("change_pct"), F.lit("%.")))
        .otherwise(F.concat(F.lit(" Volume changed by "), text("change_pct"), F.lit("%.")))
    )
    top = F.coalesce(F.concat(F.lit(" Most frequent failure: "), F.split_part("reasons", F.lit("; "), F.lit(1)), F.lit(".")), F.lit(""))
    return x.withColumn("remarks", F.concat(rate, volume, top)).select("report_date", "total", "good", "bad", "good_pct", "bad_pct", "files", "reasons", "previous_total", "change", "change_pct", "days", "avg_total", "avg_bad", "trend", "status", "remarks")


#: What a report row says when the run before it failed.
FAILED_REMARK = "The run failed; see details."


def verified_report(report: DataFrame, complete: bool, fresh: bool) -> DataFrame:
    """The report with the status FAILED if rows are missing or counted twice, or if the tables behind it are older than the landed rows."""
    why = "; ".join(text for ok, text in ((complete, "rows do not add up"), (fresh, "tables are not up to date")) if not ok)
    failed = F.lit(not (complete and fresh))
    return report.withColumn("status", F.when(failed, "FAILED").otherwise(F.col("status"))).withColumn("details", F.lit(why or None).cast("string"))


def failure_row(spark: SparkSession, day: str, error: BaseException, like: DataFrame) -> DataFrame:
    """The row of a day whose run broke off: the columns of `like`, nulls but for the date, the status, the remark and the error."""
    known = {"report_date": F.lit(day).cast("date"), "status": F.lit("FAILED"), "remarks": F.lit(FAILED_REMARK), "details": F.lit(f"{type(error).__name__}: {error}"[:1000])}
    names = [*like.columns, *[c for c in known if c not in like.columns]]
    kinds = dict(like.dtypes)
    return spark.range(1).select(*[known.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in names])


def run_report(spark: SparkSession, day: str, build: Callable[[], DataFrame], put: Callable[[DataFrame], None], like: DataFrame) -> None:
    """Builds the day's report and puts it away; if that fails, a failure row is put away as far as that goes, and the error goes on."""
    try:
        put(build())
    except Exception as error:
        with contextlib.suppress(Exception):
            put(failure_row(spark, day, error, like))
        raise


def merge(target: DataFrame, source: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Keyed upsert: matched rows take the source's values, keep created_at and count one more run; others are inserted or stay.

    Both sides have each key once; the join deals by key, so neither side is gathered anywhere.
    """
    s = source.select(F.col(key), *[F.col(v).alias(f"_s_{v}") for v in values], F.col("updated_at").alias("_s_at"), F.lit(True).alias("_new"))
    both = target.join(s, key, "full")
    new = F.col("_new").isNotNull()
    return both.select(
        key, *[F.when(new, F.col(f"_s_{v}")).otherwise(F.col(v)).alias(v) for v in values], F.coalesce("created_at", "_s_at").alias("created_at"),
        F.when(new, F.col("_s_at")).otherwise(F.col("updated_at")).alias("updated_at"), (F.coalesce("run_count", F.lit(0)) + new.cast("int")).cast("long").alias("run_count"),
    )


def report_mail(report: DataFrame) -> DataFrame:
    """report_date, subject, body."""
    show = lambda c, unit="": F.coalesce(F.concat(F.col(c).cast("string"), F.lit(unit)), F.lit("n/a"))
    body = F.concat_ws(
        "\n", F.concat(F.lit("Report date: "), F.col("report_date").cast("string")), F.concat(F.lit("Status: "), F.col("status")), F.concat(F.lit("Total: "), show("total")),
        F.concat(F.lit("GOOD: "), show("good"), F.lit(" ("), show("good_pct", "%"), F.lit(")")), F.concat(F.lit("BAD: "), show("bad"), F.lit(" ("), show("bad_pct", "%"), F.lit(")")),
        F.concat(F.lit("Day before: "), show("previous_total")), F.concat(F.lit("Trend: "), F.col("trend")), F.concat(F.lit("Failures:\n"), F.coalesce(F.replace("reasons", F.lit("; "), F.lit("\n")), F.lit("none"))), F.col("remarks"),
    )
    return report.select("report_date", F.concat_ws(" - ", F.lit("Order quality"), F.col("report_date").cast("string"), "status").alias("subject"), body.alias("body"))
