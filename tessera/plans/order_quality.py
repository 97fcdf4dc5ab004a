"""Order landing, rules, daily report and upsert over rows derived from `orders`, as text, with planted defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import order_quality as oq
from tessera.sources.tables import table

#: The same text for both engines: every 40th order has the defect of its remainder; every 50th arrives twice.
_ROW = """SELECT CASE o_orderkey % 40 WHEN 1 THEN NULL ELSE concat('ORD-', o_orderkey) END AS order_id,
  CASE o_orderkey % 40 WHEN 2 THEN 'not-a-date' WHEN 3 THEN '2026-13-45T25:61:00Z' WHEN 4 THEN concat(CAST(DATE '2035-01-01' AS STRING), 'T00:00:00Z') ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:15:00Z') END AS order_ts,
  concat('C', o_custkey) AS customer_id, concat('Name ', o_custkey) AS customer_name,
  CASE o_orderkey % 40 WHEN 5 THEN 'local@' WHEN 6 THEN 'local@@domain.org' WHEN 7 THEN 'local @domain.org' WHEN 8 THEN NULL WHEN 9 THEN 'x@host.org trailing' ELSE concat('c', o_custkey, '@mail.example.org') END AS customer_email,
  concat('P', o_orderkey % 97) AS product_id, o_orderpriority AS product_category,
  CASE o_orderkey % 40 WHEN 10 THEN 'two' WHEN 11 THEN '0' WHEN 12 THEN '-2' WHEN 13 THEN '1O0' WHEN 14 THEN NULL ELSE CAST(o_orderkey % 9 + 1 AS STRING) END AS quantity,
  CASE o_orderkey % 40 WHEN 15 THEN '12,50' WHEN 16 THEN 'N/A' ELSE CAST(CAST(o_custkey % 500 + 1 AS DECIMAL(10,2)) AS STRING) END AS unit_price,
  CASE o_orderkey % 40 WHEN 17 THEN 'abc' WHEN 18 THEN '-5.00' WHEN 19 THEN '1e3' ELSE CAST(CAST((o_orderkey % 9 + 1) * (o_custkey % 500 + 1) + CASE o_orderkey % 40 WHEN 20 THEN 50 ELSE 0 END AS DECIMAL(12,2)) AS STRING) END AS amount,
  'INR' AS currency, 'UPI' AS payment_method, CASE o_orderkey % 40 WHEN 21 THEN 'placed' WHEN 22 THEN 'UNKNOWN' ELSE 'PLACED' END AS order_status, 'Pune' AS city,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS batch_ts, concat('orders_', CAST(CAST(o_orderdate AS DATE) AS STRING), '.csv') AS source_file, o_orderkey AS source_row, o_orderdate + INTERVAL 20 HOUR AS loaded_at FROM orders"""
_AGAIN = "SELECT * REPLACE (concat('again_', source_file) AS source_file, loaded_at + INTERVAL 3 HOUR AS loaded_at) FROM landed0 WHERE source_row % 50 = 0"


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).createOrReplaceTempView("orders")
    first = spark.sql(_ROW)
    again = first.filter("source_row % 50 = 0").withColumn("source_file", F.concat(F.lit("again_"), "source_file")).withColumn("loaded_at", F.expr("loaded_at + INTERVAL 3 HOUR"))
    return first.unionByName(again)


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oq.evaluate(landed(spark, sf_dir))


def dq_rows(spark, sf_dir):
    return evaluated(spark, sf_dir).select("source_file", "source_row", "order_id", "occurrence", "quality_status", "quality_reason")


def dq_summary(spark, sf_dir):
    return oq.completeness(evaluated(spark, sf_dir))


def dq_reasons(spark, sf_dir):
    return evaluated(spark, sf_dir).groupBy("quality_reason").agg(F.count("*").alias("n_rows"))


def dq_rule_counts(spark, sf_dir):
    return evaluated(spark, sf_dir).select(F.explode("failed").alias("code")).groupBy("code").agg(F.count("*").alias("n_rows"))


def good_orders(spark, sf_dir):
    good = evaluated(spark, sf_dir).filter("quality_status = 'GOOD'")
    return good.select("order_id", "order_at", F.col("quantity_value").alias("quantity"), F.col("unit_price_value").alias("unit_price"), F.col("amount_value").alias("amount"))


def reconciliation(spark, sf_dir):
    e = evaluated(spark, sf_dir)
    stale = e.filter("source_row % 101 <> 0").withColumn("quality_reason", F.when(F.col("source_row") % 103 == 0, "stale").otherwise(F.col("quality_reason")))
    return oq.reconcile(e, stale, ["source_file", "source_row"], ["quality_status", "quality_reason"])


def eod_report(spark, sf_dir):
    return oq.daily_report(evaluated(spark, sf_dir))


def eod_upsert(spark, sf_dir):
    """Reports of even days exist from an earlier run; the new run brings all days that are multiples of three."""
    r = oq.daily_report(evaluated(spark, sf_dir)).select("report_date", "total", "bad")
    old = r.filter("day(report_date) % 2 = 0").select("report_date", (F.col("total") - 1).alias("total"), "bad", F.lit("run1").alias("created_at"), F.lit("run1").alias("updated_at"), F.lit(1).cast("long").alias("run_count"))
    new = r.filter("day(report_date) % 3 = 0").withColumn("updated_at", F.lit("run2"))
    return oq.merge(old, new, "report_date", ["total", "bad"])


def eod_mail(spark, sf_dir):
    return oq.report_mail(oq.daily_report(evaluated(spark, sf_dir)))


def batch_keys(spark, sf_dir):
    """Object key and digest of each landed file."""
    files = landed(spark, sf_dir).groupBy("source_file", "batch_ts").agg(F.count("*").alias("n_rows"))
    key = F.concat(F.lit("year="), F.substring("batch_ts", 1, 4), F.lit("/month="), F.substring("batch_ts", 6, 2), F.lit("/day="), F.substring("batch_ts", 9, 2), F.lit("/"), F.col("source_file"))
    return files.select(key.alias("object_key"), F.md5(F.concat_ws("|", "source_file", "batch_ts")).alias("batch_id"), "n_rows")


_CODE = dict(zip([c[:4] for c in oq.CODES], oq.CODES, strict=True))
_NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$'"
_VALUE = lambda c: f"CASE WHEN regexp_matches(trim({c}), {_NUM}) THEN TRY_CAST(trim({c}) AS DECIMAL(18,4)) END AS {c}_value"
_EVAL = f"""landed0 AS ({_ROW}), landed AS (FROM landed0 UNION ALL {_AGAIN}),
p AS (SELECT *, try_strptime(order_ts, '%Y-%m-%dT%H:%M:%SZ') AS order_at, {_VALUE("quantity")}, {_VALUE("unit_price")}, {_VALUE("amount")},
  CASE WHEN order_id IS NOT NULL THEN row_number() OVER (PARTITION BY order_id ORDER BY loaded_at, source_file, source_row) END AS occurrence FROM landed),
f AS (SELECT *, list_filter([
  CASE WHEN {" OR ".join(f"{c} IS NULL" for c in oq.REQUIRED)} THEN '{_CODE["DQ01"]}' END,
  CASE WHEN quantity IS NOT NULL AND quantity_value IS NULL THEN '{_CODE["DQ02"]}' END, CASE WHEN quantity_value <= 0 THEN '{_CODE["DQ03"]}' END,
  CASE WHEN unit_price IS NOT NULL AND unit_price_value IS NULL THEN '{_CODE["DQ04"]}' END, CASE WHEN amount IS NOT NULL AND amount_value IS NULL THEN '{_CODE["DQ05"]}' END,
  CASE WHEN amount_value <= 0 THEN '{_CODE["DQ06"]}' END, CASE WHEN abs(amount_value - quantity_value * unit_price_value) > 0.01 THEN '{_CODE["DQ07"]}' END,
  CASE WHEN NOT regexp_full_match(customer_email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}') THEN '{_CODE["DQ08"]}' END,
  CASE WHEN order_ts IS NOT NULL AND (order_at IS NULL OR order_at > loaded_at) THEN '{_CODE["DQ09"]}' END,
  CASE WHEN order_status NOT IN ('PLACED', 'SHIPPED', 'DELIVERED', 'CANCELLED', 'RETURNED') THEN '{_CODE["DQ10"]}' END,
  CASE WHEN occurrence > 1 THEN '{_CODE["DQ11"]}' END], lambda x: x IS NOT NULL) AS failed FROM p),
e AS (SELECT *, CASE WHEN len(failed) = 0 THEN 'GOOD' ELSE 'BAD' END AS quality_status, nullif(array_to_string(failed, ';'), '') AS quality_reason FROM f)"""
_PCT = lambda a, b: f"CAST(round(CAST(100.0::DOUBLE * {a} / nullif({b}, 0) AS DECIMAL(38,10)), 2) AS DECIMAL(28,2))"
_REPORT = f"""{_EVAL}, d AS (SELECT *, CAST(loaded_at + INTERVAL '5 hours 30 minutes' AS DATE) AS report_date FROM e),
c AS (SELECT report_date, code, count(*) AS n FROM (SELECT report_date, unnest(failed) AS code FROM d) GROUP BY ALL),
rs AS (SELECT report_date, string_agg(code || '=' || n, '; ' ORDER BY n DESC, code) AS reasons FROM c GROUP BY report_date),
a AS (SELECT report_date, count(*) AS total, count(*) FILTER (WHERE quality_status = 'GOOD') AS good, count(*) FILTER (WHERE quality_status = 'BAD') AS bad, count(DISTINCT source_file) AS files FROM d GROUP BY report_date),
b AS (SELECT *, {_PCT("good", "total")} AS good_pct, {_PCT("bad", "total")} AS bad_pct FROM a LEFT JOIN rs USING (report_date)),
h AS (SELECT x.report_date, count(*) AS n, sum(y.total) AS st, sum(y.bad_pct) AS sb, string_agg(strftime(y.report_date, '%m-%d') || ':' || y.total, ' | ' ORDER BY y.report_date) AS history
      FROM b x JOIN b y ON y.report_date BETWEEN x.report_date - 6 AND x.report_date - 1 GROUP BY x.report_date),
g AS (SELECT b.*, p.total AS previous_total, b.total - p.total AS change, {_PCT("(b.total - p.total)", "p.total")} AS change_pct, coalesce(n, 0) + 1 AS days,
        CAST(round(CAST(CAST(coalesce(st, 0) + b.total AS DOUBLE) / (coalesce(n, 0) + 1) AS DECIMAL(38,10)), 2) AS DECIMAL(28,2)) AS avg_total,
        CAST(round(CAST((coalesce(CAST(sb AS DOUBLE), 0) + CAST(b.bad_pct AS DOUBLE)) / (coalesce(n, 0) + 1) AS DECIMAL(38,10)), 2) AS DECIMAL(28,2)) AS avg_bad,
        concat_ws(' | ', history, strftime(b.report_date, '%m-%d') || ':' || b.total) AS trend, CASE WHEN b.total = 0 OR b.bad_pct >= 10 THEN 'WARNING' ELSE 'HEALTHY' END AS status
      FROM b LEFT JOIN b p ON p.report_date = b.report_date - 1 LEFT JOIN h ON h.report_date = b.report_date),
r AS (SELECT *, 'BAD rate ' || bad_pct || CASE WHEN bad_pct >= 10 THEN '% reaches the threshold.' ELSE '% is below the threshold.' END
        || CASE WHEN previous_total IS NULL THEN ' No day before to compare.' WHEN change_pct >= 25 THEN ' Volume rose by ' || change_pct || '%.' WHEN change_pct <= -25 THEN ' Volume fell by ' || change_pct || '%.' ELSE ' Volume changed by ' || change_pct || '%.' END
        || coalesce(' Most frequent failure: ' || split_part(reasons, '; ', 1) || '.', '') AS remarks FROM g)"""

QUERIES = {f"a7_{f.__name__}": f for f in (dq_rows, dq_summary, dq_reasons, dq_rule_counts, good_orders, reconciliation, eod_report, eod_upsert, eod_mail, batch_keys)}
ORACLE = {
    "a7_dq_rows": f"WITH {_EVAL} SELECT source_file, source_row, order_id, occurrence, quality_status, quality_reason FROM e",
    "a7_dq_summary": f"""WITH {_EVAL} SELECT *, {_PCT("good_rows", "total_rows")} AS good_pct, {_PCT("bad_rows", "total_rows")} AS bad_pct, good_rows + bad_rows = total_rows AND distinct_keys = total_rows AS complete FROM (
        SELECT count(*) AS total_rows, count(*) FILTER (WHERE quality_status = 'GOOD') AS good_rows, count(*) FILTER (WHERE quality_status = 'BAD') AS bad_rows, count(DISTINCT (source_file, source_row)) AS distinct_keys,
        count(*) FILTER (WHERE (quality_status = 'GOOD') <> (quality_reason IS NULL)) AS inconsistent FROM e)""",
    "a7_dq_reasons": f"WITH {_EVAL} SELECT quality_reason, count(*) AS n_rows FROM e GROUP BY quality_reason",
    "a7_dq_rule_counts": f"WITH {_EVAL} SELECT code, count(*) AS n_rows FROM (SELECT unnest(failed) AS code FROM e) GROUP BY code",
    "a7_good_orders": f"WITH {_EVAL} SELECT order_id, order_at, quantity_value AS quantity, unit_price_value AS unit_price, amount_value AS amount FROM e WHERE quality_status = 'GOOD'",
    "a7_reconciliation": f"""WITH {_EVAL}, s AS (SELECT * REPLACE (CASE WHEN source_row % 103 = 0 THEN 'stale' ELSE quality_reason END AS quality_reason) FROM e WHERE source_row % 101 <> 0)
        SELECT count(e.source_file) AS raw_rows, count(*) FILTER (WHERE e.source_file IS NOT NULL AND s.source_file IS NOT NULL AND (e.quality_status IS DISTINCT FROM s.quality_status OR e.quality_reason IS DISTINCT FROM s.quality_reason)) AS mismatched,
               count(*) FILTER (WHERE s.source_file IS NULL) AS not_curated, count(*) FILTER (WHERE e.source_file IS NULL) AS not_raw FROM e FULL JOIN s ON e.source_file = s.source_file AND e.source_row = s.source_row""",
    "a7_eod_report": f"WITH {_REPORT} SELECT report_date, total, good, bad, good_pct, bad_pct, files, reasons, previous_total, change, change_pct, days, avg_total, avg_bad, trend, status, remarks FROM r",
    "a7_eod_upsert": f"""WITH {_REPORT}, o AS (SELECT report_date, total - 1 AS total, bad FROM r WHERE day(report_date) % 2 = 0), w AS (SELECT report_date, total, bad FROM r WHERE day(report_date) % 3 = 0)
        SELECT report_date, coalesce(w.total, o.total) AS total, coalesce(w.bad, o.bad) AS bad, CASE WHEN o.total IS NOT NULL THEN 'run1' ELSE 'run2' END AS created_at, CASE WHEN w.total IS NOT NULL THEN 'run2' ELSE 'run1' END AS updated_at,
               CAST((o.total IS NOT NULL)::INT + (w.total IS NOT NULL)::INT AS BIGINT) AS run_count FROM o FULL JOIN w USING (report_date)""",
    "a7_eod_mail": f"""WITH {_REPORT} SELECT report_date, concat_ws(' - ', 'Order quality', CAST(report_date AS VARCHAR), status) AS subject, concat_ws(chr(10), 'Report date: ' || report_date, 'Status: ' || status, 'Total: ' || total,
        'GOOD: ' || good || ' (' || coalesce(good_pct || '%', 'n/a') || ')', 'BAD: ' || bad || ' (' || coalesce(bad_pct || '%', 'n/a') || ')', 'Day before: ' || coalesce(CAST(previous_total AS VARCHAR), 'n/a'), 'Trend: ' || trend,
        'Failures:' || chr(10) || coalesce(replace(reasons, '; ', chr(10)), 'none'), remarks) AS body FROM r""",
    "a7_batch_keys": f"""WITH {_EVAL} SELECT 'year=' || batch_ts[1:4] || '/month=' || batch_ts[6:7] || '/day=' || batch_ts[9:10] || '/' || source_file AS object_key, md5(concat_ws('|', source_file, batch_ts)) AS batch_id, count(*) AS n_rows
        FROM landed GROUP BY source_file, batch_ts""",
}
