"""Insurance star schema over the supplied tables: a line is a claim, an order its payment, a supplier the hospital, a part the diagnosis.

Every figure of the reports has an independent twin (roll-up, semi-join, EXISTS, scalar subquery) to reconcile against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up, money, ratio
from tessera.operators.aggregates import count_histogram, rollup_labelled, with_share
from tessera.sources.tables import table

HEAVY = "PROMO"
LEADING = "STANDARD"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    approved = F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(18,4)"))
    return x.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("claim_id"), F.col("l_partkey").alias("diagnosis_id"), F.col("l_suppkey").alias("hospital_id"),
        money("l_extendedprice").alias("claimed"), F.round(approved, 2).cast("decimal(18,2)").alias("approved"), F.col("l_returnflag").alias("status"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "PAID").otherwise("PROCESSING")
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 8 + 1).alias("claim_id"), status.alias("payment_status"), money("o_totalprice").alias("paid"))


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("diagnosis_id"), F.col("p_brand").alias("disease"), F.col("p_type").alias("category"), F.col("p_name").alias("procedure_name"), money("p_retailprice").alias("base_cost"))


def hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    kind = F.concat(F.lit("TYPE"), (F.col("s_nationkey") % 5).cast("string"))
    return s.select(F.col("s_suppkey").alias("hospital_id"), F.col("s_name").alias("hospital_name"), kind.alias("hospital_type"), F.when(F.col("s_acctbal") >= 0, "IN_NETWORK").otherwise("OUT_OF_NETWORK").alias("network_status"))


CTES = """claims AS (
  SELECT l_orderkey * 8 + l_linenumber AS claim_id, l_partkey AS diagnosis_id, l_suppkey AS hospital_id, CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) AS claimed,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))), 2) AS DECIMAL(18,2)) AS approved, l_returnflag AS status FROM lineitem),
payments AS (SELECT o_orderkey * 8 + 1 AS claim_id, CASE WHEN o_orderstatus = 'F' THEN 'PAID' ELSE 'PROCESSING' END AS payment_status, CAST(round(CAST(o_totalprice AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) AS paid FROM orders),
diagnoses AS (SELECT p_partkey AS diagnosis_id, p_brand AS disease, p_type AS category, p_name AS procedure_name, CAST(round(CAST(p_retailprice AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) AS base_cost FROM part),
hospitals AS (SELECT s_suppkey AS hospital_id, s_name AS hospital_name, 'TYPE' || CAST(s_nationkey % 5 AS VARCHAR) AS hospital_type, CASE WHEN s_acctbal >= 0 THEN 'IN_NETWORK' ELSE 'OUT_OF_NETWORK' END AS network_status FROM supplier),
paid_by_claim AS (SELECT claim_id, sum(paid) AS paid_all, sum(paid) FILTER (WHERE payment_status = 'PAID') AS paid_settled FROM payments GROUP BY claim_id),
totals AS (SELECT sum(claimed) AS all_claimed, sum(approved) AS all_approved FROM claims)"""


def total(c: str, name: str) -> Column:
    return F.sum(c).cast("decimal(38,2)").alias(name)


def mean(c: str, name: str) -> Column:
    return half_up(F.sum(c).cast("double") / F.count(c), 2).alias(name)


def percent(a: str, b: str, name: str) -> Column:
    return ratio(F.sum(a), F.sum(b), 100.0).alias(name)


def _mean(c: str, name: str) -> str:
    return f"CAST(round(CAST(CAST(sum({c}) AS DOUBLE) / count({c}) AS DECIMAL(38,10)), 2) AS DECIMAL(28,2)) AS {name}"


def _percent(a: str, b: str, name: str) -> str:
    return f"100.0::DOUBLE * CAST(sum({a}) AS DOUBLE) / nullif(CAST(sum({b}) AS DOUBLE), 0) AS {name}"


def _share(value: str, name: str) -> str:
    return f"100.0::DOUBLE * CAST({value} AS DOUBLE) / nullif(CAST(sum({value}) OVER () AS DOUBLE), 0) AS {name}"


def paid_by_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments summed before any join, so that a claim with several payments isn't counted several times."""
    return payments(spark, sf_dir).groupBy("claim_id").agg(total("paid", "paid_all"), F.sum(F.when(F.col("payment_status") == "PAID", F.col("paid"))).cast("decimal(38,2)").alias("paid_settled"))


def _with_diagnosis(spark, sf_dir):
    return claims(spark, sf_dir).join(diagnoses(spark, sf_dir), "diagnosis_id")


def _with_payments(spark, sf_dir):
    return _with_diagnosis(spark, sf_dir).join(paid_by_claim(spark, sf_dir), "claim_id", "left")


def disease_spend(spark, sf_dir):
    out = _with_diagnosis(spark, sf_dir).groupBy("disease", "category").agg(F.count("*").alias("claims"), total("claimed", "total_claimed"), total("approved", "total_approved"), mean("claimed", "avg_claim"), percent("approved", "claimed", "approved_pct"))
    return with_share(out, "total_claimed", "pct_of_total").orderBy(F.desc("total_claimed"), "disease", "category").limit(10)


def category_spend(spark, sf_dir):
    return with_share(_with_diagnosis(spark, sf_dir).groupBy("category").agg(F.count("*").alias("claims"), total("claimed", "total_claimed")), "total_claimed", "pct_of_total")


def grand_total(spark, sf_dir):
    return claims(spark, sf_dir).agg(total("claimed", "grand_total"))


def payment_profile(spark, sf_dir):
    return payments(spark, sf_dir).groupBy("payment_status").agg(F.count("*").alias("n_rows"), F.countDistinct("claim_id").alias("distinct_claims"), total("paid", "sum_paid"))


def payments_per_claim(spark, sf_dir):
    return count_histogram(payments(spark, sf_dir), "claim_id", "payments_per_claim", "num_claims")


def disease_report(spark, sf_dir):
    out = _with_payments(spark, sf_dir).groupBy("disease", "category").agg(
        F.count("*").alias("claims"), total("claimed", "total_claimed"), mean("claimed", "avg_claim"), total("approved", "total_approved"), mean("approved", "avg_approved"),
        percent("approved", "claimed", "approval_pct"), total("paid_settled", "paid_settled"), total("paid_all", "paid_all"),
    )
    out = with_share(with_share(out, "total_claimed", "pct_claimed"), "total_approved", "pct_approved")
    return out.orderBy(F.desc("total_claimed"), "disease", "category").limit(15)


def portfolio(spark, sf_dir):
    c = claims(spark, sf_dir).agg(total("claimed", "total_claimed"), total("approved", "total_approved"))
    p = payments(spark, sf_dir).agg(F.sum(F.when(F.col("payment_status") == "PAID", F.col("paid"))).cast("decimal(38,2)").alias("paid_settled"), total("paid", "paid_all"))
    both = c.join(F.broadcast(p))  # one row each
    return both.withColumn("approval_pct", ratio("total_approved", "total_claimed", 100.0)).withColumn("settled_pct", ratio("paid_settled", "total_approved", 100.0))


def category_report(spark, sf_dir):
    out = _with_payments(spark, sf_dir).groupBy("category").agg(F.count("*").alias("claims"), total("claimed", "total_claimed"), total("approved", "total_approved"), total("paid_settled", "paid_settled"), percent("approved", "claimed", "approval_pct"))
    return with_share(out, "total_claimed", "pct_claimed")


def driver_types(spark, sf_dir):
    """Volume or severity: thresholds are the means over diseases, not literals of one data set."""
    per = _with_diagnosis(spark, sf_dir).groupBy("disease", "category").agg(F.count("*").alias("claims"), total("claimed", "total_claimed"))
    per = per.withColumn("avg_claim", F.col("total_claimed").cast("double") / F.col("claims"))
    at = per.agg((F.sum("claims").cast("double") / F.count("*")).alias("many"), F.min("avg_claim").alias("lo"), F.max("avg_claim").alias("hi"))
    volume, severity = F.col("claims") > F.col("many"), F.col("avg_claim") > (F.col("lo") + F.col("hi")) / 2
    kind = F.when(volume & severity, "both").when(volume, "volume").when(severity, "severity").otherwise("neither")
    return per.join(F.broadcast(at)).select("disease", "category", "claims", half_up("avg_claim", 0).alias("avg_claim"), "total_claimed", kind.alias("driver_type"))


def heavy_by_network(spark, sf_dir):
    c = _with_diagnosis(spark, sf_dir).filter(F.col("category") == HEAVY).join(hospitals(spark, sf_dir), "hospital_id")
    return c.groupBy("network_status").agg(F.count("*").alias("claims"), total("claimed", "total_claimed"), mean("claimed", "avg_claim"), percent("approved", "claimed", "approval_pct"))


def heavy_by_procedure(spark, sf_dir):
    c = _with_diagnosis(spark, sf_dir).filter(F.col("category") == HEAVY)
    out = c.groupBy("procedure_name").agg(F.count("*").alias("claims"), total("claimed", "total_claimed"), mean("claimed", "avg_claim"), mean("base_cost", "avg_base_cost"))
    return out.orderBy(F.desc("total_claimed"), "procedure_name").limit(8)


def status_rollup(spark, sf_dir):
    return rollup_labelled(claims(spark, sf_dir), "status", [F.count("*").alias("claims"), total("claimed", "total_claimed"), total("approved", "total_approved")], ">> GRAND TOTAL")


def paid_only(spark, sf_dir):
    return payments(spark, sf_dir).filter(F.col("payment_status") == "PAID").agg(F.count("*").alias("paid_rows"), total("paid", "settled"))


def category_semi(spark, sf_dir):
    c = claims(spark, sf_dir)
    part = c.join(diagnoses(spark, sf_dir).filter(F.col("category") == LEADING), "diagnosis_id", "left_semi").agg(F.count("*").alias("claims"), total("claimed", "claimed"))
    return part.join(F.broadcast(c.agg(total("claimed", "all_claimed")))).select("claims", "claimed", ratio("claimed", "all_claimed", 100.0).alias("share_pct"))


def settled_nested_semi(spark, sf_dir):
    ids = claims(spark, sf_dir).join(diagnoses(spark, sf_dir).filter(F.col("category") == LEADING), "diagnosis_id", "left_semi")
    return payments(spark, sf_dir).filter(F.col("payment_status") == "PAID").join(ids, "claim_id", "left_semi").agg(F.count("*").alias("paid_rows"), total("paid", "settled"))


def procedure_rollup(spark, sf_dir):
    x = _with_diagnosis(spark, sf_dir).filter((F.col("category") == HEAVY) & F.col("procedure_name").isin("red widget", "small ring"))
    return rollup_labelled(x, "procedure_name", [F.count("*").alias("claims"), total("claimed", "total_claimed")], ">> ALL")


def payment_counts(spark, sf_dir):
    per = payments(spark, sf_dir).groupBy("claim_id").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_rows"), F.countDistinct("claim_id").alias("distinct_claims"), F.max("n").alias("most"))


def join_reconciliation(spark, sf_dir):
    c, p = claims(spark, sf_dir), payments(spark, sf_dir)
    matched = p.join(c.select("claim_id").distinct(), "claim_id", "left_semi")
    paid = F.sum(F.when(F.col("payment_status") == "PAID", F.col("paid"))).cast("decimal(38,2)")
    a = p.agg(paid.alias("standalone_paid"), F.count("*").alias("payment_rows"))
    return a.join(F.broadcast(matched.agg(paid.alias("matched_paid"), F.count("*").alias("matched_rows"))))


def hospital_spend(spark, sf_dir):
    sums = claims(spark, sf_dir).groupBy("hospital_id").agg(F.count("*").alias("claims"), total("claimed", "total_claimed"), mean("claimed", "avg_claim"))
    return with_share(sums.join(hospitals(spark, sf_dir), "hospital_id"), "total_claimed", "pct_of_total").orderBy(F.desc("total_claimed"), "hospital_id").limit(10)


def hospital_context(spark, sf_dir):
    x = claims(spark, sf_dir).agg(total("claimed", "grand_total"), F.countDistinct("hospital_id").alias("hospitals"), mean("claimed", "avg_claim"), F.count("*").alias("n"))
    return x.select("grand_total", "hospitals", "avg_claim", half_up(F.col("n").cast("double") / F.col("hospitals"), 0).alias("claims_per_hospital"))


def hospital_report(spark, sf_dir):
    x = claims(spark, sf_dir).join(paid_by_claim(spark, sf_dir), "claim_id", "left").groupBy("hospital_id").agg(
        F.count("*").alias("claims"), total("claimed", "total_claimed"), mean("claimed", "avg_claim"), half_up(F.median("claimed"), 2).alias("median_claim"), total("approved", "total_approved"),
        total("paid_settled", "paid_settled"), percent("approved", "claimed", "approval_pct"), percent("paid_settled", "approved", "settlement_pct"),
    )
    return with_share(x.join(hospitals(spark, sf_dir), "hospital_id"), "total_claimed", "pct_of_total").orderBy(F.desc("total_claimed"), "hospital_id").limit(15)


def _per_hospital(spark, sf_dir):
    return claims(spark, sf_dir).groupBy("hospital_id").agg(F.count("*").alias("claims"), total("claimed", "total_claimed")).withColumn("avg_claim", F.col("total_claimed").cast("double") / F.col("claims"))


def hospital_dispersion(spark, sf_dir):
    x = _per_hospital(spark, sf_dir)
    t = F.col("total_claimed").cast("double")
    return x.agg(
        F.min("total_claimed").alias("min_total"), F.max("total_claimed").alias("max_total"), half_up(F.avg(t), 0).alias("avg_total"), half_up(F.stddev_samp(t), 0).alias("sd_total"),
        half_up(F.max(t) / F.avg(t), 2).alias("max_vs_avg"), half_up(F.min("avg_claim"), 0).alias("min_avg"), half_up(F.max("avg_claim"), 0).alias("max_avg"), half_up(F.avg("avg_claim"), 0).alias("mean_avg"),
    )


def _outliers(x: DataFrame) -> DataFrame:
    """hospital_id with whether its mean lies over mean + 2 deviations; the figures are one row."""
    stats = x.agg(F.avg("avg_claim").alias("m"), F.stddev_samp("avg_claim").alias("s"))
    return x.join(F.broadcast(stats)).withColumn("limit", F.col("m") + 2 * F.col("s"))


def outlier_count(spark, sf_dir):
    x = _outliers(_per_hospital(spark, sf_dir))
    return x.agg(F.count_if(F.col("avg_claim") > F.col("limit")).alias("above"), half_up(F.max("m"), 0).alias("mean_avg"), half_up(F.max("limit"), 0).alias("threshold"))


def network_comparison(spark, sf_dir):
    x = claims(spark, sf_dir).join(hospitals(spark, sf_dir), "hospital_id").join(paid_by_claim(spark, sf_dir), "claim_id", "left")
    x = x.groupBy("network_status").agg(F.countDistinct("hospital_id").alias("hospitals"), F.count("*").alias("claims"), total("claimed", "total_claimed"), mean("claimed", "avg_claim"), total("approved", "total_approved"), percent("approved", "claimed", "approval_pct"), percent("paid_settled", "approved", "settlement_pct"))
    return with_share(x, "total_claimed", "pct_of_total")


def type_comparison(spark, sf_dir):
    x = claims(spark, sf_dir).join(hospitals(spark, sf_dir), "hospital_id").groupBy("hospital_type").agg(F.countDistinct("hospital_id").alias("hospitals"), F.count("*").alias("claims"), total("claimed", "total_claimed"), mean("claimed", "avg_claim"), percent("approved", "claimed", "approval_pct"))
    return with_share(x, "total_claimed", "pct_of_total")


def _top_hospital(spark, sf_dir):
    return _per_hospital(spark, sf_dir).orderBy(F.desc("total_claimed"), "hospital_id").limit(1).select("hospital_id")


def top_hospital_diseases(spark, sf_dir):
    x = _with_diagnosis(spark, sf_dir).join(F.broadcast(_top_hospital(spark, sf_dir)), "hospital_id", "left_semi")
    return x.groupBy("disease", "category").agg(F.count("*").alias("claims"), total("claimed", "total_claimed"), mean("claimed", "avg_claim")).orderBy(F.desc("total_claimed"), "disease", "category").limit(6)


def case_mix(spark, sf_dir):
    flagged = _outliers(_per_hospital(spark, sf_dir)).select("hospital_id", F.when(F.col("avg_claim") > F.col("limit"), "outlier").otherwise("rest").alias("grp"))
    x = _with_diagnosis(spark, sf_dir).join(flagged, "hospital_id")
    lead = F.col("category") == LEADING
    return x.groupBy("grp").agg(F.count("*").alias("claims"), (F.lit(100.0) * F.count_if(lead) / F.count("*")).alias("claim_share_pct"), (F.lit(100.0) * F.sum(F.when(lead, F.col("claimed"))).cast("double") / F.sum("claimed").cast("double")).alias("spend_share_pct"), mean("claimed", "avg_claim"))


def hospital_total_check(spark, sf_dir):
    return _per_hospital(spark, sf_dir).agg(total("total_claimed", "sum_of_totals"))


def top_hospital_check(spark, sf_dir):
    top, c = F.broadcast(_top_hospital(spark, sf_dir)), claims(spark, sf_dir)
    mine = c.join(top, "hospital_id", "left_semi")
    settled = payments(spark, sf_dir).filter(F.col("payment_status") == "PAID").join(mine, "claim_id", "left_semi").agg(F.count("*").alias("paid_rows"), total("paid", "paid_settled"))
    own = mine.agg(F.count("*").alias("claims"), total("claimed", "total_claimed"), mean("claimed", "avg_claim"), total("approved", "total_approved"))
    both = own.join(F.broadcast(settled)).join(F.broadcast(c.agg(total("claimed", "all_claimed"))))
    return both.withColumn("share_pct", ratio("total_claimed", "all_claimed", 100.0)).drop("all_claimed")


def network_union(spark, sf_dir):
    c, h = claims(spark, sf_dir), hospitals(spark, sf_dir)
    one = lambda net: c.join(h.filter(F.col("network_status") == net), "hospital_id", "left_semi").agg(F.lit(net).alias("net"), F.count("*").alias("claims"), total("claimed", "total_claimed"))
    return one("IN_NETWORK").unionByName(one("OUT_OF_NETWORK"))


_D = "FROM claims JOIN diagnoses USING (diagnosis_id)"
_DP = f"{_D} LEFT JOIN paid_by_claim USING (claim_id)"
_PER = "per AS (SELECT hospital_id, count(*) AS claims, sum(claimed) AS total_claimed, CAST(sum(claimed) AS DOUBLE) / count(*) AS avg_claim FROM claims GROUP BY hospital_id)"
_TOP = "(SELECT hospital_id FROM per ORDER BY total_claimed DESC, hospital_id LIMIT 1)"
_R0 = lambda x, n=0: f"CAST(round(CAST({x} AS DECIMAL(38,10)), {n}) AS DECIMAL(28,{n}))"

_BODY = {
    "disease_spend": f"SELECT *, {_share('total_claimed', 'pct_of_total')} FROM (SELECT disease, category, count(*) AS claims, sum(claimed) AS total_claimed, sum(approved) AS total_approved, {_mean('claimed', 'avg_claim')}, {_percent('approved', 'claimed', 'approved_pct')} {_D} GROUP BY disease, category) ORDER BY total_claimed DESC, disease, category LIMIT 10",
    "category_spend": f"SELECT *, {_share('total_claimed', 'pct_of_total')} FROM (SELECT category, count(*) AS claims, sum(claimed) AS total_claimed {_D} GROUP BY category)",
    "grand_total": "SELECT sum(claimed) AS grand_total FROM claims",
    "payment_profile": "SELECT payment_status, count(*) AS n_rows, count(DISTINCT claim_id) AS distinct_claims, sum(paid) AS sum_paid FROM payments GROUP BY payment_status",
    "payments_per_claim": "SELECT payments_per_claim, count(*) AS num_claims FROM (SELECT claim_id, count(*) AS payments_per_claim FROM payments GROUP BY claim_id) GROUP BY payments_per_claim",
    "disease_report": f"SELECT *, {_share('total_claimed', 'pct_claimed')}, {_share('total_approved', 'pct_approved')} FROM (SELECT disease, category, count(*) AS claims, sum(claimed) AS total_claimed, {_mean('claimed', 'avg_claim')}, sum(approved) AS total_approved, {_mean('approved', 'avg_approved')}, {_percent('approved', 'claimed', 'approval_pct')}, sum(paid_settled) AS paid_settled, sum(paid_all) AS paid_all {_DP} GROUP BY disease, category) ORDER BY total_claimed DESC, disease, category LIMIT 15",
    "portfolio": "SELECT total_claimed, total_approved, paid_settled, paid_all, 100.0::DOUBLE * CAST(total_approved AS DOUBLE) / CAST(total_claimed AS DOUBLE) AS approval_pct, 100.0::DOUBLE * CAST(paid_settled AS DOUBLE) / CAST(total_approved AS DOUBLE) AS settled_pct FROM (SELECT sum(claimed) AS total_claimed, sum(approved) AS total_approved FROM claims), (SELECT sum(paid) FILTER (WHERE payment_status = 'PAID') AS paid_settled, sum(paid) AS paid_all FROM payments)",
    "category_report": f"SELECT *, {_share('total_claimed', 'pct_claimed')} FROM (SELECT category, count(*) AS claims, sum(claimed) AS total_claimed, sum(approved) AS total_approved, sum(paid_settled) AS paid_settled, {_percent('approved', 'claimed', 'approval_pct')} {_DP} GROUP BY category)",
    "driver_types": f"SELECT disease, category, claims, {_R0('avg_claim')} AS avg_claim, total_claimed, CASE WHEN claims > many AND avg_claim > mid THEN 'both' WHEN claims > many THEN 'volume' WHEN avg_claim > mid THEN 'severity' ELSE 'neither' END AS driver_type FROM (SELECT disease, category, count(*) AS claims, sum(claimed) AS total_claimed, CAST(sum(claimed) AS DOUBLE) / count(*) AS avg_claim, CAST(sum(count(*)) OVER () AS DOUBLE) / count(*) OVER () AS many, (min(CAST(sum(claimed) AS DOUBLE) / count(*)) OVER () + max(CAST(sum(claimed) AS DOUBLE) / count(*)) OVER ()) / 2 AS mid {_D} GROUP BY disease, category)",
    "heavy_by_network": f"SELECT network_status, count(*) AS claims, sum(claimed) AS total_claimed, {_mean('claimed', 'avg_claim')}, {_percent('approved', 'claimed', 'approval_pct')} {_D} JOIN hospitals USING (hospital_id) WHERE category = '{HEAVY}' GROUP BY network_status",
    "heavy_by_procedure": f"SELECT procedure_name, count(*) AS claims, sum(claimed) AS total_claimed, {_mean('claimed', 'avg_claim')}, {_mean('base_cost', 'avg_base_cost')} {_D} WHERE category = '{HEAVY}' GROUP BY procedure_name ORDER BY total_claimed DESC, procedure_name LIMIT 8",
    "status_rollup": "SELECT CASE WHEN grouping(status) = 1 THEN '>> GRAND TOTAL' ELSE status END AS status, count(*) AS claims, sum(claimed) AS total_claimed, sum(approved) AS total_approved FROM claims GROUP BY ROLLUP(status)",
    "paid_only": "SELECT count(*) AS paid_rows, sum(paid) AS settled FROM payments WHERE payment_status = 'PAID'",
    "category_semi": f"SELECT count(*) AS claims, sum(claimed) AS claimed, 100.0::DOUBLE * CAST(sum(claimed) AS DOUBLE) / (SELECT CAST(all_claimed AS DOUBLE) FROM totals) AS share_pct FROM claims WHERE diagnosis_id IN (SELECT diagnosis_id FROM diagnoses WHERE category = '{LEADING}')",
    "settled_nested_semi": f"SELECT count(*) AS paid_rows, sum(paid) AS settled FROM payments WHERE payment_status = 'PAID' AND claim_id IN (SELECT claim_id FROM claims WHERE diagnosis_id IN (SELECT diagnosis_id FROM diagnoses WHERE category = '{LEADING}'))",
    "procedure_rollup": f"SELECT CASE WHEN grouping(procedure_name) = 1 THEN '>> ALL' ELSE procedure_name END AS procedure_name, count(*) AS claims, sum(claimed) AS total_claimed {_D} WHERE EXISTS (SELECT 1 FROM diagnoses x WHERE x.diagnosis_id = claims.diagnosis_id AND x.category = '{HEAVY}') AND procedure_name IN ('red widget', 'small ring') GROUP BY ROLLUP(procedure_name)",
    "payment_counts": "SELECT count(*) AS n_rows, count(DISTINCT claim_id) AS distinct_claims, max(n) AS most FROM (SELECT claim_id, count(*) AS n FROM payments GROUP BY claim_id)",
    "join_reconciliation": "SELECT (SELECT sum(paid) FROM payments WHERE payment_status = 'PAID') AS standalone_paid, (SELECT count(*) FROM payments) AS payment_rows, (SELECT sum(paid) FROM payments WHERE payment_status = 'PAID' AND claim_id IN (SELECT claim_id FROM claims)) AS matched_paid, (SELECT count(*) FROM payments WHERE claim_id IN (SELECT claim_id FROM claims)) AS matched_rows",
    "hospital_spend": f"SELECT *, {_share('total_claimed', 'pct_of_total')} FROM (SELECT hospital_id, hospital_name, hospital_type, network_status, count(*) AS claims, sum(claimed) AS total_claimed, {_mean('claimed', 'avg_claim')} FROM claims JOIN hospitals USING (hospital_id) GROUP BY ALL) ORDER BY total_claimed DESC, hospital_id LIMIT 10",
    "hospital_context": f"SELECT sum(claimed) AS grand_total, count(DISTINCT hospital_id) AS hospitals, {_mean('claimed', 'avg_claim')}, {_R0('CAST(count(*) AS DOUBLE) / count(DISTINCT hospital_id)')} AS claims_per_hospital FROM claims",
    "hospital_report": f"SELECT *, {_share('total_claimed', 'pct_of_total')} FROM (SELECT hospital_id, hospital_name, hospital_type, network_status, count(*) AS claims, sum(claimed) AS total_claimed, {_mean('claimed', 'avg_claim')}, {_R0('median(CAST(claimed AS DOUBLE))', 2)} AS median_claim, sum(approved) AS total_approved, sum(paid_settled) AS paid_settled, {_percent('approved', 'claimed', 'approval_pct')}, {_percent('paid_settled', 'approved', 'settlement_pct')} FROM claims JOIN hospitals USING (hospital_id) LEFT JOIN paid_by_claim USING (claim_id) GROUP BY ALL) ORDER BY total_claimed DESC, hospital_id LIMIT 15",
    "hospital_dispersion": f", {_PER} SELECT min(total_claimed) AS min_total, max(total_claimed) AS max_total, {_R0('avg(CAST(total_claimed AS DOUBLE))')} AS avg_total, {_R0('stddev_samp(CAST(total_claimed AS DOUBLE))')} AS sd_total, {_R0('max(CAST(total_claimed AS DOUBLE)) / avg(CAST(total_claimed AS DOUBLE))', 2)} AS max_vs_avg, {_R0('min(avg_claim)')} AS min_avg, {_R0('max(avg_claim)')} AS max_avg, {_R0('avg(avg_claim)')} AS mean_avg FROM per",
    "outlier_count": f", {_PER} SELECT count(*) FILTER (WHERE avg_claim > m + 2 * s) AS above, {_R0('max(m)')} AS mean_avg, {_R0('max(m + 2 * s)')} AS threshold FROM per, (SELECT avg(avg_claim) AS m, stddev_samp(avg_claim) AS s FROM per)",
    "network_comparison": f"SELECT *, {_share('total_claimed', 'pct_of_total')} FROM (SELECT network_status, count(DISTINCT hospital_id) AS hospitals, count(*) AS claims, sum(claimed) AS total_claimed, {_mean('claimed', 'avg_claim')}, sum(approved) AS total_approved, {_percent('approved', 'claimed', 'approval_pct')}, {_percent('paid_settled', 'approved', 'settlement_pct')} FROM claims JOIN hospitals USING (hospital_id) LEFT JOIN paid_by_claim USING (claim_id) GROUP BY network_status)",
    "type_comparison": f"SELECT *, {_share('total_claimed', 'pct_of_total')} FROM (SELECT hospital_type, count(DISTINCT hospital_id) AS hospitals, count(*) AS claims, sum(claimed) AS total_claimed, {_mean('claimed', 'avg_claim')}, {_percent('approved', 'claimed', 'approval_pct')} FROM claims JOIN hospitals USING (hospital_id) GROUP BY hospital_type)",
    "top_hospital_diseases": f", {_PER} SELECT disease, category, count(*) AS claims, sum(claimed) AS total_claimed, {_mean('claimed', 'avg_claim')} {_D} WHERE hospital_id = {_TOP} GROUP BY disease, category ORDER BY total_claimed DESC, disease, category LIMIT 6",
    "case_mix": f", {_PER}, f AS (SELECT hospital_id, CASE WHEN avg_claim > (SELECT avg(avg_claim) + 2 * stddev_samp(avg_claim) FROM per) THEN 'outlier' ELSE 'rest' END AS grp FROM per) SELECT grp, count(*) AS claims, 100.0::DOUBLE * count(*) FILTER (WHERE category = '{LEADING}') / count(*) AS claim_share_pct, 100.0::DOUBLE * CAST(sum(claimed) FILTER (WHERE category = '{LEADING}') AS DOUBLE) / CAST(sum(claimed) AS DOUBLE) AS spend_share_pct, {_mean('claimed', 'avg_claim')} {_D} JOIN f USING (hospital_id) GROUP BY grp",
    "hospital_total_check": f", {_PER} SELECT sum(total_claimed) AS sum_of_totals FROM per",
    "top_hospital_check": f", {_PER}, mine AS (SELECT * FROM claims WHERE hospital_id = {_TOP}), x AS (SELECT count(*) AS claims, sum(claimed) AS total_claimed, {_mean('claimed', 'avg_claim')}, sum(approved) AS total_approved FROM mine), y AS (SELECT count(*) AS paid_rows, sum(paid) AS paid_settled FROM payments WHERE payment_status = 'PAID' AND claim_id IN (SELECT claim_id FROM mine)) SELECT x.*, y.*, 100.0::DOUBLE * CAST(total_claimed AS DOUBLE) / CAST(all_claimed AS DOUBLE) AS share_pct FROM x, y, totals",
    "network_union": "SELECT 'IN_NETWORK' AS net, count(*) AS claims, sum(claimed) AS total_claimed FROM claims WHERE hospital_id IN (SELECT hospital_id FROM hospitals WHERE network_status = 'IN_NETWORK') UNION ALL SELECT 'OUT_OF_NETWORK', count(*), sum(claimed) FROM claims WHERE hospital_id IN (SELECT hospital_id FROM hospitals WHERE network_status = 'OUT_OF_NETWORK')",
}
QUERIES = {f"a5_{name}": globals()[name] for name in _BODY}
ORACLE = {f"a5_{name}": f"WITH {CTES}{'' if sql.startswith(',') else ' '}{sql}" for name, sql in _BODY.items()}
