"""Scalar functions and set operations, each on columns of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import strings, times
from tessera.functions.numbers import bin_of, half_up, parse_decimal
from tessera.functions.records import whole_years
from tessera.operators import aggregates, windows
from tessera.sources.tables import table


def strings_regex(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = F.col("c_name")
    return c.select(
        "c_custkey", strings.full_match(n, "Customer#[0-9]{9}").alias("full"), n.rlike("#0*7").alias("part"), strings.group(n, "#0*([0-9]+)$", 1).alias("digits"), strings.group(n, "(zzz)", 1).alias("none"),
        F.regexp_count(n, F.lit("0")).alias("zeros"), F.regexp_instr(n, F.lit("[1-9]")).alias("first_digit"), F.regexp_replace(n, "[#0]+", "_").alias("replaced"), F.split_part(n, F.lit("#"), F.lit(2)).alias("tail"),
        F.regexp_substr(n, F.lit("(?<=#)0+")).alias("look"), n.contains("##").alias("has"), F.instr(n, "#").alias("at"),
    )


def strings_cut(spark, sf_dir):
    n = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", strings.cut(n, F.lit(-1), F.lit(4)).alias("before"), strings.cut(n, F.lit(3), F.lit(100)).alias("past"), F.left(n, F.lit(3)).alias("l"), F.right(n, F.lit(2)).alias("r"), strings.strip_set(n, "N0123456789").alias("both"),
        strings.strip_set(n, "NAT", "LEADING").alias("lead"), F.upper(n).alias("up"), F.lower(n).alias("low"), F.initcap(F.lower(n)).alias("cap"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("padded"), F.concat(n, F.lit("-"), n).alias("twice"),
        strings.visible(F.concat(n, F.lit("\t|\n"))).alias("shown"), strings.is_ascii(F.concat(n, F.lit("é"))).alias("ascii"), F.octet_length(F.concat(n, F.lit("é"))).alias("octets"),
    )


def digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.char_length("text").alias("chars"), F.octet_length("text").alias("octets"))


def running_offsets(spark, sf_dir):
    """Where each ;-separated part of a text starts; inside the row, no window over exploded rows."""
    t = F.concat_ws(";", "p_name", "p_brand", "p_type")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split(t, ";").alias("x"))
    start = F.transform("x", lambda s, i: F.struct((i + 1).alias("n"), s.alias("part"), (F.aggregate(F.slice("x", 1, i), F.lit(1), lambda a, y: a + F.char_length(y) + 1)).alias("start_pos")))
    return parts.select("p_partkey", F.inline(start))


def times_zones(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    day = times.business_day(F.col("ts"), "Asia/Kolkata")
    lo, hi = times.day_window(day, "Asia/Kolkata")
    out = e.select("event_id", day.alias("day"), F.date_format(lo, "yyyy-MM-dd HH:mm").alias("lo"), F.date_format(hi, "yyyy-MM-dd HH:mm").alias("hi"), ((F.col("ts") >= lo) & (F.col("ts") < hi)).alias("inside"))
    return out


def times_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    made = times.from_parts(F.year(d), F.month(d), F.col("o_orderkey").cast("int") % 33, F.col("o_custkey").cast("int") % 14, F.lit(30), F.lit(0).cast("decimal(16,6)"), F.col("o_custkey") % 2 == 0)
    return o.select(
        "o_orderkey", F.date_format(made, "yyyy-MM-dd HH:mm").alias("made"), F.last_day(d).alias("last"), F.date_format(d, "MM-dd").alias("md"), F.add_months(d, 216).alias("later"), F.datediff(F.lit("2001-01-01").cast("date"), d).cast("long").alias("days"),
        whole_years(d, F.lit("2004-02-28").cast("date")).cast("long").alias("years"), F.date_format(F.timestamp_millis(F.col("o_orderkey") * 1000003), "yyyy-MM-dd HH:mm:ss.SSS").alias("epoch"),
        times.offset_minutes(F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "+05:30").otherwise("-0245")).cast("long").alias("east"), times.object_key("orders", times.previous_hour(F.col("o_orderdate").cast("timestamp"))).alias("object_key"),
    )


def numbers_parse(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 7 == 0, "1e3").when(F.col("o_orderkey") % 7 == 1, "12,50").when(F.col("o_orderkey") % 7 == 2, " 7.25 ").when(F.col("o_orderkey") % 7 == 3, "-.5").when(F.col("o_orderkey") % 7 == 4, "").when(F.col("o_orderkey") % 7 == 5, "1O0").otherwise("+3.")
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_decimal(text).alias("number"))


def arrays(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    a = F.split(F.concat_ws(",", "c_mktsegment", F.lit("x"), (F.col("c_custkey") % 3).cast("string"), F.lit("x")), ",")
    codes = F.array_compact(F.array(F.when(F.col("c_custkey") % 2 == 0, "A"), F.when(F.col("c_custkey") % 3 == 0, "B")))
    return c.select("c_custkey", F.array_join(F.array_distinct(a), "|").alias("unique"), F.size(a).cast("long").alias("n"), F.element_at(a, 3).alias("third"), F.array_contains(a, "1").alias("has"), F.nullif(F.array_join(codes, ";"), F.lit("")).alias("codes"), F.array_join(F.concat(a, codes), "|").alias("both"), F.size(F.from_json(F.lit('["p","q"]'), "array<string>")).cast("long").alias("parsed"))


def histogram(spark, sf_dir):
    """Twenty bins of equal width over the whole range."""
    p = table(spark, sf_dir, "part")
    ends = p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return p.join(F.broadcast(ends)).groupBy(bin_of("p_retailprice", "lo", "hi", 20).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def correlation(spark, sf_dir):
    x = aggregates.correlations(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"])
    return x.select("a", "b", F.round("r", 6).alias("r"))


def value_counts(spark, sf_dir):
    return aggregates.value_counts(table(spark, sf_dir, "customer"), "c_mktsegment").orderBy("c_mktsegment")


def imputed(spark, sf_dir):
    """Median for missing numbers, most frequent value for missing text."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 8 != 0, F.col("c_mktsegment")).alias("segment"))
    fill = c.agg(F.median("balance").alias("mid")).join(F.broadcast(aggregates.mode(c, "segment")))
    return c.join(F.broadcast(fill)).select("c_custkey", F.round(F.coalesce("balance", "mid"), 4).alias("balance"), F.coalesce("segment", "mode").alias("segment"))


def encoded(spark, sf_dir):
    code = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2)
    return table(spark, sf_dir, "orders").withColumn("status", code.cast("int")).drop("o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority")


def quartiles(spark, sf_dir):
    q = ", ".join(f"percentile_disc({p}) WITHIN GROUP (ORDER BY l_quantity) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95, 0.99))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.expr(x.split(" AS ")[0]).alias(x.split(" AS ")[1]) for x in q.split(", ")])


def pivoted(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("s"), F.col("o_orderstatus")).alias("field"), F.col("o_orderkey").alias("value"))
    return aggregates.pivot_fields(x, ["o_custkey"], "field", ["sF", "sO", "sP"], "value")


def unpivoted(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance")).unpivot(["s_suppkey"], ["nation", "balance"], "field", "value")


def set_differences(spark, sf_dir):
    """Both ways, as sets and as multisets."""
    a = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"))
    b = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select((F.col("o_custkey") % 60).alias("k"))
    one = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("k").alias("total"))
    return one(a.subtract(b), "a-b").unionByName(one(b.subtract(a), "b-a")).unionByName(one(a.exceptAll(b), "all a-b")).unionByName(one(b.exceptAll(a), "all b-a"))


def first_per_key(spark, sf_dir):
    return windows.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


def grid_completeness(spark, sf_dir):
    """Every region with every segment, zero where there is none; the grid is two short lists."""
    r = table(spark, sf_dir, "region").select("r_regionkey")
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"))
    grid = r.join(F.broadcast(c.select("c_mktsegment").distinct()))
    return grid.join(c, (F.col("r_regionkey") == F.col("n_regionkey")) & (grid["c_mktsegment"] == c["c_mktsegment"]), "left").select("r_regionkey", grid["c_mktsegment"], F.coalesce("n", F.lit(0)).alias("n"))


def first_matching_shape(spark, sf_dir):
    """The first of several ordered patterns that a text matches: one expression, not a join of texts with patterns."""
    shapes = [("promo", "^PROMO"), ("short", "^.{5}$"), ("std", "^STAN"), ("other", ".")]
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(*[F.when(F.col("p_type").rlike(p), n) for n, p in shapes]).alias("shape"))


def seeded_rows(spark, sf_dir):
    """Deterministic rows from numbers alone: choices by modulo, keys by counting."""
    n = F.col("id")
    return spark.range(60).select((n + 1001).alias("employee_id"), (n * 7 % 8).alias("department"), F.concat(F.lit("E"), F.lpad(n.cast("string"), 4, "0")).alias("code"), F.floor(n / 7).alias("team"), (n % 3 != 0).alias("active"))


def numeric_rounding(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", half_up(F.col("l_extendedprice") / 7, 2).alias("seventh"), half_up(F.col("l_quantity") / 2, 0).alias("half"))


def table_checksum(spark, sf_dir):
    return aggregates.checksum(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


_C = "(SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 8 <> 0 THEN c_mktsegment END AS segment FROM customer)"
QUERIES = {f"fn_{f.__name__}": f for f in (strings_regex, strings_cut, digests, running_offsets, times_zones, times_parts, numbers_parse, arrays, histogram, correlation, value_counts, imputed, encoded, quartiles, pivoted, unpivoted, set_differences, first_per_key, grid_completeness, first_matching_shape, seeded_rows, numeric_rounding, table_checksum)}
_HEX = lambda x: f"CAST(('0x' || substr({x}, 1, 15))::BIGINT AS HUGEINT)"
ORACLE = {f"fn_{k}": v for k, v in {
    "strings_regex": r"SELECT c_custkey, regexp_full_match(c_name, 'Customer#[0-9]{9}') AS full, regexp_matches(c_name, '#0*7') AS part, regexp_extract(c_name, '#0*([0-9]+)$', 1) AS digits, CAST(NULL AS VARCHAR) AS none, CAST(len(regexp_extract_all(c_name, '0')) AS INT) AS zeros, CASE WHEN regexp_matches(c_name, '[1-9]') THEN CAST(length(regexp_extract(c_name, '^[^1-9]*')) + 1 AS INT) ELSE 0 END AS first_digit, regexp_replace(c_name, '[#0]+', '_', 'g') AS replaced, split_part(c_name, '#', 2) AS tail, nullif(regexp_extract(c_name, '#(0+)', 1), '') AS look, contains(c_name, '##') AS has, CAST(instr(c_name, '#') AS INT) AS at FROM customer",
    "strings_cut": r"SELECT n_nationkey, n_name[1:2] AS before, substr(n_name, 3) AS past, left(n_name, 3) AS l, right(n_name, 2) AS r, trim(n_name, 'N0123456789') AS both, ltrim(n_name, 'NAT') AS lead, upper(n_name) AS up, lower(n_name) AS low, upper(n_name[1]) || lower(n_name[2:]) AS cap, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS padded, n_name || '-' || n_name AS twice, n_name || '\t|\n' AS shown, FALSE AS ascii, CAST(strlen(n_name) + 2 AS INT) AS octets FROM nation",
    "digests": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, CAST(length(text) AS INT) AS chars, CAST(strlen(text) AS INT) AS octets FROM documents",
    "running_offsets": "WITH x AS (SELECT p_partkey, [p_name, p_brand, p_type] AS x FROM part) SELECT p_partkey, CAST(i AS INT) AS n, x[i] AS part, CAST(1 + CASE i WHEN 1 THEN 0 WHEN 2 THEN length(x[1]) + 1 ELSE length(x[1]) + length(x[2]) + 2 END AS INT) AS start_pos FROM x, range(1, 4) t(i)",
    "times_zones": "SELECT event_id, CAST(ts + INTERVAL '5 hours 30 minutes' AS DATE) AS day, strftime(date_trunc('day', ts + INTERVAL '5 hours 30 minutes') - INTERVAL '5 hours 30 minutes', '%Y-%m-%d %H:%M') AS lo, strftime(date_trunc('day', ts + INTERVAL '5 hours 30 minutes') + INTERVAL '18 hours 30 minutes', '%Y-%m-%d %H:%M') AS hi, TRUE AS inside FROM events",
    "times_parts": "SELECT o_orderkey, CASE WHEN o_orderkey % 33 BETWEEN 1 AND day(last_day(o_orderdate)) AND o_custkey % 14 BETWEEN 1 AND 12 THEN strftime(make_timestamp(year(o_orderdate), month(o_orderdate), o_orderkey % 33, o_custkey % 14 % 12 + CASE WHEN o_custkey % 2 = 0 THEN 12 ELSE 0 END, 30, 0), '%Y-%m-%d %H:%M') END AS made, last_day(o_orderdate) AS last, strftime(o_orderdate, '%m-%d') AS md, CAST(CAST(o_orderdate AS DATE) + INTERVAL 216 MONTH AS DATE) AS later, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-01-01') AS days, CAST(year(DATE '2004-02-28') - year(o_orderdate) - CASE WHEN (2, 28) < (month(o_orderdate), day(o_orderdate)) THEN 1 ELSE 0 END AS BIGINT) AS years, strftime(epoch_ms(o_orderkey * 1000003), '%Y-%m-%d %H:%M:%S.%g') AS epoch, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 330 ELSE -165 END AS BIGINT) AS east, 'orders' || strftime(o_orderdate - INTERVAL 1 HOUR, '/year=%Y/month=%m/day=%d/orders_%Y%m%d_%H.csv') AS object_key FROM orders",
    "numbers_parse": "SELECT o_orderkey, CAST(CASE o_orderkey % 7 WHEN 2 THEN 7.25 WHEN 3 THEN -0.5 WHEN 6 THEN 3 END AS DECIMAL(18,4)) AS number FROM orders",
    "arrays": "WITH x AS (SELECT c_custkey, [c_mktsegment, 'x', CAST(c_custkey % 3 AS VARCHAR), 'x'] AS a, list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'A' END, CASE WHEN c_custkey % 3 = 0 THEN 'B' END], lambda v: v IS NOT NULL) AS c FROM customer) SELECT c_custkey, array_to_string(a[1:3], '|') AS unique, len(a) AS n, a[3] AS third, list_contains(a, '1') AS has, nullif(array_to_string(c, ';'), '') AS codes, array_to_string(list_concat(a, c), '|') AS both, CAST(2 AS BIGINT) AS parsed FROM x",
    "histogram": "SELECT CAST(least(floor((p_retailprice - lo) / ((hi - lo) / 20)) + 1, 20) AS BIGINT) AS bin, count(*) AS n FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) GROUP BY 1",
    "correlation": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")),
    "value_counts": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
    "imputed": f"SELECT c_custkey, round(coalesce(balance, (SELECT median(balance) FROM {_C})), 4) AS balance, coalesce(segment, (SELECT segment FROM {_C} WHERE segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1)) AS segment FROM {_C}",
    "encoded": "SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS status FROM orders",
    "quartiles": "SELECT l_returnflag, " + ", ".join(f"quantile_disc(l_quantity, {p}) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM lineitem GROUP BY l_returnflag",
    "pivoted": "SELECT o_custkey, " + ", ".join(f"max(o_orderkey) FILTER (WHERE o_orderstatus = '{s}') AS s{s}" for s in "FOP") + " FROM orders GROUP BY o_custkey",
    "unpivoted": "SELECT s_suppkey, 'nation' AS field, CAST(s_nationkey AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier",
    "set_differences": "WITH a AS (SELECT o_custkey % 50 AS k FROM orders), b AS (SELECT o_custkey % 60 AS k FROM orders WHERE o_orderkey % 3 = 0) " + " UNION ALL ".join(f"SELECT '{n}' AS kind, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM ({q})" for n, q in (("a-b", "FROM a EXCEPT FROM b"), ("b-a", "FROM b EXCEPT FROM a"), ("all a-b", "FROM a EXCEPT ALL FROM b"), ("all b-a", "FROM b EXCEPT ALL FROM a"))),
    "first_per_key": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey",
    "grid_completeness": "SELECT r_regionkey, s.c_mktsegment, count(c_custkey) AS n FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN (customer JOIN nation ON c_nationkey = n_nationkey) ON n_regionkey = r_regionkey AND customer.c_mktsegment = s.c_mktsegment GROUP BY ALL",
    "first_matching_shape": "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^PROMO') THEN 'promo' WHEN regexp_matches(p_type, '^.{5}$') THEN 'short' WHEN regexp_matches(p_type, '^STAN') THEN 'std' ELSE 'other' END AS shape FROM part",
    "seeded_rows": "SELECT i + 1001 AS employee_id, i * 7 % 8 AS department, 'E' || lpad(CAST(i AS VARCHAR), 4, '0') AS code, i // 7 AS team, i % 3 <> 0 AS active FROM range(60) t(i)",
    "numeric_rounding": "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(CAST(l_extendedprice / 7 AS DECIMAL(38,10)), 2) AS DECIMAL(28,2)) AS seventh, CAST(round(CAST(l_quantity / 2 AS DECIMAL(38,10)), 0) AS DECIMAL(28,0)) AS half FROM lineitem",
    "table_checksum": f"SELECT count(*) || ':' || CAST(sum({_HEX('md5(concat_ws(chr(124), n_nationkey, n_name, n_regionkey))')}) AS VARCHAR) AS checksum FROM nation",
}.items()}
