"""Retail star schema: ranks, neighbours, moving averages and summaries of sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up
from tessera.operators.ordered import global_lag, global_lead, global_moving_sum, global_rank
from tessera.operators.windows import ranked, top
from tessera.sources.tables import spread, table


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per sold line: sale_id, sale_date, customer_id, product_id, quantity, amount."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    amount = F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(18,4)"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sale_id"), F.to_date("o_orderdate").alias("sale_date"),
        F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("long").alias("quantity"),
        F.round(amount, 2).cast("decimal(18,2)").alias("amount"),
    )


SALES = """sales AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS sale_id, CAST(o_orderdate AS DATE) AS sale_date, o_custkey AS customer_id, l_partkey AS product_id,
         CAST(l_quantity AS BIGINT) AS quantity,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))), 2) AS DECIMAL(18,2)) AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BY_PRODUCT = f"""{SALES}, by_product AS (
  SELECT p_brand AS category, p_partkey AS product_id, p_name AS product_name, sum(amount) AS revenue
  FROM sales JOIN part ON product_id = p_partkey GROUP BY ALL)"""


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("category"), F.col("p_name").alias("product_name"))


def by_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales summed before the join, so that the product columns aren't shuffled with every line."""
    sums = sales(spark, sf_dir).groupBy("product_id").agg(F.sum("amount").cast("decimal(38,2)").alias("revenue"))
    return sums.join(_products(spark, sf_dir), "product_id").select("category", "product_id", "product_name", "revenue")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), "city")


def _by_revenue(how: str, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        order = [F.col("revenue").desc()] + ([F.col("product_id")] if how == "row_number" else [])
        return ranked(by_product(spark, sf_dir), ["category"], order, name, how)

    return run


def top3_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(by_product(spark, sf_dir), ["category"], [F.col("revenue").desc()], 3, "revenue_rank")


def previous_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir).select("sale_id", "sale_date", "amount")
    return global_lag(s, "amount", ["sale_date", "sale_id"], "previous_amount")


def next_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir).select("sale_id", "sale_date", "amount")
    return global_lead(s, "amount", ["sale_date", "sale_id"], "next_amount")


def sale_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_rank(sales(spark, sf_dir).select("sale_id", "amount"), "amount", "sale_rank")


def category_sale_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir).join(_products(spark, sf_dir), "product_id").select("sale_id", "category", "product_name", "amount")
    return global_rank(s, "amount", "category_rank", ["category"])


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir).select("sale_id", "sale_date", "amount")
    out = global_moving_sum(s, "amount", ["sale_date", "sale_id"], 2, "_sum", "_n")
    return out.select("sale_id", "sale_date", "amount", half_up(F.col("_sum").cast("double") / F.col("_n"), 2).alias("moving_average"))


def _totals() -> list:
    return [F.count("*").alias("orders"), F.sum("quantity").alias("quantity"), F.sum("amount").cast("decimal(38,2)").alias("total")]


def sales_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir).join(_customers(spark, sf_dir), "customer_id").join(_products(spark, sf_dir), "product_id")
    return s.select("sale_id", "customer_name", "city", "category", "product_name", "sale_date", "quantity", "amount")


def customer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = sales(spark, sf_dir).groupBy("customer_id").agg(*_totals())
    return sums.join(_customers(spark, sf_dir), "customer_id").select("customer_name", "city", "orders", "quantity", "total")


def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).join(_products(spark, sf_dir), "product_id").groupBy("category").agg(*_totals())


def customer_category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sales(spark, sf_dir).join(_products(spark, sf_dir).drop("product_name"), "product_id").groupBy("customer_id", "category").agg(*_totals())
    return s.join(_customers(spark, sf_dir).drop("city"), "customer_id").select("customer_name", "category", "orders", "quantity", "total")


def best_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = sales(spark, sf_dir).groupBy("customer_id").agg(F.sum("amount").cast("decimal(38,2)").alias("total"))
    return top(sums.join(_customers(spark, sf_dir), "customer_id").select("city", "customer_name", "total"), ["city"], [F.col("total").desc()], 1, "sales_rank")


_SALE_ROW = "SELECT sale_id, sale_date, amount"
_SUMS = "count(*) AS orders, CAST(sum(quantity) AS BIGINT) AS quantity, sum(amount) AS total"
_CUSTOMER = "JOIN customer ON customer_id = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _rank_sql(how: str, name: str, tie: str = "") -> str:
    return f"WITH {BY_PRODUCT} SELECT *, {how}() OVER (PARTITION BY category ORDER BY revenue DESC{tie}) AS {name} FROM by_product"


QUERIES = {
    "a2_top3_products": top3_products,
    "a2_previous_sale": previous_sale,
    "a2_next_sale": next_sale,
    "a2_sale_rank": sale_rank,
    "a2_category_sale_rank": category_sale_rank,
    "a2_product_rank": _by_revenue("rank", "category_rank"),
    "a2_moving_average": moving_average,
    "a2_product_row_number": _by_revenue("row_number", "place"),
    "a2_product_dense_rank": _by_revenue("dense_rank", "place"),
    "a2_sales_report": sales_report,
    "a2_customer_summary": customer_summary,
    "a2_category_summary": category_summary,
    "a2_customer_category_summary": customer_category_summary,
    "a2_best_customer_per_city": best_customers,
}
ORACLE = {
    "a2_top3_products": _rank_sql("rank", "revenue_rank") + " QUALIFY revenue_rank <= 3",
    "a2_previous_sale": f"WITH {SALES} {_SALE_ROW}, lag(amount) OVER (ORDER BY sale_date, sale_id, amount) AS previous_amount FROM sales",
    "a2_next_sale": f"WITH {SALES} {_SALE_ROW}, lead(amount) OVER (ORDER BY sale_date, sale_id, amount) AS next_amount FROM sales",
    "a2_sale_rank": f"WITH {SALES} SELECT sale_id, amount, rank() OVER (ORDER BY amount DESC) AS sale_rank FROM sales",
    "a2_category_sale_rank": f"WITH {SALES} SELECT sale_id, p_brand AS category, p_name AS product_name, amount, rank() OVER (PARTITION BY p_brand ORDER BY amount DESC) AS category_rank FROM sales JOIN part ON product_id = p_partkey",
    "a2_product_rank": _rank_sql("rank", "category_rank"),
    "a2_moving_average": f"""WITH {SALES} {_SALE_ROW}, CAST(round(CAST(CAST(sum(amount) OVER w AS DOUBLE) / count(*) OVER w AS DECIMAL(38,10)), 2) AS DECIMAL(28,2)) AS moving_average
        FROM sales WINDOW w AS (ORDER BY sale_date, sale_id, amount ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "a2_product_row_number": _rank_sql("row_number", "place", ", product_id"),
    "a2_product_dense_rank": _rank_sql("dense_rank", "place"),
    "a2_sales_report": f"WITH {SALES} SELECT sale_id, c_name AS customer_name, n_name AS city, p_brand AS category, p_name AS product_name, sale_date, quantity, amount FROM sales {_CUSTOMER} JOIN part ON product_id = p_partkey",
    "a2_customer_summary": f"WITH {SALES} SELECT c_name AS customer_name, n_name AS city, {_SUMS} FROM sales {_CUSTOMER} GROUP BY c_custkey, c_name, n_name",
    "a2_category_summary": f"WITH {SALES} SELECT p_brand AS category, {_SUMS} FROM sales JOIN part ON product_id = p_partkey GROUP BY p_brand",
    "a2_customer_category_summary": f"WITH {SALES} SELECT c_name AS customer_name, p_brand AS category, {_SUMS} FROM sales {_CUSTOMER} JOIN part ON product_id = p_partkey GROUP BY c_custkey, c_name, p_brand",
    "a2_best_customer_per_city": f"""WITH {SALES}, t AS (SELECT n_name AS city, c_name AS customer_name, sum(amount) AS total FROM sales {_CUSTOMER} GROUP BY n_name, c_custkey, c_name)
        SELECT *, rank() OVER (PARTITION BY city ORDER BY total DESC) AS sales_rank FROM t QUALIFY sales_rank = 1""",
}
