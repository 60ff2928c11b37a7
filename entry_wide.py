"""Wide, flat inputs derived from the normalised test tables (what the engine is meant to ingest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its customer and the customer's nation.

    The joins are left to AQE, which broadcasts a side only when its measured size is under the threshold and
    otherwise sort-merges (splitting a hot customer's partition when skewed).
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("transaction_id"),
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("customer_segment"),
            F.col("n_name").alias("customer_nation"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderpriority").alias("order_priority"),
            F.col("o_orderdate").alias("order_date"),
            F.col("o_totalprice").alias("total_amount"),
        )
    )


ORDERS_WIDE_SQL = """
SELECT o_orderkey AS transaction_id, c_custkey AS customer_id, c_name AS customer_name,
       c_mktsegment AS customer_segment, n_name AS customer_nation, o_orderstatus AS order_status,
       o_orderpriority AS order_priority, o_orderdate AS order_date, o_totalprice AS total_amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""


def sales_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with order, customer, nation and part attributes.

    The orders get their customers first, and the line items their few part columns, so that line items are never shuffled with
    the columns of orders and customers.
    """
    t = load_tables(spark, sf_dir, ("lineitem", "orders", "customer", "nation", "part"))
    orders = (
        t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return (
        t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            F.col("c_mktsegment").alias("customer_segment"),
            F.col("n_name").alias("customer_nation"),
            F.col("p_partkey").alias("product_id"),
            F.col("p_brand").alias("product_brand"),
            F.col("p_type").alias("product_type"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_discount").alias("discount_rate"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderpriority").alias("order_priority"),
            F.col("l_shipdate").alias("ship_date"),
            F.col("o_orderdate").alias("order_date"),
        )
    )


SALES_WIDE_SQL = """
SELECT o_orderkey * 10 + l_linenumber AS transaction_id, c_custkey AS customer_id, c_name AS customer_name,
       c_mktsegment AS customer_segment, n_name AS customer_nation, p_partkey AS product_id, p_brand AS product_brand,
       p_type AS product_type, l_quantity AS quantity, l_extendedprice AS amount, l_discount AS discount_rate,
       o_orderstatus AS order_status, o_orderpriority AS order_priority, l_shipdate AS ship_date,
       o_orderdate AS order_date
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
"""
