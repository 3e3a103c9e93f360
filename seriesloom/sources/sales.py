"""Sales observations out of the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Declared columns of the tables read here: no job is spent on reading file footers.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def sales_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: ``(rid, state, date, total)`` with the nation as the series key.

    Joins carry no hint: a dimension is broadcast only while its measured size is below the
    session's threshold. Beyond it both sides are shuffled on the customer key, and a customer
    with a large share of all orders is split by the adaptive skew join (the customer side
    has one row per key, so repeating it is cheap).
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    homes = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return orders.join(homes, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("rid"),
        F.col("n_name").alias("state"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("total"),
    )


def customer_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same observations with one series per customer: many series, no join."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rid"),
        F.col("o_custkey").cast("string").alias("state"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("total"),
    )


def customer_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(state, date, customer)`` per customer and day with an order, joined like ``sales_observations``.

    Orders of a day are made one row in every task before the shuffle, so a customer with a large share of all orders
    brings as many rows to the join as there are days.
    """
    orders, customer, nation = (table(spark, sf_dir, name) for name in ("orders", "customer", "nation"))
    homes = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    days = orders.select(F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("date")).distinct()
    return days.join(homes, F.col("customer") == F.col("c_custkey")).select(F.col("n_name").alias("state"), "date", "customer")


def untidy_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as the text a hand-kept file would hold.

    Dates come in three layouts or as words, totals as grouped money or as a missing mark;
    the layout is picked per row by the order key, and no row is left out.
    """
    sales = sales_observations(spark, sf_dir)
    rid = F.col("rid")
    date = (
        F.when(rid % 101 == 0, F.lit("not a date"))
        .when(rid % 3 == 0, F.date_format("date", "M/d/yyyy"))
        .when(rid % 3 == 1, F.date_format("date", "dd-MM-yyyy"))
        .otherwise(F.date_format("date", "yyyy-MM-dd"))
    )
    total = F.when(rid % 97 == 0, F.lit("n/a")).otherwise(
        F.concat(F.lit(" "), F.format_number("total", 2), F.lit(" "))
    )
    return sales.select("rid", "state", date.alias("date"), total.alias("total"))
