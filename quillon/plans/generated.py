"""Generated columns keyed by the ids of the given tables: one trip per order, one customer each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources import synthetic, tables


def synthetic_trips(spark: SparkSession, folder: str) -> DataFrame:
    """A generated trip for every order key, placed in the 180 days before the order."""
    made = synthetic.trip_columns(F.col("o_orderkey"), F.col("o_orderdate"))
    made["pickup_date"] = F.date_format(made["pickup_date"], "yyyy-MM-dd HH:mm:ss")
    return tables.read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), *[c.alias(n) for n, c in made.items()])


def synthetic_customers(spark: SparkSession, folder: str) -> DataFrame:
    made = synthetic.customer_columns(F.col("c_custkey"))
    return tables.read(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), *[c.alias(n) for n, c in made.items()])
