"""The five named sample questions, written out as plain DataFrame queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import month_key, tenure_bucket
from quillon.plans.questions import MICRO, micro
from quillon.sources.tables import customers, trips


def _ranked(df: DataFrame, *order) -> DataFrame:
    """Rank of an already aggregated, small result."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_locations(spark: SparkSession, folder: str) -> DataFrame:
    totals = trips(spark, folder).groupBy("location").agg(F.sum(micro(F.col("fare"))).alias("exact"))
    order = [F.desc("exact"), F.asc("location")]
    return _ranked(totals.orderBy(*order).limit(5), *order).select(
        "location", F.round(F.col("exact").cast("double") / float(MICRO), 2).alias("total_fare"),
        "rank")


def avg_fare_by_passengers(spark: SparkSession, folder: str) -> DataFrame:
    means = trips(spark, folder).groupBy("passengers").agg(
        F.round(F.avg("fare"), 4).alias("avg_fare"))
    return _ranked(means, "passengers")


def churn_by_region(spark: SparkSession, folder: str) -> DataFrame:
    rates = customers(spark, folder).groupBy("region").agg(F.avg("churn").alias("exact"))
    return _ranked(rates, F.desc("exact"), "region").select(
        "region", F.round(F.col("exact") * 100, 4).alias("churn_rate"), "rank")


def tenure_buckets(spark: SparkSession, folder: str) -> DataFrame:
    buckets = (
        customers(spark, folder)
        .withColumn("tenure_bucket", tenure_bucket(F.col("tenure")))
        .groupBy("tenure_bucket")
        .agg(F.round(F.avg("revenue"), 4).alias("avg_revenue"),
             F.round(F.avg("churn") * 100, 4).alias("churn_rate"))
    )
    return _ranked(buckets, "tenure_bucket")


def trips_per_month(spark: SparkSession, folder: str) -> DataFrame:
    months = (trips(spark, folder).withColumn("month", month_key(F.col("pickup_date")))
              .groupBy("month").agg(F.count("*").alias("trip_count")))
    return _ranked(months, "month")
