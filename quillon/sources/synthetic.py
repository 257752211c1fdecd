"""Seeded trip and customer tables in which a row depends on its id alone.

Uniform numbers come from a hash of the id and a column salt, so any partitioning of the id range
gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: value domains and weights of the generated tables ---------------------------
ZONES = 265
DAYS = 180
FARE_SCALE, FARE_MIN = 15.0, 2.5
REVENUE_SCALE, REVENUE_MIN = 100.0, 20.0
PASSENGER_WEIGHTS = {1: 0.7, 2: 0.15, 3: 0.08, 4: 0.04, 5: 0.02, 6: 0.01}
REGION_WEIGHTS = {"North": 0.25, "South": 0.20, "East": 0.20, "West": 0.20, "Central": 0.15}
MAX_TENURE, LONG_TENURE = 72, 36
CHURN_SHARE, LONG_TENURE_CHURN_SHARE = 0.27, 0.15


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 12 hex digits of md5(salt, key)."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    return F.conv(F.left(digest, F.lit(12)), 16, 10).cast("double") / F.lit(float(1 << 48))


def uniform_int(key: Column, salt: str, low: int, high: int) -> Column:
    return (F.floor(uniform(key, salt) * (high - low + 1)) + low).cast("int")


def exponential(key: Column, salt: str, scale: float, minimum: float) -> Column:
    return F.round(-F.log(F.lit(1.0) - uniform(key, salt)) * scale + minimum, 2)


def weighted(key: Column, salt: str, weights: dict) -> Column:
    """A value picked with the given probabilities: the first whose running sum exceeds u."""
    u, upto, choice = uniform(key, salt), 0.0, None
    *firsts, last = weights
    for value in firsts:
        upto = round(upto + weights[value], 10)
        choice = (F if choice is None else choice).when(u < upto, F.lit(value))
    return choice.otherwise(F.lit(last))


def trip_columns(key: Column, end: Column) -> dict[str, Column]:
    seconds = F.floor(uniform(key, "pickup") * (DAYS * 86400 + 1)).cast("bigint")
    return {
        "pickup_date": F.timestamp_add("SECOND", seconds - DAYS * 86400, end),
        "location": uniform_int(key, "location", 1, ZONES),
        "fare": exponential(key, "fare", FARE_SCALE, FARE_MIN),
        "passengers": weighted(key, "passengers", PASSENGER_WEIGHTS),
    }


def customer_columns(key: Column) -> dict[str, Column]:
    tenure = uniform_int(key, "tenure", 1, MAX_TENURE)
    churn = (
        F.when(tenure > LONG_TENURE, uniform(key, "late churn") < LONG_TENURE_CHURN_SHARE)
        .otherwise(uniform(key, "churn") < CHURN_SHARE)
    )
    return {
        "region": weighted(key, "region", REGION_WEIGHTS),
        "tenure": tenure,
        "churn": churn.cast("int"),
        "revenue": exponential(key, "revenue", REVENUE_SCALE, REVENUE_MIN),
    }


def synthetic_trips(spark: SparkSession, rows: int, end: Column | None = None) -> DataFrame:
    """``rows`` trips over the 180 days before ``end`` (now, if not given)."""
    end = F.current_timestamp() if end is None else end
    ids = spark.range(1, rows + 1)
    return ids.select("id", *[c.alias(n) for n, c in trip_columns(F.col("id"), end).items()])


def synthetic_customers(spark: SparkSession, rows: int) -> DataFrame:
    ids = spark.range(1, rows + 1)
    return ids.select("id", *[c.alias(n) for n, c in customer_columns(F.col("id")).items()])
