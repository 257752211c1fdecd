"""Distances as columns, and the same ones as SQL functions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import constants as C


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2sq(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))
                           * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2sq(a, b))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    """1 - cosine similarity; NaN for a zero vector unless ``eps`` lifts the divisor."""
    divisor = norm(a) * norm(b) + F.lit(eps)
    return F.when(divisor == 0.0, F.lit(float("nan"))).otherwise(
        F.lit(1.0) - dot(a, b) / F.when(divisor != 0.0, divisor))


def neg_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


BUILDERS = {"l2": l2sq, "cosine": cosine, "dot": neg_dot, "manhattan": manhattan}


def distance(a: Column, b: Column, metric: str = "l2", eps: float = 0.0) -> Column:
    if metric not in BUILDERS:
        raise ValueError(f"Unknown distance metric: {metric}")
    return cosine(a, b, eps) if metric == "cosine" else BUILDERS[metric](a, b)


def known_metric(metric: Column) -> Column:
    """The metric itself, or ``l2`` for one nobody knows."""
    return F.when(metric.isin(C.METRICS), metric).otherwise(F.lit(C.DEFAULT_METRIC))


def rounded(value: Column, digits: int = 4) -> Column:
    """Rounded, with negative zero turned into zero."""
    near = F.round(value, digits)
    return F.when(near == 0.0, F.lit(0.0)).otherwise(near)


def mean_vectors(df: DataFrame, group: str, vector: str, out: str = "mean") -> DataFrame:
    """Element-wise mean per group with the member count.

    Each task sums its vectors per group; one row per group and task is shuffled. Null vectors are
    left out; vectors of different lengths in a group raise.
    """
    member = array_to_vector(F.col(vector).cast("array<double>"))
    means = df.filter(F.col(vector).isNotNull()).groupBy(group).agg(
        Summarizer.metrics("mean", "count").summary(member).alias("s"))
    return means.select(group, vector_to_array("s.mean").alias(out), F.col("s.count").alias("n"))


_PAIR = "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
_FOLD = "aggregate(zip_with(a, b, (x, y) -> {0}), 0D, (s, x) -> s + x)"
SQL_FUNCTIONS = {
    "l2sq": _PAIR + _FOLD.format("(x - y) * (x - y)"),
    "l2": _PAIR + "sqrt(" + _FOLD.format("(x - y) * (x - y)") + ")",
    "neg_dot": _PAIR + "-" + _FOLD.format("x * y"),
    "l1": _PAIR + _FOLD.format("abs(x - y)"),
    "cosine_dist": _PAIR + (
        "CASE WHEN exists(a, x -> x <> 0) AND exists(b, x -> x <> 0) THEN 1 - "
        + _FOLD.format("x * y")
        + " / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"
        " * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0) ELSE double('NaN') END"),
}


def register_sql_functions(spark: SparkSession) -> None:
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
