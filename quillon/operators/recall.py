"""How much of the exact answer an approximate search found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_per_query(exact: DataFrame, approximate: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """``(*tags, query_id, recall)``: distinct exact ids found, over distinct exact ids."""
    keys = [*tags, "query_id", "vec_id"]
    wanted = exact.select(*keys).distinct()
    got = approximate.select(*keys).distinct().withColumn("hit", F.lit(1))
    return (wanted.join(got, keys, "left").groupBy(*tags, "query_id")
            .agg((F.count("hit") / F.count("*")).alias("recall")))


def recall_table(exact: DataFrame, approximate: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """Mean and worst recall per tag combination over all queries."""
    return recall_per_query(exact, approximate, tags).groupBy(*tags).agg(
        F.round(F.avg("recall"), 4).alias("recall"), F.min("recall").alias("worst"),
        F.count("*").alias("queries"))
