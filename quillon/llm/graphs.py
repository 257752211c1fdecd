"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import erase, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
        F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("of")).agg(
        F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b); the component is its smallest id.

    Every round links each node's larger neighbours to its smallest one, then each node's smaller
    neighbours among themselves. No neighbour list is built: a round is an aggregate per node and a
    join back, and a hot node's rows can be split. Loops are ignored.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"),
                                                F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = _both(now)
        large = (both.join(_least(both), F.col("u") == F.col("of"))
                 .filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .distinct())
        large = written(large, "links")
        down = large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
        small = (large.join(down, F.col("a") == F.col("of"))
                 .select(F.explode(F.array(
                     F.struct(F.col("a").alias("u"), "m"), F.struct(F.col("b").alias("u"), "m")))
                     .alias("e"))
                 .filter("e.u <> e.m").select(F.col("e.u").alias("a"), F.col("e.m").alias("b"))
                 .distinct())
        after = written(small, "links")
        stars = after.groupBy("a").count().agg(F.max("count")).first()[0]
        centres = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        done = stars in (None, 1) and not centres.take(1)
        erase(now, large)
        now = after
        if done:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
