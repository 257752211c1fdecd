"""Gapless numbers within groups without one task per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 20_000


def numbered(df: DataFrame, group: str, order: list[Column], spread: Column, name: str,
             rows: int) -> DataFrame:
    """``df`` with a gapless number from 0 within each ``group``.

    Rows are ordered by ``spread`` (a number in 0..1, such as a hash or a priority plus a hash) in
    slices of about ``SLICE_ROWS`` rows, and by ``order`` within a slice. A slice is one window
    group; the slices' offsets come from an aggregate of one row per group and slice. ``df`` is read
    twice and must be fixed (written).
    """
    slices = max(1, math.ceil(rows / SLICE_ROWS))
    cut = df.withColumn("_slice", F.floor(spread * slices).cast("long"))
    counts = cut.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*order)) - 1
    return cut.withColumn("_within", within).join(before, [group, "_slice"]).withColumn(
        name, (F.col("_before") + F.col("_within")).cast("long")).drop(
        "_slice", "_within", "_before")
