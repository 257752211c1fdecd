"""Top rows per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, groups: list[str], order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group with their ``rank``.

    With a literal limit Spark cuts each task's rows before the shuffle, so a group of any size
    sends at most ``limit`` rows per task.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= limit)
