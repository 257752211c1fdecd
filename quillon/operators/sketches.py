"""Percentiles from sketches that add up: a small summary per group and period, merged as needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch; the rank error is about 0.7 % at this size, whatever is merged.
SKETCH_K = 400


def sketches(df: DataFrame, groups: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """``groups``, ``n`` and a KLL ``sketch`` of the group's values; nulls do not count.

    The rows of a period can be thrown away once its sketch is kept.
    """
    return df.filter(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"))


def merged(parts: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return parts.groupBy(*groups).agg(F.sum("n").alias("n"),
                                      F.kll_merge_agg_double("sketch").alias("sketch"))


def percentiles(summed: DataFrame, shares: dict[str, float]) -> DataFrame:
    """One column per name in ``shares`` with the value at that share of the ranks."""
    return summed.select(*[c for c in summed.columns if c != "sketch"], *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(share)).alias(name)
        for name, share in shares.items()])
