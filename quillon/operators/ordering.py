"""Exact running totals and row numbers that hold up when one group has a third of all rows.

A window function puts a whole group into one task. That is the right plan while groups are small.
Past ``group_rows`` the frame is cut into even range slices instead: totals run within each slice,
and every slice adds the sum of the slices before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import written

GROUP_ROWS = 1_000_000


def running_total(df: DataFrame, groups: list[str], order: list[str], weight: Column, out: str,
                  group_rows: int = GROUP_ROWS) -> DataFrame:
    """``df`` plus ``out``, the sum of ``weight`` from the start of the group up to this row.

    ``order`` must be unique within a group, so that slices can always be cut evenly.
    """
    sizes = df.groupBy(*groups).count().agg(F.max("count"), F.sum("count")).first()
    largest, total = sizes[0] or 0, sizes[1] or 0
    if largest <= group_rows:
        frame = (Window.partitionBy(*groups).orderBy(*order)
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn(out, F.sum(weight).over(frame))
    slices = -(-total // group_rows) + 1
    return _sliced_total(df, groups, order, weight, out, slices)


def _sliced_total(df, groups, order, weight, out, slices):
    sliced = written(
        df.withColumn("_weight", weight)
        .repartitionByRange(slices, *groups, *order)
        .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    keys = [*groups, "_slice"]
    before = (Window.partitionBy(*groups).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        sliced.groupBy(*keys).agg(F.sum("_weight").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .select(*[F.col(c).alias(f"_o_{c}") for c in keys], "_before")
    )
    inside = (Window.partitionBy(*keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = sliced.withColumn("_local", F.sum("_weight").over(inside))
    same = reduce(lambda a, b: a & b,
                  [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in keys])
    return (local.join(offsets, same)
            .withColumn(out, F.col("_local") + F.col("_before"))
            .select(*df.columns, out))


def numbered(df: DataFrame, groups: list[str], order: list[str], out: str,
             group_rows: int = GROUP_ROWS) -> DataFrame:
    """``df`` plus ``out``, the row number from 1 within the group."""
    return running_total(df, groups, order, F.lit(1).cast("bigint"), out, group_rows)


def exact_percentiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float],
                      group_rows: int = GROUP_ROWS) -> DataFrame:
    """Linear-interpolated percentiles per group, one column per name in ``shares``.

    No group's values are held in one buffer: equal values are counted first, and the ordered pass
    then sees each distinct value once, for all shares together. The counts are written once, as
    they are read for the totals, the slices and the ranks.
    """
    counts = written(df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count("*").alias("_n")), "value-counts")
    ranked = running_total(counts, groups, [value], F.col("_n"), "_upto", group_rows)
    totals = counts.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    if groups:
        totals = totals.select(*[F.col(g).alias(f"_g_{g}") for g in groups], "_total")
        same = reduce(lambda a, b: a & b,
                      [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups])
        ranked = ranked.join(totals, same)
    else:
        ranked = ranked.withColumn("_total", totals.scalar())

    def at(position) -> list:
        """The values at the whole positions below and above."""
        return [F.min(F.when(F.col("_upto") > end(position), F.col(value)))
                for end in (F.floor, F.ceil)]

    ends = []
    for name, share in shares.items():
        position = (F.col("_total") - 1) * F.lit(share)
        low, high = at(position)
        ends += [low.alias(f"_low_{name}"), high.alias(f"_high_{name}"),
                 F.first(position - F.floor(position)).alias(f"_part_{name}")]
    found = ranked.groupBy(*groups).agg(*ends)
    return found.select(*groups, *[
        (F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}"))
        .alias(n) for n in shares])
