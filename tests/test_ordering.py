"""Row numbers, running totals, percentiles and batches, with and without a hot group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import sketches
from quillon.operators.ordering import exact_percentiles, numbered, running_total
from quillon.plans.dashboards import batch_summary, batch_table, batches, transcript_segments


@pytest.fixture(scope="module")
def hot(spark):
    """900 rows; group 0 holds a third of them and all its rows carry the same time."""
    return spark.range(900).select(
        F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 7).alias("g"),
        F.when(F.col("id") < 300, 5).otherwise(F.col("id") % 50).alias("t"),
        "id", (F.col("id") % 4 + 1).alias("w"))


def expected(hot):
    upto, out = {}, {}
    for r in sorted(hot.collect(), key=lambda r: (r["g"], r["t"], r["id"])):
        n, s = upto.get(r["g"], (0, 0))
        upto[r["g"]] = (n + 1, s + r["w"])
        out[r["id"]] = upto[r["g"]]
    return out


@pytest.mark.parametrize("group_rows", [1_000_000, 40])
def test_totals_and_numbers(spark, hot, group_rows):
    want = expected(hot)
    n = numbered(hot, ["g"], ["t", "id"], "n", group_rows)
    s = running_total(hot, ["g"], ["t", "id"], F.col("w"), "s", group_rows)
    assert {r["id"]: r["n"] for r in n.collect()} == {i: v[0] for i, v in want.items()}
    assert {r["id"]: r["s"] for r in s.collect()} == {i: v[1] for i, v in want.items()}


@pytest.mark.parametrize("group_rows", [1_000_000, 40])
def test_numbers_without_groups(spark, hot, group_rows):
    n = numbered(hot, [], ["id"], "n", group_rows)
    assert {r["id"]: r["n"] for r in n.collect()} == {i: i + 1 for i in range(900)}


@pytest.mark.parametrize("group_rows", [1_000_000, 10])
@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_percentiles(spark, group_rows, share):
    rng = np.random.default_rng(2)
    values = {g: rng.integers(0, 60, 101 + g).astype(float) for g in range(3)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in values.items() for v in vs],
                               "g int, v double")
    got = {r["g"]: r["p"] for r in
           exact_percentiles(df, ["g"], "v", {"p": share}, group_rows).collect()}
    for g, vs in values.items():
        assert got[g] == pytest.approx(np.percentile(vs, share * 100))
    overall = exact_percentiles(df, [], "v", {"p": share}, group_rows).first()["p"]
    assert overall == pytest.approx(np.percentile(np.concatenate(list(values.values())),
                                                  share * 100))


def test_batches_close_on_size_or_time(spark):
    rows = [(i, f"2024-01-01 00:00:00.{ms:03d}", 1.0)
            for i, ms in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 150, 160, 320])]
    log = spark.createDataFrame(rows, "request_id bigint, t string, latency double").withColumn(
        "ts", F.col("t").cast("timestamp"))
    table = batch_table(log, "100 milliseconds")
    sizes = sorted((r["window_start"], r["batch_no"], r["batch_size"], r["queue_size"])
                   for r in table.collect())
    assert [s[1:] for s in sizes] == [(1, 1, 0), (1, 2, 0), (1, 8, 2), (2, 2, 0)]
    placed = batches(log, "100 milliseconds", 8, group_rows=3).groupBy("batch_no").count()
    assert {r[0]: r[1] for r in placed.collect()} == {1: 11, 2: 2}


def test_empty_batch_table_gives_zeros(spark):
    empty = spark.createDataFrame(
        [], "batch_size bigint, processing_time double, queue_size bigint")
    row = batch_summary(empty).first()
    assert (row["avg_batch_size"], row["avg_processing_time"], row["max_queue_size"],
            row["total_processed"]) == (0.0, 0.0, 0, 0)


def test_transcript_segments_stay_bounded(spark):
    turns = spark.range(250).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"),
                                    F.lit("user").alias("role"), F.col("id").cast("string")
                                    .alias("text"))
    rows = transcript_segments(turns, 100).orderBy("segment").collect()
    assert [len(r["messages"]) for r in rows] == [100, 100, 50]
    assert [m["turn"] for r in rows for m in r["messages"]] == list(range(250))


def test_sketches_add_up(spark):
    """The rank of a merged sketch's percentile is within its error of the exact one."""
    rows = spark.range(60_000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") % 17).alias("day"),
        F.when(F.col("id") % 11 > 0, F.pow(F.rand(7), 3) * 1000).alias("v"))
    rows = rows.cache()
    daily = sketches.sketches(rows, ["g", "day"], "v")
    found = sketches.percentiles(sketches.merged(daily, ["g"]), {"p50": 0.5, "p95": 0.95}).collect()
    values = {g: np.sort([r["v"] for r in rows.filter(f"g = {g} AND v IS NOT NULL").collect()])
              for g in range(3)}
    for r in found:
        have = values[r["g"]]
        assert r["n"] == len(have)
        for name, share in (("p50", 0.5), ("p95", 0.95)):
            assert abs(np.searchsorted(have, r[name]) / len(have) - share) < 0.015
    rows.unpersist()
    few = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    one = sketches.percentiles(sketches.sketches(few.selectExpr("1 g", "v"), ["g"], "v"), {"p": 0.5})
    assert one.first()["n"] == 2 and one.first()["p"] in (1.0, 3.0)
