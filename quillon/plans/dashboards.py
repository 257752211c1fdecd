"""Request-log metrics: batches, totals, histograms, percentiles, gauges, series, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.operators.ordering import exact_percentiles, numbered
from quillon.operators.sketches import merged, percentiles, sketches
from quillon.session import written
from quillon.sources import tables

TURNS_PER_SEGMENT = 1024
SHARES = {"p50": 0.50, "p95": 0.95}


def batches(requests: DataFrame, interval: str = C.MAX_WAITING, size: int = C.MAX_BATCH_SIZE,
            group_rows: int | None = None) -> DataFrame:
    """Requests put into batches that close after ``size`` rows or when the interval ends."""
    timed = requests.withColumn("window_start", F.window("ts", interval).getField("start"))
    limits = {} if group_rows is None else {"group_rows": group_rows}
    placed = numbered(timed, ["window_start"], ["ts", "request_id"], "arrival", **limits)
    return placed.withColumn("batch_no", F.ceil(F.col("arrival") / size))


def batch_table(requests: DataFrame, interval: str, size: int = C.MAX_BATCH_SIZE) -> DataFrame:
    """One row per batch: size, time spent, and requests of the interval still waiting."""
    grouped = batches(requests, interval, size).groupBy("window_start", "batch_no").agg(
        F.count("*").alias("batch_size"),
        F.round(F.sum("latency"), 4).alias("processing_time"),
        F.max("arrival").alias("served"),
    )
    waiting = grouped.groupBy(F.col("window_start").alias("w")).agg(
        F.sum("batch_size").alias("arrived"))
    return grouped.join(waiting, F.col("window_start") == F.col("w")).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "batch_no", "batch_size", "processing_time",
        (F.col("arrived") - F.col("served")).alias("queue_size"))


def batch_groups(spark: SparkSession, folder: str) -> DataFrame:
    return batch_table(tables.request_log(spark, folder), "1 hour")


def histogram(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """Cumulative buckets with ``+Inf``, plus the count and sum of all observations."""
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    row = df.agg(*counts, F.count(value).alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("s"))
    cells = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("observations"))
             for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("observations")))
    return row.select(F.inline(F.array(*cells)), F.col("n").alias("total_count"),
                      F.round("s", 2).alias("total_sum"))


def batch_stats(spark: SparkSession, folder: str) -> DataFrame:
    return batch_summary(batch_groups(spark, folder))


def batch_summary(table: DataFrame) -> DataFrame:
    """Averages over a batch table beside the batch-size histogram; zeros if it is empty."""
    counts = [F.count_if(F.col("batch_size") <= b).alias(f"le_{b:g}") for b in C.BATCH_BUCKETS]
    return table.agg(
        F.round(F.coalesce(F.avg("batch_size"), F.lit(0.0)), 4).alias("avg_batch_size"),
        F.round(F.coalesce(F.avg("processing_time"), F.lit(0.0)), 4).alias("avg_processing_time"),
        F.coalesce(F.max("queue_size"), F.lit(0)).alias("max_queue_size"),
        F.coalesce(F.sum("batch_size"), F.lit(0)).alias("total_processed"),
        *counts,
    )


def dashboard_totals(spark: SparkSession, folder: str) -> DataFrame:
    """All requests and each status: count, mean latency, mean bias, threshold breaches."""
    log = tables.request_log(spark, folder)
    return (
        log.rollup("status")
        .agg(F.count("*").alias("total_queries"),
             F.round(F.coalesce(F.avg("latency"), F.lit(0.0)), 4).alias("avg_latency"),
             F.round(F.coalesce(F.avg("bias_score"), F.lit(0.0)), 4).alias("avg_bias"),
             F.count_if(F.col("bias_score") > C.BIAS_THRESHOLD).alias("breaches"))
        .withColumn("status", F.coalesce("status", F.lit("all")))
    )


def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return histogram(tables.request_log(spark, folder), F.col("latency"), C.LATENCY_BUCKETS)


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    log = tables.request_log(spark, folder)
    found = exact_percentiles(log, ["status"], "latency", SHARES)
    return found.select("status", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


def percentile_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Median and 95th percentile per status from daily sketches, each with whether its rank among
    all latencies is within two percent of the share asked."""
    log = tables.request_log(spark, folder)
    daily = written(sketches(log.withColumn("day", F.to_date("ts")), ["status", "day"], "latency"),
                    "sketches")
    found = percentiles(merged(daily, ["status"]), SHARES)
    ranks = log.join(F.broadcast(found), "status").groupBy("status", "n").agg(*[
        (F.count_if(F.col("latency") <= F.col(name)) / F.first("n")).alias(name) for name in SHARES])
    return ranks.select("status", "n", *[
        F.col(name).between(share - 0.02, share + 0.02).alias(f"{name}_within")
        for name, share in SHARES.items()])


def session_gauges(spark: SparkSession, folder: str) -> DataFrame:
    """Requests per session with the latest bias score and latency."""
    when = F.struct("ts", "request_id")
    return tables.request_log(spark, folder).groupBy("session_id").agg(
        F.count("*").alias("requests"),
        F.max_by("bias_score", when).alias("latest_bias"),
        F.max_by("latency", when).alias("latest_latency"),
    )


def session_series(spark: SparkSession, folder: str) -> DataFrame:
    """Latency and bias in order of arrival within the session, indexed from 0."""
    placed = numbered(tables.request_log(spark, folder), ["session_id"], ["ts", "request_id"], "n")
    return placed.select("session_id", (F.col("n") - 1).alias("position"), "request_id",
                         "latency", "bias_score")


def transcript_segments(turns: DataFrame, size: int = TURNS_PER_SEGMENT) -> DataFrame:
    """Transcripts in segments of ``size`` messages, so an endless conversation is many rows.

    Segments are cut by the message's place in its conversation, whatever the turn numbers are; every
    row carries the conversation's own number of messages.
    """
    said = F.struct("turn", "role", "text")
    placed = numbered(turns, ["conv_id"], ["turn", "role", "text"], "place")
    segments = placed.groupBy("conv_id", F.floor((F.col("place") - 1) / size).alias("segment")).agg(
        F.sort_array(F.collect_list(said)).alias("messages"))
    totals = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("message_count"))
    return segments.join(totals, "conv_id")


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return transcript_segments(tables.read(spark, folder, "conversations")).select(
        "conv_id", "segment", "message_count",
        F.array_join(lines, "\n").alias("transcript"))
