"""Trace records of served requests, in a table that takes every batch once, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.ranking import first_per_group
from quillon.sources import committed

# --- fixed values: lengths of the shortened log fields ------------------------------------------
QUERY_SHOWN, ERROR_SHOWN = 100, 200


def trace_records(answers: DataFrame, latency_ms: Column, at: Column) -> DataFrame:
    """A record per answer: parameters, metrics and the trace as JSON, of failures too.

    ``query`` and ``error`` are shortened as a log shows them; ``full_query`` and ``full_error`` are
    whole.
    """
    failed = F.col("narrative").isNull()
    trace = F.to_json(F.struct("query", "sql_query", "narrative", "bias_score",
                               F.col("latency_ms"), F.col("ts").alias("timestamp"), "error"),
                      {"ignoreNullFields": "false"})
    return (
        answers.withColumns({"latency_ms": latency_ms, "ts": at})
        .select(
            F.left("query", F.lit(QUERY_SHOWN)).alias("query"), "k", "metric", "session_id",
            "latency_ms", "bias_score", F.size("retrieved_docs").alias("docs_retrieved"),
            F.when(failed, "error").otherwise("ok").alias("status"),
            F.when(failed, F.left("error", F.lit(ERROR_SHOWN))).alias("error"),
            F.col("query").alias("full_query"), F.when(failed, F.col("error")).alias("full_error"),
            trace.alias("trace"), "ts", F.to_date("ts").alias("dt"))
    )


def append_trace(records: DataFrame, path: str, batch_id: str) -> bool:
    """Add a batch of records, by day, unless it is there already; whether it was added."""
    return committed.append(records, path, batch_id, "dt")


def read_trace(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of all committed batches, None before the first."""
    return committed.read(spark, path)


def exported(rows: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` records per key as a JSON list, with their number."""
    cut = first_per_group(rows, [key], [order], limit)
    fields = [c for c in rows.columns if c not in (key, order)]
    return cut.groupBy(key).agg(
        F.count("*").alias("row_count"),
        F.to_json(F.transform(
            F.sort_array(F.collect_list(F.struct("rank", F.struct(*fields).alias("record")))),
            lambda r: r["record"])).alias("records"))
