"""Table forms of what is served: SQL functions, guards, batches, results, visits, traces, short answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.functions import sqlfunctions
from quillon.functions import vectors as V
from quillon.operators.batching import placed_in_batches
from quillon.plans.answers import agent_answers, brief
from quillon.plans.dashboards import batch_table
from quillon.sources import catalog, sinks, tables
from quillon.streaming import requests as stream
from quillon.streaming import results
from quillon.streaming.batches import unrepeated

HALF_HOUR = 1_800_000_000


def sql_text_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Redaction, safety and bias of every text, called from SQL."""
    sqlfunctions.register(spark)
    tables.texts(spark, folder).createOrReplaceTempView("audited_texts")
    return spark.sql("SELECT text_id, redact_pii(text) AS redacted, is_safe_query(text) AS is_safe, "
                     "bias_score(text) AS bias_score FROM audited_texts")


def sql_distance_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector against the mean of its label, by the SQL distances."""
    sqlfunctions.register(spark)
    table = tables.read(spark, folder, "embeddings")
    means = V.mean_vectors(table, "label", "embedding", "center").drop("n")
    table.join(means, "label").createOrReplaceTempView("vectors_and_centers")
    measured = spark.sql(
        "SELECT vec_id, l2sq(embedding, center) AS l2sq, l2(embedding, center) AS l2, "
        "cosine_dist(embedding, center) AS cosine, neg_dot(embedding, center) AS neg_dot, "
        "l1(embedding, center) AS manhattan FROM vectors_and_centers")
    return measured.select("vec_id", *[V.rounded(F.col(c)).alias(c) for c in measured.columns[1:]])


def run_sql_guarded(spark: SparkSession, folder: str) -> DataFrame:
    """A statement of a user, through the guard."""
    tables.register(spark, folder)
    found, error = catalog.run_sql(
        spark, "SELECT passengers, COUNT(*) AS trips_taken, MAX(fare) AS highest FROM trips "
               "GROUP BY passengers")
    if found is None:
        raise ValueError(error)
    return found


def run_sql_limit(spark: SparkSession, folder: str) -> DataFrame:
    """A statement with a plain LIMIT, through the guard: how many rows it gives."""
    tables.register(spark, folder)
    found, error = catalog.run_sql(spark, "SELECT * FROM trips LIMIT 1000")
    if found is None:
        raise ValueError(error)
    return found.agg(F.count(F.lit(1)).alias("shown_rows"))


def guarded_requests(spark: SparkSession, folder: str) -> DataFrame:
    """All logged questions as requests: defaults, reason of refusal, safety and redaction."""
    return stream.guarded(tables.question_log(spark, folder)).select(
        "question_id", "k", "metric", "session_id", "query_length", "reject_reason", "is_safe",
        "redacted")


def session_history(spark: SparkSession, folder: str) -> DataFrame:
    """Requests, mean latency and mean bias per session and hour."""
    return stream.session_history(tables.request_log(spark, folder)).select(
        "session_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "requests", F.round("avg_latency", 4).alias("avg_latency"),
        F.round("avg_bias", 4).alias("avg_bias"))


def batch_groups_short(spark: SparkSession, folder: str) -> DataFrame:
    """Batches as served: eight requests or a tenth of a second."""
    return batch_table(tables.request_log(spark, folder), "100 milliseconds")


def _log(spark: SparkSession, folder: str) -> DataFrame:
    """The request log with instants as its times."""
    return tables.request_log(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _lane() -> Column:
    """Two replicas share the sessions."""
    return F.substring_index("session_id", "_", -1).cast("bigint") % 2


def request_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of each replica that close at eight requests or half an hour after their first."""
    log = _log(spark, folder).withColumn("lane", _lane())
    return placed_in_batches(log, "lane", wait_micros=HALF_HOUR).groupBy("lane", "batch_no").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("opened"),
        F.count(F.lit(1)).alias("batch_size"),
        F.round(F.sum("latency"), 4).alias("processing_time"),
        F.when(F.count(F.lit(1)) == C.MAX_BATCH_SIZE, "size").otherwise("time").alias("closed_by"))


def timed_requests(spark: SparkSession, folder: str) -> DataFrame:
    """The logged questions that have a time, as the stream would carry them."""
    at = _log(spark, folder).select("request_id", "ts", F.concat(
        F.lit("e-"), F.col("request_id").cast("string")).alias("question_id"))
    return tables.question_log(spark, folder).join(at, "question_id").drop("question_id")


def served_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every request answered with its batch: a prompt, or the reason of its refusal."""
    store = tables.read(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    served = stream.answered(timed_requests(spark, folder), store, lane=_lane(),
                             wait_micros=HALF_HOUR)
    return served.select("request_id", "query", "result", "error", "batch_key", "place",
                         "batch_size", "closed_by")


def requests_once(spark: SparkSession, folder: str) -> DataFrame:
    """The request log after a producer has sent part of it again, with each request once."""
    log = _log(spark, folder).select("request_id", "ts", "session_id", "latency", "metric")
    again = log.filter("request_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr(
        "INTERVAL 5 SECONDS"))
    return unrepeated(log.unionByName(again)).withColumn(
        "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def request_results(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a worker log brought back to their requests: some lost, some late, some failed."""
    log = _log(spark, folder)
    answers = log.filter("k % 10 <> 3").select(
        "request_id", F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("latency") * 1_000_000)
                                         .cast("bigint")).alias("answered_at"),
        F.when(F.col("status") == "ok", F.col("metric")).alias("result"),
        F.when(F.col("status") == "error", F.lit("failed")).alias("error"))
    back = results.joined(log.select("request_id", "ts", "session_id"), answers)
    return back.select("request_id", "session_id", "result", "error",
                       (F.unix_micros("answered_at") - F.unix_micros("ts")).alias("waited_micros"))


def session_visits(spark: SparkSession, folder: str) -> DataFrame:
    """Visits per session that end six hours after a request, or an hour after a failed one."""
    gap = F.when(F.col("status") == "error", "1 hour").otherwise("6 hours")
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("visit_start", "visit_end")}
    return stream.session_visits(_log(spark, folder), gap).withColumns({
        **shown, **{c: F.round(c, 9) for c in ("avg_latency", "avg_bias")}})


def trace_records(spark: SparkSession, folder: str) -> DataFrame:
    """The trace record of every logged question that has a time."""
    log = _log(spark, folder).select(
        F.concat(F.lit("e-"), F.col("request_id").cast("string")).alias("question_id"), "ts",
        "latency")
    answers = agent_answers(spark, folder).withColumn(
        "retrieved_docs", F.split("retrieved_ids", ",")).join(log, "question_id")
    records = sinks.trace_records(answers, F.col("latency"), F.col("ts"))
    return records.withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                                "dt": F.col("dt").cast("string")})


def brief_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The short answer to every logged question."""
    return brief(agent_answers(spark, folder))
