"""Requests as a stream: guarded, batched, answered with prompts, and summed up per session.

Two ways to answer. A store of passages that fits a checked size travels to the requests and every
micro-batch is answered without a shuffle. For a larger store requests are landed first and answered
by the batch search, which has no such limit.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon import constants as C
from quillon.functions.guards import is_safe, redact_pii, validated_requests
from quillon.operators import blocks
from quillon.operators.batching import WAIT_MICROS
from quillon.operators.encoder import embed_column, embed_texts
from quillon.plans.retrieval import prompt_text, prompts, retrieve
from quillon.streaming.batches import batched, observed

REQUEST_SCHEMA = ("request_id BIGINT, ts TIMESTAMP, session_id STRING, query STRING, k INT, "
                  "metric STRING")
ANSWER_SCHEMA = ("request_id BIGINT, ts TIMESTAMP, session_id STRING, query STRING, result STRING, "
                 "error STRING, place INT, batch_key STRING, batch_size INT, "
                 "processing_time DOUBLE, queue_size INT, closed_by STRING")
STORE_ROWS, STORE_BYTES = 100_000, 256 << 20
BATCHES_AT_ONCE = 256
Respond = Callable[[list[str]], list[str]]


def read_requests(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def guarded(requests: DataFrame) -> DataFrame:
    """Requests with defaults, a safety flag and the redacted query; works on streams and tables."""
    return validated_requests(requests).withColumns({
        "is_safe": is_safe(F.col("query")), "redacted": redact_pii(F.col("query"))})


def in_range(requests: DataFrame, k: int) -> DataFrame:
    """Requests with ``k`` filled in and ``reject_reason`` where a field is out of range."""
    checked = validated_requests(requests.withColumn("k", F.coalesce("k", F.lit(k))))
    return checked.select(*requests.columns, "reject_reason")


def answered(requests: DataFrame, store: DataFrame, size: int = C.MAX_BATCH_SIZE, k: int = 2,
             respond: Respond | None = None, lane: Column | None = None,
             wait_micros: int = WAIT_MICROS, lateness: str = "1 second") -> DataFrame:
    """Answers to a stream (or table) of requests from a small store(doc_id, text).

    Requests of a ``lane`` (one for all by default) are answered in count-or-time batches, see
    ``batches.batched``. ``respond`` turns a batch of prompts into results; without it the prompt is
    the result. If it fails, each request of the batch gets the error. A request that is out of
    range, or has no time on a stream, gets its reason and no result.
    """
    texts, fits = blocks.small_enough(store.select("doc_id", "text"), STORE_ROWS, STORE_BYTES)
    if not fits:
        raise ValueError("store too large to share with every task: use land() and answer_landed()")
    session = requests.sparkSession
    kept = texts.sort_by("doc_id")
    embedded = embed_texts(session.createDataFrame(kept), "doc_id", "text").toArrow().sort_by("doc_id")
    shared = session.sparkContext.broadcast(
        (blocks.values(kept["doc_id"]), kept["text"].to_pylist(),
         blocks.matrix(embedded["embedding"])))
    asked = observed(in_range(requests, k), "arrived", F.count("request_id").alias("requests"))
    closed = batched(asked.select(
        "ts", "request_id", "session_id", "query", "reject_reason", F.col("k").alias("q_k"),
        embed_column(F.coalesce("query", F.lit(""))).alias("q_vec")),
        F.lit("") if lane is None else lane, size, wait_micros, lateness)

    def scan(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, passages, vectors = shared.value
        for rows in arrived:
            for i in range(0, len(rows), BATCHES_AT_ONCE):
                yield from _served(rows.slice(i, BATCHES_AT_ONCE), ids, passages, vectors, respond)

    first = F.col("place") == 1
    answers = observed(
        closed.mapInArrow(scan, ANSWER_SCHEMA), "served", F.count(F.lit(1)).alias("requests"),
        F.count_if(first).alias("batches"),
        F.sum(F.when(first, F.col("processing_time"))).alias("processing_time"),
        F.max("queue_size").alias("max_queue_size"))
    if not requests.isStreaming:
        return answers
    timeless = requests.filter("ts IS NULL AND request_id IS NOT NULL").select(
        "request_id", "ts", "session_id", "query", F.lit("request has no time").alias("error"))
    return answers.unionByName(timeless, allowMissingColumns=True)


def _served(rows: pa.RecordBatch, ids, passages, vectors, respond) -> Iterator[pa.RecordBatch]:
    """The answers of some batches, given as a row each. They are searched together and responded to
    one by one; a batch's time is its share of the search and its own response."""
    began = time.time()
    sizes = np.asarray(rows["requests"].value_lengths())
    part = pa.RecordBatch.from_struct_array(rows["requests"].flatten())
    reasons = part["reject_reason"].to_pylist()
    results, errors = [None] * len(part), list(reasons)
    good = np.flatnonzero(np.asarray(part["reject_reason"].is_null()))
    try:
        made = _prompts(part.take(pa.array(good)), ids, passages, vectors)
    except Exception as failure:
        if len(rows) > 1:
            for i in range(len(rows)):
                yield from _served(rows.slice(i, 1), ids, passages, vectors, respond)
            return
        good, made = good[:0], []
        errors = [reason or f"Error processing request: {failure}" for reason in reasons]
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(good, np.concatenate([[0], ends]))
    took = np.full(len(rows), (time.time() - began) / max(1, len(rows)))
    for i in range(len(rows)):
        mine, texts = good[cuts[i]: cuts[i + 1]], made[cuts[i]: cuts[i + 1]]
        if respond is not None and texts:
            began = time.time()
            try:
                texts = respond(texts)
            except Exception as failure:
                texts = []
                for at in range(ends[i] - sizes[i], ends[i]):
                    errors[at] = reasons[at] or f"Error processing request: {failure}"
            took[i] += time.time() - began
        for at, text in zip(mine, texts):
            results[at] = text
    own = pa.array(np.repeat(np.arange(len(rows)), sizes))
    keys = [f"{lane}-{number}" for lane, number in zip(rows["lane"].to_pylist(),
                                                       rows["batch_no"].to_pylist())]
    yield pa.record_batch({
        "request_id": part["request_id"], "ts": part["ts"], "session_id": part["session_id"],
        "query": part["query"], "result": pa.array(results, pa.string()),
        "error": pa.array(errors, pa.string()),
        "place": pa.array(np.arange(len(part)) - np.repeat(ends - sizes, sizes) + 1, pa.int32()),
        "batch_key": pa.array(keys, pa.string()).take(own),
        "batch_size": pa.array(sizes, pa.int32()).take(own),
        "processing_time": pa.array(took).take(own),
        "queue_size": rows["queue_size"].cast(pa.int32()).take(own),
        "closed_by": rows["closed_by"].take(own)})


def _prompts(served: pa.RecordBatch, ids, passages, vectors) -> list[str]:
    """The prompt of every request, with its passages in rank order."""
    n = len(served)
    if not n:
        return []
    asked = blocks.Queries(np.arange(n), blocks.matrix(served["q_vec"]), np.full(n, "l2"),
                           blocks.values(served["q_k"]).astype(np.int64))
    found: list[list[str]] = [[] for _ in range(n)]
    for q, row in zip(*(c.tolist() for c in blocks.nearest(asked, ids, vectors, C.RETRIEVAL_EPS)[:2])):
        found[q].append(passages[row])
    return [prompt_text(q, "\n".join(f)) for q, f in zip(served["query"].to_pylist(), found)]


def write_stream(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None,
                 ) -> StreamingQuery:
    """Append to files: every ``interval``, or once over the whole backlog and then stop."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def served_batches(answers: DataFrame) -> DataFrame:
    """The batch table of an answer log, for ``dashboards.batch_summary``."""
    return answers.groupBy("batch_key").agg(
        F.first("batch_size").alias("batch_size"),
        F.first("processing_time").alias("processing_time"),
        F.first("queue_size").alias("queue_size"))


def land(requests: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Move the backlog into a table of its own, exactly once."""
    return write_stream(requests, path, checkpoint)


def answer_landed(landed: DataFrame, done: DataFrame | None, store: DataFrame, k: int = 2) -> DataFrame:
    """Prompts for landed requests not in ``done(request_id)``, from a store of any size.

    A request that is out of range gets its reason as ``error`` and no result.
    """
    fresh = landed if done is None else landed.join(done, "request_id", "left_anti")
    checked = in_range(fresh, k)
    good = checked.filter("reject_reason IS NULL").withColumnRenamed("request_id", "question_id")
    found = retrieve(good, store, C.MAX_K, "l2", k_column=F.col("k"))
    answers = prompts(good, found).select(
        F.col("question_id").alias("request_id"), "query", F.col("prompt").alias("result"),
        F.lit(None).cast("string").alias("error"))
    return answers.unionByName(checked.filter("reject_reason IS NOT NULL").select(
        "request_id", "query", F.lit(None).cast("string").alias("result"),
        F.col("reject_reason").alias("error")))


def session_history(log: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Requests, mean latency and mean bias per session and window.

    The watermark lets windows close, so state stays as large as the open windows.
    """
    return (
        log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("w"), "session_id").agg(*_history())
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "session_id", "requests", "avg_latency", "avg_bias")
    )


def session_visits(log: DataFrame, gap: Column | str = "30 minutes",
                   lateness: str = "10 minutes") -> DataFrame:
    """Requests, mean latency and mean bias per session and visit: a visit ends when ``gap`` passes
    after a request without another. ``gap`` may depend on the request.

    On a stream visits come out once the watermark has passed their end (append mode; Spark has no
    update mode for them), so state stays as large as the open visits. Start and end are aggregates:
    a caller's filter on the window itself would be moved before the merging of requests.
    """
    gap = F.lit(gap) if isinstance(gap, str) else gap
    return (
        log.withWatermark("ts", lateness)
        .withColumn("_until", F.col("ts") + gap.cast("interval"))
        .groupBy(F.session_window("ts", gap), "session_id")
        .agg(F.min("ts").alias("visit_start"), F.max("_until").alias("visit_end"), *_history())
        .select("session_id", "visit_start", "visit_end", "requests", "avg_latency", "avg_bias")
    )


def _history() -> list[Column]:
    return [F.count("*").alias("requests"), F.avg("latency").alias("avg_latency"),
            F.avg("bias_score").alias("avg_bias")]
