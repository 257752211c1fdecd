"""Count-or-time batches on a stream, in event time, and their metrics.

State per lane: the requests that no closed batch holds, and the number of batches so far. Requests
are placed in order of (time, id) once the watermark has passed them, so nothing that arrives later
can come between; a batch closes when it is full, or when the watermark shows that no request within
``wait`` of its first can still come. Which requests form a batch therefore depends on the requests
alone, not on triggers, files or partitions, and equals ``operators.batching.placed_in_batches``.

A lane is worked off by one task at a time, so the caller's lanes are the parallelism; a lane's
state is what arrives within lateness and wait. A row without a request id is a heartbeat: it moves
the watermark, as a quiet source needs to have its last batches closed, and belongs to no batch.
Requests behind the watermark are dropped by Spark and counted in its progress; ``results.joined``
gives them an error.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon import constants as C
from quillon.operators.batching import WAIT_MICROS, placed_in_batches

STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
METRICS_SCHEMA = ("trigger BIGINT, arrived BIGINT, batches BIGINT, requests BIGINT, "
                  "processing_time DOUBLE, max_queue_size BIGINT, backlog BIGINT")


def unrepeated(requests: DataFrame, lateness: str = "1 minute", at: str = "ts") -> DataFrame:
    """Requests once, however often a producer sends them: the earliest of each id.

    On a stream repeats are known for ``lateness`` after the first, on a table always. Rows without
    an id (heartbeats) count as one on a stream and are left out of a table.
    """
    if not requests.isStreaming:
        first = F.row_number().over(Window.partitionBy("request_id").orderBy(at))
        return requests.filter(F.col("request_id").isNotNull()).withColumn("_first", first).filter(
            "_first = 1").drop("_first")
    return requests.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["request_id"])


def batched(requests: DataFrame, lane: Column, size: int = C.MAX_BATCH_SIZE,
            wait_micros: int = WAIT_MICROS, lateness: str = "1 second") -> DataFrame:
    """(lane, batch_no, opened, closed_by, queue_size, requests) with a row per closed batch.

    ``requests`` needs request_id and ts; all its columns come back in the array of structs, in
    order. ``queue_size`` is what the lane still held when the batch was closed. A table is batched
    as a whole: its last batches are closed, and nothing is left waiting. Requests without a time
    come first in a table, and have no place on a stream (``requests.answered`` gives them an error).
    """
    if not requests.isStreaming:
        return _batched_table(requests, lane, size, wait_micros)
    fields = requests.columns
    kind = requests.schema["request_id"].dataType.simpleString()
    fed = requests.withWatermark("ts", lateness).select(
        "ts", "request_id", F.coalesce(lane.cast("string"), F.lit("")).alias("lane"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.to_json(F.struct(*fields), STAMP).alias("payload"))

    def close(key: tuple, arrived: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, micros, ids, payloads = state.get if state.exists else (0, [], [], [])
        held = list(zip(micros, ids, payloads))
        for part in arrived:
            some = part[part["request_id"].notna() & part["micros"].notna()]
            held += zip(some["micros"].astype("int64").tolist(), some["request_id"].tolist(),
                        some["payload"].tolist())
        held.sort(key=lambda r: r[:2])
        passed = state.getCurrentWatermarkMs() * 1000
        closed, at, due = closings([r[0] for r in held], passed, size, wait_micros)
        rows = [(key[0], number + 1 + i, held[first][0], by, len(held) - end,
                 [r[2] for r in held[first:end]]) for i, (first, end, by) in enumerate(closed)]
        left = held[at:]
        state.update((number + len(closed), *([r[i] for r in left] for i in range(3))))
        if due is not None:
            state.setTimeoutTimestamp(max(-(-due // 1000) - 1, state.getCurrentWatermarkMs() + 1))
        if rows:
            yield pd.DataFrame(rows, columns=["lane", "batch_no", "opened", "closed_by",
                                              "queue_size", "payloads"])

    closed = fed.groupBy("lane").applyInPandasWithState(
        close, "lane string, batch_no long, opened long, closed_by string, queue_size long, "
               "payloads array<string>",
        f"number long, micros array<long>, ids array<{kind}>, payloads array<string>",
        "append", GroupStateTimeout.EventTimeTimeout)
    row = requests.select(F.struct(*fields).alias("r")).schema["r"].dataType
    return closed.select(
        "lane", "batch_no", F.timestamp_micros("opened").alias("opened"), "closed_by", "queue_size",
        F.transform("payloads", lambda p: F.from_json(p, row, STAMP)).alias("requests"))


def closings(micros: list[int], passed: int, size: int,
             wait: int) -> tuple[list[tuple[int, int, str]], int, int | None]:
    """What can be closed of sorted times when all times up to ``passed`` are known.

    The batches as (first, end, cause), the place of the first request left, and the time that must
    have passed before another batch can close.
    """
    closed, at = [], 0
    while at < len(micros):
        end = min(bisect_left(micros, micros[at] + wait, at), at + size)
        full = end - at == size
        due = micros[end - 1] if full else micros[at] + wait - 1
        if due > passed:
            return closed, at, due
        closed.append((at, end, "size" if full else "time"))
        at = end
    return closed, at, None


def _batched_table(requests: DataFrame, lane: Column, size: int, wait_micros: int) -> DataFrame:
    fields = requests.columns
    laned = requests.withColumn("_lane", F.coalesce(lane.cast("string"), F.lit("")))
    placed = placed_in_batches(laned, "_lane", size, wait_micros)
    member = F.struct("place", F.struct(*fields).alias("request"))
    return placed.groupBy(F.col("_lane").alias("lane"), "batch_no").agg(
        F.min("ts").alias("opened"), F.sort_array(F.collect_list(member)).alias("members")).select(
        "lane", "batch_no", "opened",
        F.when(F.size("members") == size, "size").otherwise("time").alias("closed_by"),
        F.lit(0).cast("long").alias("queue_size"),
        F.transform("members", lambda m: m["request"]).alias("requests"))


def observed(stream: DataFrame, name: str, *values: Column) -> DataFrame:
    return stream.observe(name, *values) if stream.isStreaming else stream


def trigger_metrics(spark: SparkSession, query: StreamingQuery, waiting_before: int = 0) -> DataFrame:
    """What every trigger of a query over ``served`` batches did, from its own progress reports.

    ``backlog`` is what had arrived and was not yet in a closed batch after the trigger, counted
    from ``waiting_before`` at the start. Spark keeps the last hundred reports unless told otherwise.
    """
    rows, backlog = [], waiting_before
    for report in query.recentProgress:
        seen = {name: row.asDict() for name, row in report["observedMetrics"].items()}
        arrived = (seen.get("arrived") or {}).get("requests") or 0
        served = seen.get("served") or {}
        backlog += arrived - (served.get("requests") or 0)
        rows.append((report["batchId"], arrived, served.get("batches") or 0,
                     served.get("requests") or 0, served.get("processing_time") or 0.0,
                     served.get("max_queue_size") or 0, backlog))
    return spark.createDataFrame(rows, METRICS_SCHEMA)
