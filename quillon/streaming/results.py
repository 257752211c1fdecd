"""Answers brought back to the requests they belong to, on streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.streaming.batches import unrepeated

WITHIN, LATENESS = "2 minutes", "10 seconds"


def joined(requests: DataFrame, answers: DataFrame, within: str = WITHIN,
           lateness: str = LATENESS) -> DataFrame:
    """Every request(request_id, ts, ...) with ``result``, ``error`` and ``answered_at`` of its answer.

    A request whose answer(request_id, answered_at, result, error) is lost, or comes later than
    ``within`` or before its request, has an error instead. A repeated request id or answer counts
    once, the earliest. On streams both sides carry a watermark and the time bound, so a request
    waits in state for ``within`` and the lateness, and no longer; repeats are dropped as long.
    """
    fields = [c for c in requests.columns if c not in ("result", "error", "answered_at")]
    asked = unrepeated(requests.select(fields), lateness)
    given = unrepeated(answers, lateness, "answered_at").select(
        F.col("request_id").alias("_answers"), "answered_at", "result", "error")
    bound = F.expr(f"INTERVAL {within}")
    found = asked.join(given, (F.col("request_id") == F.col("_answers"))
                       & (F.col("answered_at") >= F.col("ts"))
                       & (F.col("answered_at") <= F.col("ts") + bound), "left")
    lost = F.col("_answers").isNull()
    return found.select(
        *fields, "answered_at", "result",
        F.when(lost, f"no answer within {within}").otherwise(F.col("error")).alias("error"))
