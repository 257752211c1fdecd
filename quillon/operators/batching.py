"""Requests put into batches that close at a size or a time after their first request.

Requests of a lane are taken in order of (time, id). A batch opens with the first request that no
batch holds yet, and closes when it holds ``size`` requests or when ``wait`` has passed since it
opened; a request at or after that time opens the next one. So where a batch begins depends on all
requests before it, and a window of fixed bounds cannot say it.

A batch holds at most ``size`` requests, hence of any ``size`` requests in a row one opens a batch.
A chunk of a lane is therefore a small function: from the place at which its first batch opens
(0 .. size - 1) to the place at which the first batch after it opens, and the number of batches
between. Chunks are computed apart for every entry, their functions are chained in one aggregate of a
row per chunk, and a second pass deals out the batches. A lane with all requests is as many tasks as
it has chunks, and the result does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillon import constants as C
from quillon.operators.ordering import GROUP_ROWS, numbered
from quillon.session import written

CHUNK_ROWS = 100_000
WAIT_MICROS = 100_000
BEFORE_ALL = -(2**62)


def next_open(micros: np.ndarray, size: int, wait: int) -> np.ndarray:
    """For each request, the place of the first one after the batch that would open with it."""
    late = np.searchsorted(micros, micros + wait, "left")
    return np.minimum(late, np.arange(len(micros)) + size)


def opens(micros: np.ndarray, size: int, wait: int, start: int = 0) -> np.ndarray:
    """Places at which batches open, the first at ``start``."""
    after, out, at = next_open(micros, size, wait).tolist(), [], start
    while at < len(after):
        out.append(at)
        at = after[at]
    return np.array(out, np.int64)


def chunk_exits(micros: np.ndarray, own: int, size: int, wait: int) -> list[tuple[int, int]]:
    """For each entry 0 .. size - 1 of a chunk of ``own`` requests, followed by the first of the next
    chunk: the entry to the next chunk and the number of batches opened in this one."""
    after = next_open(micros, size, wait).tolist()
    at_end = {}
    for at in range(own - 1, -1, -1):
        to = after[at]
        at_end[at] = (to - own, 1) if to >= own else (at_end[to][0], at_end[to][1] + 1)
    return [at_end[e] if e < own else (e - own, 0) for e in range(size)]


def placed_in_batches(requests: DataFrame, lane: str, size: int = C.MAX_BATCH_SIZE,
                      wait_micros: int = WAIT_MICROS, chunk_rows: int = CHUNK_ROWS,
                      group_rows: int = GROUP_ROWS) -> DataFrame:
    """``requests`` (lane, ts, request_id, ...) with ``batch_no`` (from 1 in the lane) and ``place``
    (from 1 in the batch).

    Requests without a time come first, as if sent together; those without an id (heartbeats) or a
    lane are left out.
    ``chunk_rows`` is at least ``size``; ``group_rows`` bounds a plain window, as in ``numbered``.
    """
    chunk_rows = max(chunk_rows, size)
    whole = requests.filter(F.col(lane).isNotNull() & F.col("request_id").isNotNull())
    arrived = written(numbered(whole, [lane], ["ts", "request_id"], "_at", group_rows).select(
        *requests.columns, (F.col("_at") - 1).alias("_at"),
        F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(BEFORE_ALL))
        .alias("_micros")), "arrivals")
    chunk, inside = F.floor(F.col("_at") / chunk_rows), F.col("_at") % chunk_rows
    shown_twice = (inside < size) & (F.col("_at") >= chunk_rows)
    chunks = arrived.withColumn("_chunk", F.explode(
        F.when(shown_twice, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))))
    kind, names = arrived.schema[lane].dataType.simpleString(), requests.columns

    def sorted_chunk(table: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
        table = table.sort_by("_at")
        own = np.asarray(table["_at"]) // chunk_rows == table["_chunk"][0].as_py()
        return table, np.asarray(table["_micros"]), int(own.sum())

    def exits(table: pa.Table) -> pa.Table:
        table, micros, own = sorted_chunk(table)
        found = chunk_exits(micros, own, size, wait_micros)
        return pa.table({"lane": table[lane].slice(0, 1), "chunk": table["_chunk"].slice(0, 1),
                         "exits": pa.array([[e for e, _ in found]], pa.list_(pa.int32())),
                         "opened": pa.array([[n for _, n in found]], pa.list_(pa.int64()))})

    functions = chunks.select(lane, "_at", "_micros", "_chunk").groupBy(lane, "_chunk").applyInArrow(
        exits, f"lane {kind}, chunk long, exits array<int>, opened array<long>")
    entries = _chained(functions).withColumnsRenamed({
        "lane": lane, "chunk": "_chunk", "entry": "_entry", "before": "_before"})

    def deal(table: pa.Table) -> pa.Table:
        table, micros, own = sorted_chunk(table)
        starts = opens(micros, size, wait_micros, table["_entry"][0].as_py())
        rows = np.arange(len(micros))
        number = np.searchsorted(starts, rows, "right")
        first = np.concatenate([[len(micros)], starts])[number]
        number += table["_before"][0].as_py()
        return (table.select(names).append_column("batch_no", pa.array(number))
                .append_column("place", pa.array(rows - first + 1))
                .filter(pa.array((first < own) & (rows >= first))))

    schema = StructType([*arrived.select(names).schema.fields, StructField("batch_no", LongType()),
                         StructField("place", LongType())])
    return chunks.join(entries, [lane, "_chunk"]).groupBy(lane, "_chunk").applyInArrow(deal, schema)


def _chained(functions: DataFrame) -> DataFrame:
    """(lane, chunk, entry, before): where each chunk's first batch opens, and the batches before."""
    cell = F.struct("chunk", "exits", "opened")
    start = F.struct(F.lit(0).alias("entry"), F.lit(0).cast("long").alias("before"),
                     F.array().cast("array<struct<chunk:bigint,entry:int,before:bigint>>")
                     .alias("done"))

    def step(state, c):
        return F.struct(
            F.get(c["exits"], state["entry"]).alias("entry"),
            (state["before"] + F.get(c["opened"], state["entry"])).alias("before"),
            F.array_append(state["done"], F.struct(
                c["chunk"].alias("chunk"), state["entry"].alias("entry"),
                state["before"].alias("before"))).alias("done"))

    chained = functions.groupBy("lane").agg(F.sort_array(F.collect_list(cell)).alias("cells")).select(
        "lane", F.aggregate("cells", start, step)["done"].alias("done"))
    return chained.select("lane", F.inline("done"))
