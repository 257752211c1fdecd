"""Exact nearest neighbours that skip what cannot hold one, for l2 and Manhattan distance.

The candidates are laid out by place instead of by hash: every vector goes to its nearest of a few
pivots, and a pivot's vectors are cut into rings by their distance to it. By the triangle inequality
a ring of distances lo .. hi holds nothing nearer to a query than max(d - hi, lo - d), with d the
query's distance to the pivot. Each query first visits the rings that surely hold ``k`` vectors; its
k-th distance there bounds the search, and then only rings whose lower bound is within it are
visited. Rounding is covered by a slack, so no neighbour and no tie is lost; on data without any
structure every ring is visited, and the work is that of all pairs of blocks.

The second search goes by tiles: neighbouring rings form a part of bounded size, and a query is sent
once to every part that has a ring for it, however many those are; the task of a tile picks the
rings again. So a row is copied at most once per block of the other side (``blocks.rows_of_tile``),
however small the rings are.

Bounds: at most ``MOST_PIVOTS`` pivots and ``RINGS`` rings each are known to every task; a ring with
more rows than a block is dealt to several blocks by hash, and the queries that visit it to several
groups, so a dense place is not one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import blocks
from quillon.operators.ranking import first_per_group
from quillon.session import erase, written

METRICS = ("l2", "manhattan")
MOST_PIVOTS, RINGS, PIVOT_BYTES = 4096, 16, 16 << 20
#: Rows of a ring, if blocks are larger; share of a tile's visits beyond which all are made at once.
RING_ROWS, MOSTLY = 512, 0.2
SLACK = 1e-7


@dataclass
class Rings:
    """Where the vectors lie: pivots, and per ring its pivot, distances from .. to, and rows."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    slack: float

    def some(self, at: np.ndarray) -> Rings:
        """The rings at these places, with the pivots that they need."""
        used, pivot = np.unique(self.pivot[at], return_inverse=True)
        return Rings(self.pivots[used], pivot, self.low[at], self.high[at], self.rows[at], self.slack)

    def bounds(self, metric: str, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible distance of each vector to the rows of each ring."""
        to = _plain(metric, blocks._block_distance(metric, vectors, self.pivots, 0.0))[:, self.pivot]
        slack = self.slack * (1 + np.abs(vectors).max(initial=0)) * vectors.shape[1]
        return np.maximum(to - self.high, self.low - to) - slack, to + self.high + slack


@dataclass
class Found:
    """Neighbours, and how many of the possible visits of a query to a ring are made."""

    neighbours: DataFrame
    asked: DataFrame
    made: DataFrame | None = None
    rings: int = 0

    @property
    def visits(self) -> int:
        """Counted by a job of its own."""
        return self.made.agg(F.sum("visits")).first()[0] if self.made else 0

    @property
    def possible(self) -> int:
        return self.asked.count() * self.rings


def _plain(metric: str, distance: np.ndarray) -> np.ndarray:
    """The distance that obeys the triangle inequality."""
    return np.sqrt(np.maximum(distance, 0)) if metric == "l2" else distance


def _neighbouring(points: np.ndarray) -> np.ndarray:
    """An order in which near points are close: halves along the widest direction, again and again."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        some = todo.pop()
        if len(some) < 3:
            done.append(some)
            continue
        wide = np.argmax(np.ptp(points[some], axis=0))
        some = some[np.argsort(points[some, wide], kind="stable")]
        todo += [some[len(some) // 2:], some[:len(some) // 2]]
    return np.concatenate(done)


def lay_out(base: DataFrame, metric: str, block_rows: int, rows: int,
            width: int) -> tuple[DataFrame, Rings, DataFrame]:
    """``base`` with its ring, the rings, and the table ring -> blocks."""
    spark = base.sparkSession
    most = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * max(1, width))))
    wanted = min(most, max(1, math.ceil(rows / block_rows)))
    pivots = blocks.matrix(base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select(
        "embedding").toArrow()["embedding"])
    pivots = pivots[_neighbouring(pivots)]
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = blocks.matrix(batch["embedding"])
            cell, far = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            step = max(1, blocks.PAIRS_AT_ONCE // max(1, len(shared.value)))
            for i in range(0, len(batch), step):
                some = vectors[i: i + step]
                cell[i: i + step] = blocks._block_distance(metric, some, shared.value, 0.0).argmin(1)
                far[i: i + step] = _plain(metric, blocks.row_distance(
                    metric, some, shared.value[cell[i: i + step]], 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(far)], ["vec_id", "embedding", "cell", "far"])

    kind = base.schema["vec_id"].dataType.simpleString()
    item = base.schema["embedding"].dataType.simpleString()
    placed = written(base.select("vec_id", "embedding").mapInArrow(
        assign, f"vec_id {kind}, embedding {item}, cell long, far double"), "balls-cells")
    cuts = [i / RINGS for i in range(1, RINGS)]
    cells = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("far", cuts).alias("cuts"))
    rings = F.least(F.lit(RINGS), F.ceil(F.col("n") / block_rows)).cast("int")
    steps = cells.withColumn("rings", rings).select("cell", F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(RINGS - 1)), lambda i: i < F.col("rings")),
        lambda i: F.get("cuts", F.floor(i * RINGS / F.col("rings")).cast("int") - 1)).alias("cuts"))
    ring = F.size(F.filter("cuts", lambda c: F.col("far") > c))
    ringed = placed.join(F.broadcast(steps), "cell").select(
        "vec_id", "embedding", "far", (F.col("cell") * RINGS + ring).alias("place"))
    known = sorted(ringed.groupBy("place").agg(
        F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
        .collect(), key=lambda r: r["place"])
    number = {r["place"]: i for i, r in enumerate(known)}
    found = Rings(pivots, np.array([p // RINGS for p in number], np.int64),
                  np.array([r["low"] for r in known]), np.array([r["high"] for r in known]),
                  np.array([r["n"] for r in known], np.int64),
                  SLACK * (1 + float(np.abs(pivots).max(initial=0))))
    table = spark.createDataFrame(
        [(i, r["place"], math.ceil(r["n"] / block_rows)) for i, r in enumerate(known)],
        "ring int, place long, parts long")
    numbered = ringed.join(F.broadcast(table.drop("parts")), "place").drop("place", "far")
    return numbered, found, table.drop("place")


def exact(queries: DataFrame, base: DataFrame, k: int, metric: str, block_rows: int, rows: int,
          width: int) -> Found:
    """The ``q_k`` nearest of base(vec_id, embedding) for queries(query_id, q_vec, q_metric, q_k).

    ``queries`` come as from ``blocks.query_side``; all have the one ``metric``, and ``q_k`` is at
    most ``k``. ``rows`` and ``width`` are those of ``base``.
    """
    if metric not in METRICS:
        raise ValueError(f"no bounds for this distance: {metric}")
    spark = queries.sparkSession
    kinds = [queries.schema["query_id"].dataType.simpleString(),
             base.schema["vec_id"].dataType.simpleString()]
    if not rows:
        none = spark.createDataFrame([], f"query_id {kinds[0]}, rank int, vec_id {kinds[1]}, "
                                         "distance double")
        return Found(none, queries)
    ring_rows = min(block_rows, RING_ROWS)
    placed, rings, table = lay_out(base, metric, ring_rows, rows, width)
    shared = spark.sparkContext.broadcast(rings)
    asked = written(queries, "balls-queries")
    item = asked.schema["q_vec"].dataType.simpleString()
    schema = f"query_id {kinds[0]}, q_vec {item}, q_metric string, q_k int"

    def first_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in _slices(batches, len(known.rows)):
            _, most = known.bounds(metric, blocks.matrix(part["q_vec"]))
            q, ring = np.nonzero(sure(most, known.rows, blocks.values(part["q_k"])))
            yield pa.RecordBatch.from_arrays(
                [*part.take(pa.array(q)).columns, pa.array(ring.astype(np.int32))],
                ["query_id", "q_vec", "q_metric", "q_k", "ring"])

    def best(candidates: DataFrame) -> DataFrame:
        return first_per_group(candidates, ["query_id"], ["distance", "vec_id"], k)

    first = written(asked.mapInArrow(first_rings, f"{schema}, ring int"), "balls-visits")
    near = best(_meet(first, placed, table, ring_rows))
    # Equal ids are one query to ``near``: only what every one of them has seen bounds the search.
    kth = near.groupBy(F.col("query_id").alias("_q")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_d"))
    twins = asked.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("_same"))
    bounded = written(asked.join(kth.join(twins, "_q"), F.col("query_id") == F.col("_q"), "left").select(
        *asked.columns, F.when((F.col("_n") >= F.least("q_k", F.lit(rows))) & (F.col("_same") == 1),
                               F.col("_d")).otherwise(F.lit(math.inf)).alias("bound")), "balls-bounds")
    erase(first)
    q_rows = asked.count()
    size = blocks.rows_of_tile(spark, q_rows, rows, width, block_rows)
    parts, part_table = _parts(rings.rows, size)
    held = spark.sparkContext.broadcast(parts)
    q_parts, b_parts = max(1, -(-q_rows // size)), max(int(p[-1]) for p in parts) + 1

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        of_part = np.zeros((len(known.rows), b_parts), np.float32)
        for ring, some in enumerate(held.value):
            of_part[ring, some] = 1
        for part in _slices(batches, len(known.rows)):
            wanted = _within(known, metric, part)
            q, at = np.nonzero((wanted.astype(np.float32) @ of_part) > 0)
            yield pa.RecordBatch.from_arrays(
                [*part.take(pa.array(q)).columns, pa.array(at.astype(np.int32))],
                [*part.schema.names, "part"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in _slices(batches, len(known.rows)):
            yield pa.record_batch({"visits": pa.array(_within(known, metric, part).sum(axis=1))})

    def meet(tile: int, a: pa.Table, b: pa.Table) -> pa.Table:
        here, place = np.unique(b["ring"].to_numpy(), return_inverse=True)
        q, ids, vectors = blocks.Queries.of(a), blocks.values(b["vec_id"]), blocks.matrix(b["embedding"])
        found = _in_rings(q, ids, vectors, shared.value.some(here), place, metric)
        return pa.table({"query_id": a["query_id"].take(pa.array(found[0])),
                         "vec_id": b["vec_id"].take(pa.array(found[1])),
                         "distance": pa.array(found[2])})

    block = F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).cast("int")
    left = bounded.mapInArrow(chosen, f"{schema}, bound double, part int").withColumn(
        "tile", block * b_parts + F.col("part")).drop("part")
    spread = F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1)))
    right = placed.join(F.broadcast(spark.createDataFrame(part_table, "ring int, first int, many int")),
                        "ring").withColumn("qb", spread).withColumn(
        "tile", F.col("qb") * b_parts + F.col("first") + F.pmod(F.xxhash64("vec_id"), "many").cast(
            "int")).select("vec_id", "embedding", "ring", "tile")
    found = best(blocks.in_tiles(left, right, q_parts * b_parts, meet,
                                 f"query_id {kinds[0]}, vec_id {kinds[1]}, distance double"))
    return Found(found.select("query_id", "rank", "vec_id", "distance"), asked,
                 bounded.mapInArrow(counted, "visits long"), len(rings.rows))


def _slices(batches: Iterator[pa.RecordBatch], rings: int) -> Iterator[pa.RecordBatch]:
    step = max(1, blocks.PAIRS_AT_ONCE // max(1, rings))
    for batch in batches:
        for i in range(0, len(batch), step):
            yield batch.slice(i, step)


def _within(known: Rings, metric: str, part: pa.RecordBatch) -> np.ndarray:
    """Which rings can hold a row within the bound of each query."""
    least, _ = known.bounds(metric, blocks.matrix(part["q_vec"]))
    return least <= _plain(metric, blocks.values(part["bound"]))[:, None]


def _parts(rows: np.ndarray, size: int) -> tuple[list[np.ndarray], list[tuple[int, int, int]]]:
    """Rings in order put into parts of about ``size`` rows; a larger ring has several of its own.

    The parts of each ring, and the same as (ring, first part, number of parts).
    """
    parts, table, part, held = [], [], 0, 0
    for ring, n in enumerate(rows.tolist()):
        many = max(1, -(-n // size))
        if held and held + n > size:
            part, held = part + 1, 0
        parts.append(np.arange(part, part + many))
        table.append((ring, part, many))
        part, held = (part, held + n) if many == 1 else (part + many, 0)
    return parts, table


def _in_rings(q: blocks.Queries, ids: np.ndarray, vectors: np.ndarray, rings: Rings,
              place: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best rows of a tile: all at once if most rings are needed, else ring by ring."""
    step = max(1, blocks.PAIRS_AT_ONCE // len(rings.rows))
    wanted = np.concatenate([
        rings.bounds(metric, q.vectors[i: i + step])[0] <= _plain(metric, q.bounds[i: i + step])[:, None]
        for i in range(0, len(q.ids), step)])
    if wanted.mean() > MOSTLY:
        return blocks.nearest(q, ids, vectors, 0.0)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(rings.rows) + 1))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for ring in range(len(rings.rows)):
        asked, rows = np.flatnonzero(wanted[:, ring]), order[starts[ring]: starts[ring + 1]]
        if len(asked):
            qi, bi, dist = blocks.nearest(q.some(asked), ids[rows], vectors[rows], 0.0)
            found.append((asked[qi], rows[bi], dist))
    qi, bi, dist = (np.concatenate(c) for c in zip(*found))
    return blocks.best_of(q.ks, qi, ids[bi], bi, dist)


def sure(most: np.ndarray, rows: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """For each query the rings of least upper bound that together hold ``k`` rows."""
    order = np.argsort(most, axis=1, kind="stable")
    held = np.cumsum(rows[order], axis=1)
    wanted = (held - rows[order]) < np.asarray(ks)[:, None]
    out = np.zeros(most.shape, bool)
    np.put_along_axis(out, order, wanted, axis=1)
    return out


def _meet(visits: DataFrame, placed: DataFrame, table: DataFrame, block_rows: int) -> DataFrame:
    """Best rows of every visit, ring by ring in groups of bounded size on both sides."""
    groups = visits.groupBy("ring").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("q_parts"))
    layout = F.broadcast(table.join(groups, "ring"))
    kind = visits.schema["query_id"].dataType.simpleString()
    base_kind = placed.schema["vec_id"].dataType.simpleString()
    keys = ["ring", "qb", "bb"]
    zero = F.lit(0).cast("long")
    left = (visits.join(layout, "ring").withColumn("qb", F.pmod(F.xxhash64("query_id"), "q_parts"))
            .withColumn("bb", F.explode(F.sequence(zero, F.col("parts") - 1))))
    right = (placed.join(layout, "ring").withColumn("bb", F.pmod(F.xxhash64("vec_id"), "parts"))
             .withColumn("qb", F.explode(F.sequence(zero, F.col("q_parts") - 1))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", a.schema.field("query_id").type),
                         ("vec_id", b.schema.field("vec_id").type), ("distance", pa.float64())])
        if not len(a) or not len(b):
            return out.empty_table()
        q, ids = blocks.Queries.of(a), blocks.values(b["vec_id"])
        qi, bi, dist = blocks.nearest(q, ids, blocks.matrix(b["embedding"]), 0.0)
        return pa.table({"query_id": pa.array(q.ids[qi].tolist(), out.field(0).type),
                         "vec_id": pa.array(ids[bi].tolist(), out.field(1).type),
                         "distance": pa.array(dist)}, schema=out)

    return left.select(*visits.columns, "qb", "bb").groupBy(*keys).cogroup(
        right.select("vec_id", "embedding", *keys).groupBy(*keys)).applyInArrow(
        meet, f"query_id {kind}, vec_id {base_kind}, distance double")
