"""Nearest vectors between blocks of two vector tables.

Distances of one block against another are a matrix product; only each query's best ``k`` of a block
leave the task, so no stage ever holds or emits all pairs. Three ways to lay the blocks out:

* few queries (checked by size): the queries travel to the vectors, which are not shuffled;
* otherwise both sides are hashed into blocks of bounded size and every pair of blocks is a tile, a
  task of its own; blocks are as large as leaves enough tiles for all cores, so that rows are copied
  only as often as the bound on a task's memory needs;
* where only rows with a smaller id may meet a query, blocks are ranges of ids instead, and pairs
  with a later block of candidates are not built, which halves the copies.

A block is scanned in single precision with a bound on its rounding, against each query's running
k-th distance; only rows within it are measured in double precision.

A ``cell`` column restricts who meets whom. A cell with a third of all vectors, or one that every
query probes, becomes many blocks like any other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.functions.vectors import known_metric

BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 262_144
LEAST_ROWS, TILES_PER_CORE = 2048, 4
BROADCAST_ROWS = 4096
BROADCAST_BYTES = 64 << 20
PAIRS_AT_ONCE = 1 << 21
QUERIES_AT_ONCE, ROWS_AT_ONCE = 512, 4096
FEW_PAIRS = 1 << 14
SUM_ROWS = 32
#: Rounding of a single-precision number, and the largest value whose squares it holds with ease.
ROUNDING, LARGEST = 2.0 ** -24, 1e15


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a dense float64 matrix. Null vectors or components and vectors of different
    lengths have no distance and raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if not rows:
        return np.empty((0, 0))
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    odd = np.flatnonzero((lengths != lengths[0]) | (lengths < 0))
    if len(odd) or flat.null_count:
        raise ValueError(f"vectors must be complete and of one length: lengths {lengths[0]} and "
                         f"{lengths[odd[0]] if len(odd) else lengths[0]} (-1: null), "
                         f"{flat.null_count} null components")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A scalar column as an array that sorts: strings as unicode, numbers as they are."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.asarray(column.to_pylist(), dtype=str)
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(
        zero_copy_only=False)


def row_distance(metric: str, x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Distance of each row of ``x`` to the same row of ``y``."""
    if metric == "l2":
        return ((x - y) ** 2).sum(axis=1)
    if metric == "manhattan":
        return np.abs(x - y).sum(axis=1)
    product = (x * y).sum(axis=1)
    if metric == "dot":
        return -product
    lengths = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)) + eps
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(lengths == 0, np.nan, 1 - product / lengths)


def _block_distance(metric: str, q: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """All distances of a block up to rounding, from one matrix product where there is one."""
    if metric == "manhattan":
        out, other = np.zeros((len(q), len(b))), np.ascontiguousarray(b.T)
        for i in range(0, len(q), SUM_ROWS):
            part = out[i: i + SUM_ROWS]
            for d in range(q.shape[1]):
                part += np.abs(q[i: i + SUM_ROWS, d, None] - other[d])
        return out
    product = q @ b.T
    if metric == "dot":
        return -product
    q2, b2 = (q * q).sum(axis=1), (b * b).sum(axis=1)
    if metric == "l2":
        return q2[:, None] + b2[None, :] - 2 * product
    lengths = np.sqrt(q2)[:, None] * np.sqrt(b2)[None, :] + eps
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(lengths == 0, np.inf, 1 - product / lengths)


@dataclass
class Queries:
    """Query side of a block: ids, vectors, each query's own metric and k, and a distance beyond
    which it wants no row, if that is known."""

    ids: np.ndarray
    vectors: np.ndarray
    metrics: np.ndarray
    ks: np.ndarray
    bounds: np.ndarray | None = None

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch) -> Queries:
        return cls(
            values(table["query_id"]), matrix(table["q_vec"]), values(table["q_metric"]),
            values(table["q_k"]).astype(np.int64),
            values(table["bound"]) if "bound" in table.schema.names else None,
        )

    def some(self, at: np.ndarray) -> Queries:
        return Queries(self.ids[at], self.vectors[at], self.metrics[at], self.ks[at],
                       None if self.bounds is None else self.bounds[at])


def nearest(q: Queries, ids: np.ndarray, vectors: np.ndarray, eps: float,
            earlier: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``k`` nearest rows as (query position, row position, distance), ties by id.

    The scan only picks candidates, with some slack; the distances that decide are then computed
    pair by pair, so they do not depend on how rows were grouped into blocks. ``earlier`` admits
    only rows whose id is below the query's. Rows that the scan has no bound for (not finite, or
    without a direction) are compared apart.
    """
    found = []
    few = len(q.ids) * len(ids) <= FEW_PAIRS
    rows = np.arange(len(ids)) if few else _without_spare_copies(ids, vectors, q.ks.max(initial=0))
    for metric in np.unique(q.metrics):
        members = np.flatnonzero(q.metrics == metric)
        if few:
            found += _in_parts(q, members, metric, ids, vectors, eps, earlier, rows)
            continue
        asked_ok = bounded(metric, q.vectors[members], eps) & (q.ks[members] > 0)
        rows_ok = bounded(metric, vectors[rows], eps)
        if asked_ok.any() and rows_ok.any():
            found.append(_scanned(q, members[asked_ok], str(metric), ids, vectors, eps, earlier,
                                  rows[rows_ok]))
        found += _in_parts(q, members, metric, ids, vectors, eps, earlier, rows[~rows_ok])
        found += _in_parts(q, members[~asked_ok], metric, ids, vectors, eps, earlier, rows[rows_ok])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    qi, bi, dist = (np.concatenate(c) for c in zip(*found))
    return best_of(q.ks, qi, ids[bi], bi, dist)


def _in_parts(q, members, metric, ids, vectors, eps, earlier, rows) -> list:
    if not len(members) or not len(rows):
        return []
    step, out = max(1, PAIRS_AT_ONCE // len(rows)), []
    for start in range(0, len(members), step):
        qi, bi, dist = _nearest_part(q, members[start:start + step], metric, ids[rows],
                                     vectors[rows], eps, earlier)
        out.append((qi, rows[bi], dist))
    return out


def _without_spare_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Positions of all rows but those that ``k`` equal rows of smaller or equal id go before, which
    no query can have among its ``k``."""
    words = np.ascontiguousarray(vectors).view(np.uint64)
    odd = np.random.default_rng(1).integers(0, 1 << 63, words.shape[1], np.uint64) * 2 + 1
    digest = ((words ^ (words >> np.uint64(29))) * odd).sum(axis=1)
    order = np.lexsort((ids, digest))
    begins = np.concatenate([[True], np.diff(digest[order]) != 0]) if len(order) else np.empty(0, bool)
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    place = np.arange(len(order)) - np.repeat(starts, sizes)
    spare = place >= max(1, k)
    if not spare.any():
        return np.arange(len(ids))
    drop = np.zeros(len(ids), bool)
    for start, size in zip(starts[sizes > k], sizes[sizes > k]):
        run = order[start:start + size]
        if (vectors[run] == vectors[run[0]]).all():
            drop[run[max(1, k):]] = True
    return np.flatnonzero(~drop)


def bounded(metric: str, x: np.ndarray, eps: float) -> np.ndarray:
    """Rows for which the scan's rounding has a bound."""
    with np.errstate(invalid="ignore", over="ignore"):
        ok = (np.abs(x) < LARGEST).all(axis=1)
        if metric == "cosine":
            ok &= (x * x).sum(axis=1) > max(1e-30, eps * 1e6)
    return ok


def _scanned(q, members, metric, ids, vectors, eps, earlier, rows):
    """The nearest rows of a metric's queries, from a scan of ``rows`` and exact distances."""
    if earlier:
        rows = rows[np.argsort(ids[rows], kind="stable")]
        upto = np.searchsorted(ids[rows], q.ids[members], "left")
        order = np.argsort(upto, kind="stable")
        members, upto = members[order], upto[order]
    else:
        upto = None
    x, y, ks = q.vectors[members], vectors[rows], np.minimum(q.ks[members], len(rows))
    bounds = None if q.bounds is None else q.bounds[members]
    picked, best = [], []
    block, slack, start = _scan(metric, x, y, eps, int(ks.max()), bounds)
    for qi, bi in _survivors(block, slack, start, ks, len(rows), upto):
        dist = np.empty(len(qi))
        for begin in range(0, len(qi), 1 << 14):
            cut = slice(begin, begin + (1 << 14))
            dist[cut] = row_distance(metric, x[qi[cut]], y[bi[cut]], eps)
        a, b, c = best_of(ks, qi, ids[rows[bi]], bi, dist)
        if bounds is not None:
            within = c <= bounds[a]
            a, b, c = a[within], b[within], c[within]
        picked.append((members[a], rows[b]))
        best.append(c)
    if not picked:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return (np.concatenate([a for a, _ in picked]), np.concatenate([b for _, b in picked]),
            np.concatenate(best))


def _scan(metric: str, x: np.ndarray, y: np.ndarray, eps: float, k: int,
          bounds: np.ndarray | None) -> tuple[Callable, np.ndarray, np.ndarray]:
    """What orders the rows ``y`` for each query ``x``: a function of slices of both that gives a
    block of it, how far it may be off per query, and where it certainly ends for ``bounds``."""
    width, off = x.shape[1], 0.0
    upper = np.full(len(x), np.inf) if bounds is None else bounds
    if metric in ("l2", "manhattan"):
        centre = y.mean(axis=0)
        off = 1e-15 * width * max(np.abs(x).max(), np.abs(y).max())
        x, y = x - centre, y - centre
    if metric == "manhattan":
        return _manhattan_scan(x, y, k, upper, off)
    lengths, far = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    unit = (width + 16) * ROUNDING
    if metric == "l2":
        a = np.concatenate([-2 * x, np.ones((len(x), 1))], axis=1)
        b = np.concatenate([y, (far * far)[:, None]], axis=1)
        slack = (unit + off) * (2 * lengths + far.max()) * far.max() + off * (lengths + far.max())
        start = upper - lengths * lengths + ROUNDING * lengths * lengths
    elif metric == "dot":
        a, b, slack, start = -x, y, unit * lengths * far.max(), upper
    else:
        a, b = -x / lengths[:, None], y / far[:, None]
        slack, start = unit + eps / (lengths * far.min()), upper - 1
    a, b = a.astype(np.float32), np.ascontiguousarray(b.T.astype(np.float32))

    def block(some: slice, rows: slice) -> np.ndarray:
        return a[some] @ b[:, rows]

    return block, slack + 1e-36, start


def _manhattan_scan(x, y, k, upper, off):
    """Sums of absolute differences, in steps of 16-bit whole numbers where those are fine enough to tell
    the nearest apart."""
    width, low = x.shape[1], min(x.min(), y.min())
    span = max(x.max(), y.max()) - low
    most = 32_000 // width
    scale = most / span if 1e-30 < span < np.inf else 0.0
    kind, slack = np.float32, None
    if scale and most >= 16:
        a, b = np.rint((x - low) * scale), np.rint((y - low) * scale)
        rounded = np.abs((y - low) * scale - b).sum(axis=1).max()
        slack = np.abs((x - low) * scale - a).sum(axis=1) + rounded + 1 + 2 * off * width * scale
        some = _block_distance("manhattan", x[:: max(1, len(x) // 32)], y[:4096], 0.0)
        edge = np.partition(some, min(k, some.shape[1]) - 1, axis=1)[:, min(k, some.shape[1]) - 1]
        if np.median(slack) < 0.1 * np.median(edge) * scale:
            kind = np.int16
    if kind is np.float32:
        a, b, scale = x - low, y - low, 1.0
        slack = 4 * (width + 16) * ROUNDING * (a.sum(axis=1) + b.sum(axis=1).max()) + 2 * off * width + 1e-36
    a, b = a.astype(kind), np.ascontiguousarray(b.T.astype(kind))

    def block(some: slice, rows: slice) -> np.ndarray:
        part, other = a[some], b[:, rows]
        total = np.zeros((len(part), other.shape[1]), kind)
        step = np.empty((SUM_ROWS, other.shape[1]), kind)
        for i in range(0, len(part), SUM_ROWS):
            out = total[i: i + SUM_ROWS]
            one = step[: len(out)]
            for d in range(width):
                np.subtract(other[d], part[i: i + SUM_ROWS, d, None], out=one)
                np.abs(one, out=one)
                np.add(out, one, out=out)
        return total

    return block, slack, upper * scale


def _survivors(block: Callable, slack: np.ndarray, start: np.ndarray, ks: np.ndarray, rows: int,
               upto: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (query, row) of all rows that may be among the ``ks`` nearest, some queries at a
    time. ``upto`` bounds the rows of each query; it does not fall."""
    for i in range(0, len(ks), QUERIES_AT_ONCE):
        some = slice(i, min(len(ks), i + QUERIES_AT_ONCE))
        k, twice = ks[some], 2 * slack[some]
        limit, own = start[some] + slack[some], None if upto is None else upto[some]
        end, due = rows if upto is None else int(own.max()), ROWS_AT_ONCE
        held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for j in range(0, end, ROWS_AT_ONCE):
            near = block(some, slice(j, min(end, j + ROWS_AT_ONCE)))
            if not j:
                limit = np.minimum(limit, _edge(near, k, own) + twice)
            at = np.flatnonzero(near <= _no_smaller(limit, near.dtype)[:, None])
            qi, bi = np.divmod(at, near.shape[1])
            value = near.ravel()[at].astype(np.float64)
            bi += j
            if own is not None:
                fit = bi < own[qi]
                qi, bi, value = qi[fit], bi[fit], value[fit]
            held.append((qi, bi, value))
            if j + ROWS_AT_ONCE >= min(due, end):
                due *= 2
                qi, bi, value = (np.concatenate(c) for c in zip(*held))
                order = np.lexsort((value, qi))
                qi, bi, value = qi[order], bi[order], value[order]
                first, last = (np.searchsorted(qi, np.arange(len(k)), side) for side in ("left", "right"))
                full = np.flatnonzero(last - first >= k)
                limit[full] = np.minimum(limit[full], value[first[full] + k[full] - 1] + twice[full])
                fit = value <= limit[qi]
                held = [(qi[fit], bi[fit], value[fit])]
        qi, bi, _ = held[0]
        yield qi + i, bi


def _edge(near: np.ndarray, k: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """The k-th smallest value of each row of a block; infinite where there are fewer."""
    most, out = min(int(k.max()), near.shape[1]), np.full(len(k), np.inf)
    if own is not None and own.min() < near.shape[1]:
        largest = np.inf if near.dtype.kind == "f" else np.iinfo(near.dtype).max
        near = np.where(np.arange(near.shape[1]) < own[:, None], near, near.dtype.type(largest))
    first = np.sort(np.partition(near, most - 1, axis=1)[:, :most], axis=1)
    enough = np.flatnonzero(k <= (near.shape[1] if own is None else np.minimum(own, near.shape[1])))
    out[enough] = first[enough, k[enough] - 1]
    return out


def _no_smaller(limit: np.ndarray, kind: np.dtype) -> np.ndarray:
    if kind.kind == "i":
        return np.clip(np.ceil(limit), np.iinfo(kind).min, np.iinfo(kind).max).astype(kind)
    return np.nextafter(limit.astype(kind), kind.type(np.inf))


def _nearest_part(q, part, metric, ids, vectors, eps, earlier):
    x = q.vectors[part]
    near = _block_distance(metric, x, vectors, eps)
    near[np.isnan(near)] = np.inf
    allowed = ids[None, :] < q.ids[part][:, None] if earlier else None
    if earlier:
        near[~allowed] = np.inf
    k = int(min(q.ks[part].max(initial=0), len(ids)))
    if k <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    edge = np.partition(near, k - 1, axis=1)[:, k - 1]
    scale = 1 + (x * x).sum(axis=1).max(initial=0) + (vectors * vectors).sum(axis=1).max(initial=0)
    keep = near <= (edge + 1e-9 * scale)[:, None]
    if earlier:
        keep &= allowed
    qi, bi = np.nonzero(keep)
    dist = np.empty(len(qi))
    for start in range(0, len(qi), 1 << 16):
        cut = slice(start, start + (1 << 16))
        dist[cut] = row_distance(metric, x[qi[cut]], vectors[bi[cut]], eps)
    return part[qi], bi, dist


def best_of(ks: np.ndarray, qi: np.ndarray, ids: np.ndarray, row: np.ndarray,
            dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of every query by (distance, id)."""
    order = np.lexsort((ids, dist, qi))
    qi, row, dist = qi[order], row[order], dist[order]
    first = np.searchsorted(qi, qi, side="left")
    keep = np.arange(len(qi)) - first < ks[qi]
    return qi[keep], row[keep], dist[keep]


def query_side(queries: DataFrame, query_id: str, vector: str, metric: str | Column,
               k: int | Column) -> DataFrame:
    """Queries in the columns the block operators use.

    A metric given by name must be known; one given per row falls back to ``l2``.
    """
    if isinstance(metric, str):
        if metric not in C.METRICS:
            raise ValueError(f"Unknown distance metric: {metric}")
        metric = F.lit(metric)
    else:
        metric = known_metric(metric)
    k = F.lit(k) if isinstance(k, int) else k
    return queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("q_vec"),
                          metric.alias("q_metric"), k.cast("int").alias("q_k"))


def small_enough(df: DataFrame, rows: int, size: int) -> tuple[pa.Table | None, bool]:
    """The whole table if it has at most ``rows`` rows and ``size`` bytes, counted before anything
    is fetched."""
    def width(field) -> Column:
        kind = field.dataType.typeName()
        length = {"array": F.size(F.col(field.name)) * 8, "string": F.octet_length(field.name)}
        return F.coalesce(length.get(kind, F.lit(8)), F.lit(0)).cast("bigint")

    total = reduce(lambda x, y: x + y, [width(f) for f in df.schema])
    n, held = df.select(total.alias("w")).limit(rows + 1).agg(
        F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0))).first()
    fits = n <= rows and held <= size
    return (df.toArrow() if fits else None), fits


def block_rows_for(width: int) -> int:
    """Rows of a block: large, as each side is sent once per block of the other, but bounded."""
    return max(256, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width))))


def rows_of_tile(spark, q_rows: int, b_rows: int, width: int, block_rows: int | None,
                 halves: int = 1) -> int:
    """Rows of a block on either side: as many as leave a few tiles for each core, at least
    ``block_rows``, at most what a task holds. Every row is copied once per block of the other side, so
    blocks that are smaller than that cost disk and save nothing. ``halves`` is 2 where only half of
    the tiles are met."""
    tiles = TILES_PER_CORE * halves * spark.sparkContext.defaultParallelism
    even = math.ceil(math.sqrt(q_rows * b_rows / tiles))
    most = max(block_rows_for(width), block_rows or 0)
    return min(most, max(block_rows or LEAST_ROWS, even))


def in_tiles(left: DataFrame, right: DataFrame, tiles: int,
             meet: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``meet(tile, rows of left, rows of right)`` for every tile; a tile is a task of its own.

    Both sides have a column ``tile`` (0 .. tiles - 1) and otherwise columns of different names.
    """
    names = [left.columns, right.columns]
    both = left.withColumn("_left", F.lit(True)).unionByName(
        right.withColumn("_left", F.lit(False)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [], []
        for batch in batches:
            here = batch["_left"]
            for rows, columns, mine in zip(sides, names, (here, pa.compute.invert(here))):
                rows.append(batch.select(columns).filter(mine))
        if not sides[0]:
            return
        a, b = (pa.Table.from_batches(rows).combine_chunks() for rows in sides)
        for tile in np.intersect1d(a["tile"].to_numpy(), b["tile"].to_numpy()):
            one, other = (t.filter(pa.compute.equal(t["tile"], pa.scalar(tile, t["tile"].type)))
                          for t in (a, b))
            yield from meet(int(tile), one, other).to_batches()

    return both.repartitionById(tiles, F.col("tile").cast("int")).mapInArrow(run, schema)


def all_tiles(queries: DataFrame, base: DataFrame, q_rows: int, b_rows: int, width: int, eps: float,
              block_rows: int | None, earlier: bool = False) -> DataFrame:
    """``(query_id, vec_id, distance)``: best ``k`` per query and block of base(vec_id, embedding)."""
    size = rows_of_tile(queries.sparkSession, q_rows, b_rows, width, block_rows)
    q_parts, b_parts = max(1, -(-q_rows // size)), max(1, -(-b_rows // size))
    kinds = [queries.schema["query_id"].dataType.simpleString(),
             base.schema["vec_id"].dataType.simpleString()]

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def of(column: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")

    left = queries.withColumn("_other", every(b_parts)).withColumn(
        "tile", of("query_id", q_parts) * b_parts + F.col("_other")).drop("_other")
    right = base.select("vec_id", "embedding").withColumn("_other", every(q_parts)).withColumn(
        "tile", F.col("_other") * b_parts + of("vec_id", b_parts)).drop("_other")
    return in_tiles(left, right, q_parts * b_parts,
                    lambda _, a, b: nearest_rows(a, b, eps, earlier),
                    f"query_id {kinds[0]}, vec_id {kinds[1]}, distance double")


def nearest_rows(a: pa.Table, b: pa.Table, eps: float, earlier: bool) -> pa.Table:
    """The best of ``nearest`` between the tables of a tile."""
    q, ids = Queries.of(a), values(b["vec_id"])
    qi, bi, dist = nearest(q, ids, matrix(b["embedding"]), eps, earlier)
    return pa.table({"query_id": a["query_id"].take(pa.array(qi)),
                     "vec_id": b["vec_id"].take(pa.array(bi)), "distance": pa.array(dist)})


def pair_distances(pairs: DataFrame, eps: float = 0.0) -> DataFrame:
    """``(metric, query_id, vec_id, distance)`` for rows with ``q_vec`` and ``embedding`` joined."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            metrics = values(batch["metric"])
            for metric in np.unique(metrics):
                rows = batch.take(pa.array(np.flatnonzero(metrics == metric)))
                yield pa.record_batch({
                    "metric": rows["metric"], "query_id": rows["query_id"],
                    "vec_id": rows["vec_id"],
                    "distance": row_distance(str(metric), matrix(rows["q_vec"]),
                                             matrix(rows["embedding"]), eps)})

    types = {c: pairs.schema[c].dataType.simpleString() for c in ("query_id", "vec_id")}
    return pairs.select("metric", "query_id", "vec_id", "q_vec", "embedding").mapInArrow(
        scan, f"metric string, query_id {types['query_id']}, vec_id {types['vec_id']}, "
              "distance double")


def against_broadcast(table: pa.Table, base: DataFrame, eps: float, earlier: bool,
                      query_type: str) -> DataFrame:
    """Best ``k`` per query and partition of ``base(vec_id, embedding)``; nothing is shuffled."""
    spark = base.sparkSession
    base_type = base.schema["vec_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(Queries.of(table))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qi, ids, dist = shared.value, np.empty(0, np.int64), None, np.empty(0)
        for batch in batches:
            if not len(batch) or not len(q.ids):
                continue
            here = values(batch["vec_id"])
            a, b, c = nearest(q, here, matrix(batch["embedding"]), eps, earlier)
            qi, dist = np.concatenate([qi, a]), np.concatenate([dist, c])
            ids = here[b] if ids is None else np.concatenate([ids, here[b]])
            qi, pick, dist = best_of(q.ks, qi, ids, np.arange(len(qi)), dist)
            ids = ids[pick]
        if ids is not None:
            yield pa.record_batch({"query_id": pa.array(q.ids[qi].tolist()),
                                   "vec_id": pa.array(ids.tolist()), "distance": dist})

    return base.select("vec_id", "embedding").mapInArrow(
        scan, f"query_id {query_type}, vec_id {base_type}, distance double")


def _layout(sizes: DataFrame, block_rows: int) -> DataFrame:
    """Blocks per cell on each side, from the row counts in ``sizes(cell, q_rows, b_rows)``."""
    def parts(rows):
        return F.greatest(F.lit(1), F.ceil(F.col(rows) / F.lit(block_rows))).cast("bigint")
    return sizes.select("cell", parts("q_rows").alias("q_parts"), parts("b_rows").alias("b_parts"))


def block_grid(queries: DataFrame, base: DataFrame, sizes: DataFrame, eps: float,
               block_rows: int, earlier: bool = False) -> DataFrame:
    """``(query_id, cell, vec_id, distance)``: best ``k`` per query and pair of blocks of a cell.

    ``sizes`` has one row per cell of a list that the caller holds on the driver, so it is small
    enough to send to every task; joining by cell instead would put a hot cell into one.
    """
    layout = F.broadcast(_layout(sizes, block_rows))
    query_type = queries.schema["query_id"].dataType.simpleString()
    base_type = base.schema["vec_id"].dataType.simpleString()
    keys = ["cell", "qb", "bb"]
    left = (queries.join(layout, "cell")
            .withColumn("qb", F.pmod(F.xxhash64("query_id"), "q_parts"))
            .withColumn("bb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b_parts") - 1)))
            .drop("q_parts", "b_parts"))
    right = (base.select("vec_id", "embedding", "cell").join(layout, "cell")
             .withColumn("bb", F.pmod(F.xxhash64("vec_id"), "b_parts"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("q_parts") - 1)))
             .drop("q_parts", "b_parts"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", a.schema.field("query_id").type), ("cell", pa.int32()),
                            ("vec_id", b.schema.field("vec_id").type), ("distance", pa.float64())])
        if not len(a) or not len(b):
            return schema.empty_table()
        q, ids = Queries.of(a), values(b["vec_id"])
        qi, bi, dist = nearest(q, ids, matrix(b["embedding"]), eps, earlier)
        return pa.table({
            "query_id": pa.array(q.ids[qi].tolist(), schema.field("query_id").type),
            "cell": pa.array(np.full(len(qi), a["cell"][0].as_py(), np.int32)),
            "vec_id": pa.array(ids[bi].tolist(), schema.field("vec_id").type),
            "distance": pa.array(dist)}, schema=schema)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        meet, f"query_id {query_type}, cell int, vec_id {base_type}, distance double")


def earlier_grid(queries: DataFrame, base: DataFrame, eps: float, block_rows: int,
                 rows: int) -> DataFrame:
    """``(query_id, vec_id, distance)``: best ``k`` per query and block among rows of ``base`` with a
    smaller id. Ids are whole numbers; equal ids are in one block. ``rows`` is the count of ``base``.
    A pair of blocks is a tile.
    """
    parts = max(1, -(-rows // block_rows))
    shares = [i / parts for i in range(1, parts)]
    cuts = base.agg(F.percentile_approx("vec_id", shares, 100 * parts)).first()[0] if shares else []
    limits = np.unique(np.array(cuts or [], np.int64))
    last = len(limits)
    query_type = queries.schema["query_id"].dataType.simpleString()
    base_type = base.schema["vec_id"].dataType.simpleString()

    def with_block(df: DataFrame, key: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block = np.searchsorted(limits, values(batch[key]), "left")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)],
                                                 [*batch.schema.names, "block"])

        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(run, f"{shape}, block long")

    below = F.sequence(F.lit(0).cast("long"), F.col("block"))
    above = F.sequence(F.col("block"), F.lit(last).cast("long"))
    tile = (F.col("qb") * (F.col("qb") + 1) / 2 + F.col("bb")).cast("int")
    left = with_block(queries, "query_id").withColumn("bb", F.explode(below)).withColumnRenamed(
        "block", "qb").withColumn("tile", tile).drop("qb", "bb")
    right = with_block(base.select("vec_id", "embedding"), "vec_id").withColumn(
        "qb", F.explode(above)).withColumnRenamed("block", "bb").withColumn("tile", tile).drop(
        "qb", "bb")
    return in_tiles(left, right, (last + 1) * (last + 2) // 2,
                    lambda _, a, b: nearest_rows(a, b, eps, True),
                    f"query_id {query_type}, vec_id {base_type}, distance double")
