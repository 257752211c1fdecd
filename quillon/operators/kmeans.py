"""k-means under any of the four metrics, many fits sharing each scan.

An iteration is one pass: every task adds up its rows per cell and sends ``cells x dimensions``
numbers on. Centroids stay on the driver, which is bounded by that product; the vectors never move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.operators.blocks import ROUNDING, Queries, bounded, matrix, nearest, row_distance

COLLECT_BYTES = 64 << 20
CENTROID_BYTES = 256 << 20
#: Vectors that are compared with all centroids at once.
ROWS_AT_ONCE = 1024


@dataclass(frozen=True)
class Fit:
    """What to fit. ``convergence`` is ``centroid`` (all shifts below tol) or ``cluster``."""

    cells: int
    metric: str = "l2"
    max_iters: int = 100
    tol: float = 1e-4
    convergence: str = "centroid"


@dataclass
class Model:
    """``centroids`` gave the final assignment; ``means`` are the means of its non-empty cells."""

    fit: Fit
    centroids: np.ndarray
    means: dict[int, np.ndarray] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)
    iterations: int = 0


def closest(vectors: np.ndarray, centroids: np.ndarray, metric: str, k: int = 1,
            eps: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centroid, distance) of each row's ``k`` nearest centroids, ties to the lowest number."""
    n = len(vectors)
    if k == 1 and n and len(centroids):
        cell = closest_one(vectors, centroids, metric, eps)
        return np.arange(n), cell, row_distance(metric, vectors, centroids[cell], eps)
    asked = Queries(np.arange(n), vectors, np.full(n, metric), np.full(n, k))
    return nearest(asked, np.arange(len(centroids)), centroids, eps)


def closest_one(vectors: np.ndarray, centroids: np.ndarray, metric: str,
                eps: float = 0.0) -> np.ndarray:
    """Number of each row's nearest centroid. Single precision settles the rows whose nearest stands
    out by more than its rounding; the others are compared in double precision."""
    out, kept = np.full(len(vectors), -1), np.unique(centroids, axis=0, return_index=True)[1]
    kept.sort()  # of equal centroids the first
    rows = np.flatnonzero(bounded(metric, vectors, eps))
    if len(rows) and bounded(metric, centroids, eps).all():
        for i in range(0, len(rows), ROWS_AT_ONCE):
            some = rows[i: i + ROWS_AT_ONCE]
            near, slack = _to_centroids(vectors[some], centroids[kept], metric, eps)
            cell = near.argmin(axis=0)
            edge = near[cell, np.arange(len(some))] + 2 * slack
            alone = np.count_nonzero(near <= edge, axis=0) == 1
            out[some[alone]] = kept[cell[alone]]
    left = np.flatnonzero(out < 0)
    if len(left):
        asked = Queries(np.arange(len(left)), vectors[left], np.full(len(left), metric),
                        np.ones(len(left), np.int64))
        row, cell, _ = nearest(asked, np.arange(len(centroids)), centroids, eps)
        out[left[row]] = cell
    return out


def _to_centroids(x: np.ndarray, centroids: np.ndarray, metric: str,
                  eps: float) -> tuple[np.ndarray, np.ndarray]:
    """What orders the centroids of each row, as (centroid, row), and how far it may be off per row."""
    unit = 4 * (x.shape[1] + 16) * ROUNDING
    if metric == "manhattan":
        a, b = np.ascontiguousarray(x.T, np.float32), centroids.astype(np.float32)
        near, step = np.zeros((len(b), len(x)), np.float32), np.empty((len(b), len(x)), np.float32)
        for d in range(len(a)):
            np.subtract(a[d], b[:, d, None], out=step)
            np.abs(step, out=step)
            near += step
        return near, unit * (np.abs(x).sum(axis=1) + np.abs(centroids).sum(axis=1).max()) + 1e-36
    lengths, far = np.sqrt((x * x).sum(axis=1)), np.sqrt((centroids * centroids).sum(axis=1))
    if metric == "l2":
        near = centroids.astype(np.float32) @ (-2 * x.T).astype(np.float32)
        near += (far * far).astype(np.float32)[:, None]
        return near, unit * (2 * lengths + far.max()) * far.max() + 1e-36
    if metric == "dot":
        return -centroids.astype(np.float32) @ x.T.astype(np.float32), unit * lengths * far.max() + 1e-36
    near = (-centroids / far[:, None]).astype(np.float32) @ (x / lengths[:, None]).T.astype(np.float32)
    return near, unit + eps / (lengths * far.min()) + 1e-36


def hashed_order(vec_id: str = "vec_id"):
    """Order that seeds are taken in: a multiplicative hash of the id."""
    return (F.pmod(F.col(vec_id), F.lit(1 << 31)) * F.lit(2654435761)) % F.lit(1 << 32)


def seeds(vectors: DataFrame, cells: int) -> np.ndarray:
    rows = (vectors.orderBy(hashed_order(), "vec_id").limit(cells).select("embedding").toArrow())
    found = matrix(rows["embedding"])
    if found.nbytes > CENTROID_BYTES:
        raise ValueError("centroids too large to share with every task")
    return found


def assign(vectors: DataFrame, centroids: np.ndarray, metric: str, out: str = "cluster_id") -> DataFrame:
    """``vectors`` plus the number of the nearest centroid and the distance to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                _, cell, dist = closest(matrix(batch["embedding"]), shared.value, metric)
                yield batch.append_column(out, pa.array(cell.astype(np.int32))).append_column(
                    "cell_distance", pa.array(dist))

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(scan, f"{columns}, {out} int, cell_distance double")


_PARTIAL = "fit int, cell int, n bigint, changed bigint, sums array<double>"


def _pass(vectors: DataFrame, plans: dict[int, tuple[str, np.ndarray, np.ndarray | None]]) -> DataFrame:
    """Per task, fit and cell: row count, rows that changed cell, and the vector sum."""
    shared = vectors.sparkSession.sparkContext.broadcast(plans)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared.value
        state = {i: [np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(c.shape)]
                 for i, (_, c, _) in plans.items()}
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch["embedding"])
            for i, (metric, now, before) in plans.items():
                counts, changed, sums = state[i]
                cell = closest_one(x, now, metric)
                moved = (np.ones(len(x), bool) if before is None
                         else closest_one(x, before, metric) != cell)
                here = np.bincount(cell, minlength=len(now))
                counts += here
                changed += np.bincount(cell[moved], minlength=len(now))
                order, used = np.argsort(cell, kind="stable"), np.flatnonzero(here)
                sums[used] += np.add.reduceat(x[order], (np.cumsum(here) - here)[used], axis=0)
        for i, (counts, changed, sums) in state.items():
            used = np.flatnonzero(counts)
            yield pa.record_batch({
                "fit": pa.array(np.full(len(used), i, np.int32)),
                "cell": pa.array(used.astype(np.int32)),
                "n": pa.array(counts[used]), "changed": pa.array(changed[used]),
                "sums": pa.array(list(sums[used]), pa.list_(pa.float64()))})

    return vectors.select("embedding").mapInArrow(scan, _PARTIAL)


def _combined(partials: DataFrame, size: int, tasks: int) -> pa.Table:
    """Partial sums added up: on the driver if they are few, else per cell on the executors."""
    if size * tasks > COLLECT_BYTES:
        def add(table: pa.Table) -> pa.Table:
            return _added(table)
        partials = partials.groupBy("fit", "cell").applyInArrow(add, _PARTIAL)
    return _added(partials.toArrow())


def _added(table: pa.Table) -> pa.Table:
    totals: dict[tuple[int, int], list] = {}
    if len(table):
        sums = matrix(table["sums"])
        for row, (f, c, n, m) in enumerate(zip(*(table[x].to_pylist()
                                                 for x in ("fit", "cell", "n", "changed")))):
            have = totals.setdefault((f, c), [0, 0, np.zeros(sums.shape[1])])
            have[0] += n
            have[1] += m
            have[2] = have[2] + sums[row]
    return pa.table({
        "fit": pa.array([k[0] for k in totals], pa.int32()),
        "cell": pa.array([k[1] for k in totals], pa.int32()),
        "n": pa.array([v[0] for v in totals.values()], pa.int64()),
        "changed": pa.array([v[1] for v in totals.values()], pa.int64()),
        "sums": pa.array([v[2] for v in totals.values()], pa.list_(pa.float64()))})


def fit_many(vectors: DataFrame, fits: list[Fit]) -> list[Model]:
    """Fit every ``Fit`` over ``vectors(vec_id, embedding)``, one shared scan per iteration."""
    for fit in fits:
        if fit.metric not in C.METRICS:
            raise ValueError(f"Unknown distance metric: {fit.metric}")
    data = vectors.select("vec_id", "embedding").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        start = {k: seeds(data, k) for k in {f.cells for f in fits}}
        models = [Model(f, start[f.cells]) for f in fits]
        before: list[np.ndarray | None] = [None] * len(fits)
        tasks = data.rdd.getNumPartitions()
        active = set(range(len(fits)))
        while active:
            plans = {i: (fits[i].metric, models[i].centroids,
                         before[i] if fits[i].convergence == "cluster" else None) for i in active}
            size = sum(p[1].nbytes for p in plans.values())
            sums = _combined(_pass(data, plans), size, tasks).to_pylist()
            for i in sorted(active):
                _advance(models, before, i, [r for r in sums if r["fit"] == i], active)
        return models
    finally:
        data.unpersist()


def _advance(models, before, i, rows, active) -> None:
    model, fit = models[i], models[i].fit
    model.iterations += 1
    model.sizes = {r["cell"]: r["n"] for r in rows}
    model.means = {r["cell"]: np.asarray(r["sums"]) / r["n"] for r in rows}
    moved = model.centroids.copy()
    for cell, mean in model.means.items():
        moved[cell] = mean
    if fit.convergence == "centroid":
        done = bool((np.linalg.norm(moved - model.centroids, axis=1) < fit.tol).all())
    else:
        done = before[i] is not None and not any(r["changed"] for r in rows)
    if done or model.iterations >= fit.max_iters:
        active.discard(i)
        return
    before[i] = model.centroids
    model.centroids = moved


def fit(vectors: DataFrame, cells: int, metric: str = "l2", **options) -> Model:
    return fit_many(vectors, [Fit(cells, metric, **options)])[0]
