"""Inverted-cell search: probe the nearest cells, keep the best of each, then the best of all."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.operators import blocks, kmeans
from quillon.operators.neighbours import best_per_query


@dataclass
class Index:
    """Vectors with their cell, and the means and sizes of the non-empty cells."""

    metric: str
    members: DataFrame  # vec_id, embedding, cell
    cells: np.ndarray
    means: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, vectors: DataFrame, model: kmeans.Model) -> Index:
        numbers = np.array(sorted(model.means))
        members = kmeans.assign(vectors.select("vec_id", "embedding"), model.centroids,
                                model.fit.metric, "cell").drop("cell_distance")
        return cls(model.fit.metric, members, numbers,
                   np.stack([model.means[c] for c in numbers]),
                   np.array([model.sizes[c] for c in numbers]))

    def save(self, path: str, block_rows: int = 1_000_000) -> None:
        """Members partitioned by cell, big cells over several files; centroids beside them."""
        spark = self.members.sparkSession
        table = spark.createDataFrame(
            [(int(c), int(n), m.tolist()) for c, n, m in zip(self.cells, self.sizes, self.means)],
            "cell int, n bigint, centroid array<double>")
        files = F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows))
        (self.members.join(table.select("cell", "n"), "cell")
         .withColumn("file", F.pmod(F.xxhash64("vec_id"), files)).drop("n")
         .repartition("cell", "file").drop("file")
         .write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/members"))
        table.withColumn("metric", F.lit(self.metric)).coalesce(1).write.parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
        members = spark.read.parquet(f"{path}/members")
        return cls(rows["metric"][0].as_py(), members, np.asarray(rows["cell"].to_pylist()),
                   blocks.matrix(rows["centroid"]), np.asarray(rows["n"].to_pylist()))


def probes(queries: DataFrame, index: Index, nprobe: int) -> DataFrame:
    """Queries repeated once per probed cell; never more probes than there are cells."""
    shared = queries.sparkSession.sparkContext.broadcast(
        (index.metric, index.means, index.cells.astype(np.int32), min(nprobe, len(index.cells))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metric, means, cells, n = shared.value
        for batch in batches:
            if len(batch):
                row, cell, _ = kmeans.closest(blocks.matrix(batch["q_vec"]), means, metric, n)
                yield batch.take(pa.array(row)).append_column("cell", pa.array(cells[cell]))

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(scan, f"{columns}, cell int")


def search(queries: DataFrame, index: Index, k: int = 10, nprobe: int = C.IVF_PROBES,
           per_cell: int | None = C.IVF_PER_CELL, query_id: str = "query_id",
           query_vector: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, distance)`` of the best ``k`` among the probed cells.

    ``per_cell`` keeps that many of a cell before the merge; it matters only below ``k``.
    """
    kept = k if per_cell is None else min(k, per_cell)
    asked = probes(blocks.query_side(queries, query_id, query_vector, index.metric, kept),
                   index, nprobe)
    counts = asked.groupBy("cell").agg(F.count("*").alias("q_rows"))
    known = queries.sparkSession.createDataFrame(
        [(int(c), int(n)) for c, n in zip(index.cells, index.sizes)], "cell int, b_rows bigint")
    candidates = blocks.block_grid(
        asked, index.members, counts.join(F.broadcast(known), "cell"), 0.0,
        block_rows or blocks.block_rows_for(index.means.shape[1]))
    if kept < k:
        candidates = best_per_query(candidates, kept, ("query_id", "cell")).drop("rank")
    return best_per_query(candidates, k).select("query_id", "rank", "vec_id", "distance")


def ivf(vectors: DataFrame, metric: str = "l2", cells: int = C.IVF_CELLS, **fit_options) -> Index:
    """Fit the cells and assign every vector to one."""
    return Index.of(vectors, kmeans.fit(vectors, cells, metric, **fit_options))


def single_probe(vectors: DataFrame, metric: str = "l2", cells: int = C.SINGLE_PROBE_CELLS,
                 **fit_options) -> Index:
    return ivf(vectors, metric, cells, **fit_options)
