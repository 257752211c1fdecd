"""Vector search over the whole embedding table: every vector is a query and a candidate."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.functions import vectors as V
from quillon.operators import graph, ivf, kmeans
from quillon.operators.neighbours import knn
from quillon.operators.recall import recall_table
from quillon.session import checkpoint_dir, written
from quillon.sources.tables import read

CELLS_SHOWN = 10
#: Queries of all metrics together that still travel to the vectors; their bytes are checked too.
QUERIES_SHARED = 16_384


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select("vec_id", "embedding")


def as_queries(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("vec_id", "query_id")


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", V.rounded(F.col("distance")))


def dist_all_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector against the mean of its label, under all distances."""
    table = read(spark, folder, "embeddings")
    means = V.mean_vectors(table, "label", "embedding", "center").drop("n")
    a, b = F.col("embedding"), F.col("center")
    columns = {"l2sq": V.l2sq(a, b), "l2": V.l2(a, b), "cosine": V.cosine(a, b),
               "cosine_eps": V.cosine(a, b, C.RETRIEVAL_EPS), "neg_dot": V.neg_dot(a, b),
               "manhattan": V.manhattan(a, b), "norm": V.norm(a)}
    return table.join(means, "label").select(
        "vec_id", *[V.rounded(c).alias(n) for n, c in columns.items()])


def knn_by(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        table = vectors(spark, folder)
        return shown(knn(as_queries(table), table, 10, metric))

    return run


def knn_large(metric: str, rows: int) -> Callable[[SparkSession, str], DataFrame]:
    """The plan for tables beyond the broadcast: blocks of ``rows`` vectors, skipped by bounds."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        table = vectors(spark, folder)
        return shown(knn(as_queries(table), table, 10, metric, broadcast_rows=0, block_rows=rows))

    return run


def graph_edges_large(spark: SparkSession, folder: str) -> DataFrame:
    """The edges from blocks of id ranges, as tables beyond the broadcast get them."""
    return shown(graph.edges(vectors(spark, folder), broadcast_rows=0, block_rows=64))


def knn_mixed_metric(spark: SparkSession, folder: str) -> DataFrame:
    """Each query with its own metric and number of results, as requests carry them."""
    table = read(spark, folder, "embeddings")
    names = F.array(*[F.lit(m) for m in [*C.METRICS, "euclid"]])
    asked = table.select(F.col("vec_id").alias("query_id"), "embedding",
                         F.get(names, F.col("label") % 5).alias("metric"),
                         (F.col("label") + 1).alias("k"))
    return shown(knn(asked, table, C.MAX_K, F.col("metric"), C.RETRIEVAL_EPS, F.col("k")))


def _exploded(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("position", "v")).select(
        key, "position", V.rounded(F.col("v")).alias("value"))


def kmeans_assign_step(spark: SparkSession, folder: str) -> DataFrame:
    table = vectors(spark, folder)
    assigned = kmeans.assign(table, kmeans.seeds(table, CELLS_SHOWN), "l2")
    return assigned.select("vec_id", "cluster_id",
                           V.rounded(F.col("cell_distance")).alias("distance"))


def kmeans_update_step(spark: SparkSession, folder: str) -> DataFrame:
    table = vectors(spark, folder)
    assigned = kmeans.assign(table, kmeans.seeds(table, CELLS_SHOWN), "l2")
    return _exploded(V.mean_vectors(assigned, "cluster_id", "embedding"), "cluster_id", "mean")


def kmeans_l2(spark: SparkSession, folder: str) -> DataFrame:
    table = vectors(spark, folder)
    model = kmeans.fit(table, CELLS_SHOWN, "l2")
    return kmeans.assign(table, model.centroids, "l2").select("vec_id", "cluster_id")


def kmeans_cluster_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Cells fitted until no vector changes its cell."""
    table = vectors(spark, folder)
    model = kmeans.fit(table, CELLS_SHOWN, "l2", convergence="cluster")
    return kmeans.assign(table, model.centroids, "l2").select("vec_id", "cluster_id")


def ivf_search_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Search in an index that was fitted once, saved and loaded."""
    table = vectors(spark, folder)
    path = f"{checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    ivf.ivf(table, "l2").save(path)
    return shown(ivf.search(as_queries(table), ivf.Index.load(spark, path)))


def ivf_search(spark: SparkSession, folder: str) -> DataFrame:
    table = vectors(spark, folder)
    return shown(ivf.search(as_queries(table), ivf.ivf(table, "l2")))


def ivf_single_probe(spark: SparkSession, folder: str) -> DataFrame:
    table = vectors(spark, folder)
    index = ivf.single_probe(table, "l2")
    return shown(ivf.search(as_queries(table), index, nprobe=1, per_cell=None))


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return shown(graph.edges(vectors(spark, folder)))


def graph_search(spark: SparkSession, folder: str) -> DataFrame:
    table = vectors(spark, folder)
    links = written(graph.edges(table), "links")
    return shown(graph.search(as_queries(table), table, links))


def graph_search_large(spark: SparkSession, folder: str) -> DataFrame:
    """The same walks in rounds, as graphs beyond the broadcast get them."""
    table = vectors(spark, folder)
    links = written(graph.edges(table).withColumn("metric", F.lit("l2")), "links")
    return shown(graph.search_many(as_queries(table), table, links, ["l2"], shared_bytes=0).drop(
        "metric"))


def _of_all_metrics(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every vector as a query of each metric, and as a candidate, with ids that tell them apart.

    A query's id is four times the vector's plus the metric's number, a candidate's plus three, so
    earlier vectors, and only they, have smaller ids.
    """
    cells = [F.struct(F.lit(i).alias("number"), F.lit(m).alias("metric"))
             for i, m in enumerate(C.METRICS)]
    asked = table.select("vec_id", "embedding", F.inline(F.array(*cells))).select(
        (F.col("vec_id") * 4 + F.col("number")).alias("query_id"), "embedding", "metric")
    return asked, table.select((F.col("vec_id") * 4 + 3).alias("vec_id"), "embedding")


def _metric_and_ids(found: DataFrame, query: str, row: str) -> DataFrame:
    names = F.array(*[F.lit(m) for m in C.METRICS])
    return found.select(
        F.get(names, F.col("query_id").bitwiseAND(3).cast("int")).alias("metric"),
        F.shiftright("query_id", 2).alias(query), F.shiftright("vec_id", 2).alias(row),
        "rank", "distance")


def recall_by_method(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of the three approximate methods under the four metrics.

    All fits share each scan, and the exact neighbours and the edges of all metrics come from one
    pass each.
    """
    table = vectors(spark, folder)
    asked = as_queries(table)
    fits = [kmeans.Fit(cells, metric) for metric in C.METRICS
            for cells in (C.IVF_CELLS, C.SINGLE_PROBE_CELLS)]
    models = {(m.fit.metric, m.fit.cells): m for m in kmeans.fit_many(table, fits)}
    each, rows = _of_all_metrics(table)
    exact = _metric_and_ids(knn(each, rows, 10, F.col("metric"), broadcast_rows=QUERIES_SHARED),
                            "query_id", "vec_id")
    near = _metric_and_ids(knn(each, rows, C.GRAPH_DEGREE, F.col("metric"), earlier=True,
                               broadcast_rows=QUERIES_SHARED), "src", "dst")
    near = written(near.select("metric", "src", "dst"), "links")
    links = near.unionByName(near.select("metric", F.col("dst").alias("src"),
                                         F.col("src").alias("dst")))
    found = []
    for metric in C.METRICS:
        several = ivf.Index.of(table, models[metric, C.IVF_CELLS])
        one = ivf.Index.of(table, models[metric, C.SINGLE_PROBE_CELLS])
        found += [
            tagged(ivf.search(asked, several), metric, "ivf"),
            tagged(ivf.search(asked, one, nprobe=1, per_cell=None), metric, "ivf_single_probe")]
    walked = graph.search_many(asked, table, links, C.METRICS)
    found.append(walked.withColumn("method", F.lit("graph")))
    methods = F.array(F.lit("ivf"), F.lit("ivf_single_probe"), F.lit("graph"))
    truths = exact.withColumn("method", F.explode(methods))
    return recall_table(truths, _all(found), ("metric", "method"))


def tagged(df: DataFrame, metric: str, method: str) -> DataFrame:
    return df.withColumns({"metric": F.lit(metric), "method": F.lit(method)})


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
