"""Exact k nearest neighbours of many queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quillon.operators import balls, blocks
from quillon.operators.ranking import first_per_group


def best_per_query(candidates: DataFrame, k: int,
                   groups: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """``rank`` 1..k by (distance, vec_id)."""
    return first_per_group(candidates, list(groups), ["distance", "vec_id"], k)


def knn(queries: DataFrame, base: DataFrame, k: int = 10, metric: str | Column = "l2",
        eps: float = 0.0, k_column: Column | None = None, query_id: str = "query_id",
        query_vector: str = "embedding", vec_id: str = "vec_id", vector: str = "embedding",
        earlier: bool = False, broadcast_rows: int = blocks.BROADCAST_ROWS,
        block_rows: int | None = None,
        count_base: Callable[[], int] | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: the ``k`` nearest rows of ``base`` per query.

    ``metric`` is a name (an unknown one raises) or a column (an unknown value means ``l2``).
    ``k_column`` gives a query its own number of results, up to ``k``. ``earlier`` restricts the
    search to rows whose id is below the query's. Beyond ``broadcast_rows`` queries l2 and Manhattan
    skip rings by their bounds (``balls``), the other distances meet all blocks, of ``block_rows`` or
    more rows each (``blocks.rows_of_tile``). ``count_base`` counts ``base`` where that is cheaper
    than running its plan.
    """
    wanted = F.lit(k) if k_column is None else F.least(k_column, F.lit(k))
    asked = blocks.query_side(queries, query_id, query_vector, metric, wanted)
    rows = base.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"))
    query_type = asked.schema["query_id"].dataType.simpleString()
    head, few = blocks.small_enough(asked, broadcast_rows, blocks.BROADCAST_BYTES)
    if few:
        best = best_per_query(blocks.against_broadcast(head, rows, eps, earlier, query_type), k)
    else:
        width = asked.select(F.size("q_vec")).first()[0]
        total = (count_base or rows.count)()
        if earlier and isinstance(rows.schema["vec_id"].dataType, IntegralType):
            q_rows = asked.count()
            size = blocks.rows_of_tile(queries.sparkSession, q_rows, total, width, block_rows, 2)
            size = max(1, int(size * min(1, total / q_rows)))
            best = best_per_query(blocks.earlier_grid(asked, rows, eps, size, total), k)
        elif isinstance(metric, str) and metric in balls.METRICS and not earlier and not eps:
            best = balls.exact(asked, rows, k, metric, block_rows or blocks.LEAST_ROWS,
                               total, width).neighbours
        else:
            best = best_per_query(blocks.all_tiles(asked, rows, asked.count(), total, width, eps,
                                                   block_rows, earlier), k)
    if k_column is not None:
        best = best.join(asked.select("query_id", "q_k"), "query_id").filter(
            F.col("rank") <= F.col("q_k"))
    return best.select("query_id", "rank", "vec_id", "distance")
