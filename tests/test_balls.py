"""Exact neighbours by bounds, against brute force, with a count of what was skipped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import balls, blocks
from quillon.operators.neighbours import knn
from test_vectors import brute, found, frame


def search(spark, queries, base, k, metric, block_rows):
    asked = blocks.query_side(frame(spark, queries, "query_id"), "query_id", "embedding", metric, k)
    return balls.exact(asked, frame(spark, base), k, metric, block_rows, len(base), base.shape[1])


def clustered(seed=1, groups=12, each=60, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) * 50
    return np.concatenate([c + rng.normal(size=(each, width)) for c in centres]).astype(np.float32)


@pytest.mark.parametrize("metric", balls.METRICS)
def test_clustered_data_skips_most_visits(spark, metric):
    base = clustered()
    result = search(spark, base[::3], base, 7, metric, 40)
    assert found(result.neighbours) == brute(base[::3], base, 7, metric)
    assert result.visits < 0.35 * result.possible


@pytest.mark.parametrize("metric", balls.METRICS)
@pytest.mark.parametrize("case", ["even", "ties", "far", "one place", "more than there is"])
def test_nothing_is_lost(spark, metric, case):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)).astype(np.float32)
    k = 6
    if case == "ties":
        base = rng.integers(0, 3, (300, 6)).astype(np.float32)
    if case == "far":
        base[::2] += 1e4
    if case == "one place":
        base[50:] = base[0]
    if case == "more than there is":
        k, base = 400, base[:90]
    result = search(spark, base[:80], base, k, metric, 32)
    assert found(result.neighbours) == brute(base[:80], base, k, metric)


def test_bounds_hold_for_every_pair(spark):
    base = clustered(4, 5, 40, 5)
    for metric in balls.METRICS:
        placed, rings, table = balls.lay_out(frame(spark, base), metric, 16, len(base), 5)
        ring = {r["vec_id"]: r["ring"] for r in placed.select("vec_id", "ring").collect()}
        assert len(ring) == len(base) and table.count() == len(rings.rows)
        assert [sum(v == i for v in ring.values()) for i in range(len(rings.rows))] == list(rings.rows)
        least, most = rings.bounds(metric, base.astype(np.float64))
        for i in range(len(base)):
            d = blocks.row_distance(metric, base[i][None, :].astype(float), base.astype(float), 0.0)
            d = np.sqrt(d) if metric == "l2" else d
            at = np.array([ring[j] for j in range(len(base))])
            assert (least[i][at] <= d).all() and (d <= most[i][at]).all()


def test_sure_rings_hold_enough_rows():
    most = np.array([[3.0, 1.0, 2.0], [1.0, 2.0, 3.0]])
    got = balls.sure(most, np.array([5, 2, 4]), np.array([5, 5]))
    assert got.tolist() == [[False, True, True], [True, False, False]]
    assert balls.sure(most, np.array([5, 2, 4]), np.array([99, 0])).tolist() == [
        [True] * 3, [False] * 3]


def test_own_k_and_no_candidates(spark):
    base = clustered(2, 3, 40)
    asked = frame(spark, base[:5], "query_id").withColumn("k", (F.col("query_id") + 1).cast("int"))
    got = found(knn(asked, frame(spark, base), 10, "l2", k_column=F.col("k"), broadcast_rows=0,
                    block_rows=16))
    want = brute(base[:5], base, 10, "l2")
    assert got == {q: want[q][:q + 1] for q in want}
    assert knn(asked, frame(spark, base).limit(0), 3, "l2", broadcast_rows=0).isEmpty()
    with pytest.raises(ValueError):
        balls.exact(asked, frame(spark, base), 3, "cosine", 16, 120, 8)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_earlier_rows_by_id_ranges(spark, metric):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(200, 5)).astype(np.float32)
    wide = frame(spark, base).withColumn("vec_id", F.col("vec_id") ** 2 - 500)
    wide = wide.withColumn("vec_id", F.col("vec_id").cast("long"))
    asked = wide.withColumnRenamed("vec_id", "query_id")
    few = knn(asked, wide, 4, metric, earlier=True)
    many = knn(asked, wide, 4, metric, earlier=True, broadcast_rows=0, block_rows=23)
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
    assert few.filter("vec_id >= query_id").isEmpty() and few.count() == 4 * 200 - 10
