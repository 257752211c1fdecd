"""Walks that measure little in double precision and need no job a round."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import blocks, graph
from test_vectors import METRICS, brute, found, frame, walk


def csr(m, metric, degree):
    pairs = [(i, j) for i, near in brute(m, m, degree, metric, True).items() for j in near]
    links = np.array(sorted(pairs + [(b, a) for a, b in pairs]))
    return np.searchsorted(links[:, 0], np.arange(len(m) + 1)), links[:, 1]


@pytest.mark.parametrize("metric", METRICS)
def test_walks_measure_few_pairs_in_double(metric, monkeypatch):
    rng = np.random.default_rng(21)
    m = rng.normal(size=(600, 16)).astype(np.float32)
    m[::5] = m[1]
    first, near = csr(m, metric, 4)
    asked, measured = rng.normal(size=(40, 16)).astype(np.float32).astype(np.float64), [0]

    def counted(name, x, y, eps):
        measured[0] += len(x)
        return blocks.row_distance(name, x, y, eps)

    monkeypatch.setattr(graph, "row_distance", counted)
    double = graph._walks(asked, m.astype(np.float64), metric, first, near, 10)
    plain, measured[0] = measured[0], 0
    single = graph._walks(asked, m, metric, first, near, 10)
    assert all(np.array_equal(a, b) for a, b in zip(double, single))
    assert measured[0] < 0.6 * plain


@pytest.mark.parametrize("metric", METRICS)
def test_walks_of_odd_numbers_are_those_in_double(metric):
    """Zero vectors, ties, numbers at the ends of single precision, and beyond it."""
    rng = np.random.default_rng(22)
    for scale in (1.0, 1e-20, 1e-30, 1e14, 1e25):
        m = (rng.integers(-2, 3, (150, 4)) * scale).astype(np.float32)
        m[::7] *= np.float32(1e-6)
        with np.errstate(all="ignore"):
            first, near = csr(m, "l2", 3)
            for asked in (m[:20].astype(np.float64), m[:20] + 0.1 * scale):
                double = graph._walks(asked, m.astype(np.float64), metric, first, near, 8)
                single = graph._walks(asked, m, metric, first, near, 8)
                assert all(np.array_equal(a, b, equal_nan=a.dtype.kind == "f")
                           for a, b in zip(double, single))


@pytest.mark.parametrize("part_rows", [16, 16_384])
def test_long_walks_need_no_job_a_round(spark, part_rows):
    """A path of 60 nodes with named ids is walked to its end, in as many jobs as a short one."""
    m = np.cumsum(np.abs(np.random.default_rng(23).normal(size=(60, 3))), axis=0).astype(np.float32)
    name = F.format_string("n%03d", "vec_id")
    table = frame(spark, m).withColumn("vec_id", name)
    asked = frame(spark, m[50:], "query_id")
    steps = [("l2", f"n{i:03d}", f"n{j:03d}") for i in range(60) for j in (i - 1, i + 1) if 0 <= j < 60]
    links = spark.createDataFrame(steps, "metric string, src string, dst string")
    spark.sparkContext.setJobGroup(f"walks-{part_rows}", "")
    got = found(graph._walk_in_rounds(asked, table, links, ["l2"], 2, 50, part_rows).drop("metric"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walks-{part_rows}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    at = {q: np.argsort(((m[50 + q] - m[:51]) ** 2).sum(axis=1), kind="stable")[:2] for q in range(10)}
    assert got == {q: [f"n{i:03d}" for i in near] for q, near in at.items()}
    assert jobs < 40


def test_walks_from_files_with_hubs_and_repeated_queries(spark):
    m = np.random.default_rng(24).normal(size=(90, 4)).astype(np.float32)
    m[::2] = m[0]
    table = frame(spark, m)
    links = [graph.edges(table, 3, metric).select(F.lit(metric).alias("metric"), "src", "dst")
             for metric in ("l2", "manhattan")]
    asked = frame(spark, m[:9], "query_id")
    got = graph._walk_in_rounds(asked.unionByName(asked.limit(0)), table, links[0].union(links[1]),
                                ["l2", "manhattan"], 4, 6, 32)
    for metric in ("l2", "manhattan"):
        assert found(got.filter(F.col("metric") == metric).drop("metric")) == {
            i: walk(m, q, metric, 3, 6, 4) for i, q in enumerate(m[:9])}
    twice = graph._walk_in_rounds(asked.unionByName(asked), table, links[0], ["l2"], 4, 6, 32)
    once = got.filter("metric = 'l2'")
    assert twice.distinct().exceptAll(once).isEmpty() and twice.count() == 4 * once.count()
