"""Nearest centroids settled in single precision, against the scan in double."""

import numpy as np
import pytest

from quillon.operators import blocks, kmeans
from test_vectors import METRICS


@pytest.mark.parametrize("metric", METRICS)
def test_nearest_centroid_is_settled_in_single_precision(metric, monkeypatch):
    rng = np.random.default_rng(25)
    x = rng.normal(size=(3000, 16))
    centroids = np.concatenate([x[:20], x[3:6], rng.normal(size=(9, 16))])
    asked = blocks.Queries(np.arange(len(x)), x, np.full(len(x), metric), np.ones(len(x), np.int64))
    want, left = blocks.nearest(asked, np.arange(len(centroids)), centroids, 0.0), [0]

    def counted(q, *rest):
        left[0] += len(q.ids)
        return blocks.nearest(q, *rest)

    monkeypatch.setattr(kmeans, "nearest", counted)
    got = kmeans.closest(x, centroids, metric)
    assert all(np.array_equal(a, b) for a, b in zip(got, want))
    assert left[0] < 300


@pytest.mark.parametrize("metric", METRICS)
def test_nearest_centroid_of_odd_rows(metric):
    rng = np.random.default_rng(26)
    for scale in (1.0, 1e-18, 1e16, 1e150):
        x = rng.integers(-2, 3, (400, 4)) * scale
        for centroids in (x[:12], x[(x != 0).any(axis=1)][:30]):
            asked = blocks.Queries(np.arange(400), x, np.full(400, metric), np.ones(400, np.int64))
            want = blocks.nearest(asked, np.arange(len(centroids)), centroids, 0.0)
            got = kmeans.closest(x, centroids, metric)
            assert all(np.array_equal(a, b, equal_nan=a.dtype.kind == "f") for a, b in zip(got, want))


@pytest.mark.parametrize("odd", [False, True])
def test_manhattan_scan_gives_distances_within_its_slack(odd):
    rng = np.random.default_rng(27)
    x, y = rng.normal(size=(40, 64)), rng.normal(size=(5000, 64))
    if odd:
        y[7] *= 1e5
    bounds = np.full(len(x), 30.0)
    block, slack, start = blocks._scan("manhattan", x, y, 0.0, 10, bounds)
    near, true = block(slice(0, 40), slice(0, 5000)), np.abs(x[:, None] - y).sum(axis=2)
    scale = start / bounds
    assert (near.dtype == np.int16) == (not odd)
    assert (np.abs(near - true * scale[:, None]) <= slack[:, None]).all()
