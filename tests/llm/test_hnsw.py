import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import hnsw
from quillon.llm.queries import QUERIES


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank int")


def exact(rows, k, every):
    """All distances in double precision; vectors that take no part left out."""
    good = {(i, tuple(np.float32(x) for x in v)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in sorted({g for g in good if g[0] % every == 0}):
        near = sorted((float(np.sqrt(((np.array(a, float) - np.array(b, float)) ** 2).sum())), i)
                      for i, b in good if i != q and len(a) == len(b))
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return out


def drawn(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, dim))
    return [(i, [float(x) for x in (centres[i % 8] + rng.normal(size=dim) * 0.4)
                 .astype(np.float32)]) for i in range(n)]


def got(df):
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()]


def test_recall_scores_and_ranks(spark):
    rows = drawn(3000)
    found = got(hnsw.nearest(table(spark, [(*r, 0, 5) for r in rows]), 10, 50, shards=3))
    want = exact(rows, 10, 50)
    assert len(found) == len(want)
    true = {(q, i): d for q, _, i, d in want}
    hits = [(q, i) in true for q, _, i, _ in found]
    assert np.mean(hits) >= 0.95
    for q, _, i, d in found:
        assert (q, i) not in true or d == pytest.approx(true[q, i], abs=1e-12)
    by_query = {}
    for q, r, i, d in sorted(found):
        by_query.setdefault(q, []).append((d, i))
    assert all(v == sorted(v) and len(v) == 10 for v in by_query.values())


def test_awkward_rows_are_exact(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]),
            (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]),
            (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0, 3.0]), (100, [2.0, 2.0, 2.0]),
            (200, [-1.0, 0.5]), (300, [5.0])]
    found = got(hnsw.nearest(table(spark, [(*r, 1, 2) for r in rows]), 10, 100))
    want = exact(rows, 10, 100)
    assert sorted((a, b, c, round(d, 12)) for a, b, c, d in found) == sorted(
        (a, b, c, round(d, 12)) for a, b, c, d in want)
    assert hnsw.nearest(table(spark, []), 10, 100).count() == 0


def test_one_vector_in_a_third_of_all_rows(spark):
    rows = drawn(400) + [(1000 + i, [0.5] * 16) for i in range(200)]
    found = got(hnsw.nearest(table(spark, [(*r, 1, 2) for r in rows]), 10, 100))
    ids = [i for q, _, i, _ in sorted(found) if q == 1100]
    assert ids == [i for i in range(1000, 1010)]
    assert [i for q, _, i, _ in sorted(found) if q == 1000] == list(range(1001, 1011))


def test_recall_of_a_full_shard_without_clusters(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(hnsw.SHARD_ROWS, 64)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(vectors)),
                                           "embedding": list(vectors)}))
    found = {}
    for q, _, i, _ in got(hnsw.nearest(rows, 10, 50, shards=1)):
        found.setdefault(q, set()).add(i)
    near = vectors[::50] @ vectors.T
    near[np.arange(len(near)), np.arange(0, len(vectors), 50)] = -np.inf
    want = np.argsort(-near, axis=1)[:, :10]
    assert len(found) == len(want)
    assert np.mean([len(found[q * 50] & set(w)) / 10 for q, w in enumerate(want.tolist())]) >= 0.98


def test_query_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"])
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = got(QUERIES["op5_hnsw"](spark, sf))
    want = exact(rows, 10, 100)
    assert len(found) == len(want)
    true = {(q, i) for q, _, i, _ in want}
    assert np.mean([(q, i) in true for q, _, i, _ in found]) >= 0.95


def wide(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("case", ["unit", "around a million", "1e25", "1e200", "mixed sizes"])
def test_double_and_very_large_vectors(spark, case):
    rng = np.random.default_rng(6)
    m = rng.normal(size=(900, 8))
    m = {"unit": m, "around a million": 1e6 + m, "1e25": m * 1e25, "1e200": m * 1e200,
         "mixed sizes": m * np.where(np.arange(900) % 2, 1e12, 1.0)[:, None]}[case]
    found = got(hnsw.nearest(wide(spark, [(i, v.tolist()) for i, v in enumerate(m)]), 10, 50,
                             shards=2))
    unit = 1e190 if case == "1e200" else 1.0
    far = np.sqrt(((m[::50, None] / unit - m[None] / unit) ** 2).sum(2)) * unit
    far[np.arange(len(far)), np.arange(0, 900, 50)] = np.inf
    want = {(q * 50, int(i)) for q, near in enumerate(np.argsort(far, axis=1)[:, :10]) for i in near}
    assert np.mean([(q, i) in want for q, _, i, _ in found]) >= 0.95 and len(found) == len(want)
    for q, _, i, d in found:
        assert d == pytest.approx(far[q // 50, i], rel=1e-12)


def test_queries_far_from_a_shard_are_measured_exactly(spark):
    rng = np.random.default_rng(2)
    base = wide(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)), 1)])
    asked = spark.createDataFrame([(0, [1e9, 0.0, 3e8, 1.0])], "query_id long, embedding array<double>")
    found = got(hnsw.search(asked, hnsw.build(base, 5, 2), 5))
    rows = np.array([r["embedding"] for r in base.orderBy("vec_id").collect()])
    far = np.sqrt(((rows - np.array([1e9, 0.0, 3e8, 1.0])) ** 2).sum(1))
    assert [i for _, _, i, _ in sorted(found, key=lambda r: r[1])] == (
        np.argsort(far, kind="stable")[:5] + 1).tolist()


def test_blocks_of_queries_change_nothing(spark):
    rows = table(spark, [(*r, 0, 5) for r in drawn(600)])
    index = hnsw.build(rows.select("vec_id", "embedding"), 10, 2)
    asked = rows.filter("vec_id % 5 = 0").select(
        rows["vec_id"].alias("query_id"), "embedding")
    assert sorted(got(hnsw.search(asked, index, 10))) == sorted(
        got(hnsw.search(asked, index, 10, block_queries=7)))


@pytest.mark.parametrize("dim", [16, 256])
def test_recall_in_other_dimensions(spark, dim):
    rng = np.random.default_rng(dim)
    vectors = rng.normal(size=(3000, dim)).astype(np.float32)
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(3000), "embedding": list(vectors)}))
    found = {(q, i) for q, _, i, _ in got(hnsw.nearest(rows, 10, 100, shards=1))}
    near = ((vectors[::100, None] - vectors[None]) ** 2).sum(2)
    near[np.arange(30), np.arange(0, 3000, 100)] = np.inf
    want = {(q * 100, int(i)) for q, w in enumerate(np.argsort(near, axis=1)[:, :10]) for i in w}
    assert len(found & want) >= 0.9 * len(want)
