"""The scan of a block, the layout in tiles, walks and batches that go together."""

import numpy as np
import pyarrow as pa
import pytest

from quillon.operators import balls, blocks, graph
from test_vectors import METRICS, brute, found, frame, walk


def table_of(case):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(900, 12)).astype(np.float32).astype(float)
    if case == "ties":
        base = rng.integers(0, 3, (900, 4)).astype(float)
    if case == "copies":
        base[::3] = base[0]
        base[[7, 100]] = 0
    if case == "far":
        base[::2] += 1e4
    if case == "one large value":
        base[17, 3] = 1e6
    if case == "tiny":
        base *= 1e-25
    return base, rng


@pytest.mark.parametrize("earlier", [False, True])
@pytest.mark.parametrize("case", ["even", "ties", "copies", "far", "one large value", "tiny"])
def test_scan_finds_what_all_pairs_find(case, earlier):
    base, rng = table_of(case)
    ids = rng.permutation(len(base))
    at = np.arange(120)
    q = blocks.Queries(ids[at], base[at], np.array(METRICS)[at % 4], rng.integers(1, 40, len(at)))
    got = blocks.nearest(q, ids, base, 0.0, earlier)
    plain = [blocks._in_parts(q, np.flatnonzero(q.metrics == m), m, ids, base, 0.0, earlier,
                              np.arange(len(ids))) for m in METRICS]
    qi, bi, dist = (np.concatenate(c) for c in zip(*[p for part in plain for p in part]))
    want = blocks.best_of(q.ks, qi, ids[bi], bi, dist)
    assert [a.tolist() for a in got[:2]] == [a.tolist() for a in want[:2]]
    assert np.array_equal(got[2], want[2], equal_nan=True)


def test_scan_measures_few_pairs(monkeypatch):
    """Before, each block was ordered as a whole; now exact distances are as few as the result."""
    base, _ = table_of("even")
    measured, plain = [], blocks.row_distance
    monkeypatch.setattr(blocks, "row_distance",
                        lambda m, x, y, e: measured.append(len(x)) or plain(m, x, y, e))
    monkeypatch.setattr(blocks, "_nearest_part", lambda *a: pytest.fail("a block in double precision"))
    for metric in METRICS:
        blocks.nearest(blocks.Queries(np.arange(300), base[:300], np.full(300, metric),
                                      np.full(300, 5)), np.arange(900), base, 0.0)
    assert sum(measured) < 4 * 300 * 5 * 3


def test_small_blocks_do_not_multiply_the_rows(spark):
    """2,000 rows in blocks of 8 were 250 copies of each row."""
    base = np.random.default_rng(4).normal(size=(2000, 4)).astype(np.float32)
    asked = blocks.query_side(frame(spark, base, "query_id"), "query_id", "embedding", "cosine", 3)
    tiles = blocks.all_tiles(asked, frame(spark, base), 2000, 2000, 4, 0.0, 8)
    most = blocks.TILES_PER_CORE * spark.sparkContext.defaultParallelism
    assert tiles.rdd.getNumPartitions() <= 2 * most
    size = blocks.rows_of_tile(spark, 10**6, 10**6, 64, 64)
    assert 64 < size <= blocks.block_rows_for(64)
    assert blocks.rows_of_tile(spark, 10**8, 10**8, 64, 64) == blocks.block_rows_for(64)


def test_a_query_goes_once_to_a_part_of_rings(spark):
    parts, table = balls._parts(np.array([3, 4, 2, 25, 1]), 10)
    assert [p.tolist() for p in parts] == [[0], [0], [0], [1, 2, 3], [4]]
    assert table == [(0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 1, 3), (4, 4, 1)]
    base = np.random.default_rng(6).normal(size=(1500, 6)).astype(np.float32)
    asked = blocks.query_side(frame(spark, base[:200], "query_id"), "query_id", "embedding", "l2", 4)
    result = balls.exact(asked, frame(spark, base), 4, "l2", 8, len(base), 6)
    assert found(result.neighbours) == brute(base[:200], base, 4, "l2")
    assert result.rings > 100


def test_walks_together_are_the_plain_walks():
    base = np.random.default_rng(8).normal(size=(150, 6))
    base[::3] = base[1]
    asked = base[:40] + 0.1
    pairs = [(i, j) for i, near in brute(base, base, 3, "l2", True).items() for j in near]
    links = np.array(sorted(pairs + [(b, a) for a, b in pairs]))
    first = np.searchsorted(links[:, 0], np.arange(len(base) + 1))
    who, node, _ = graph._walks(asked, base, "l2", first, links[:, 1], 8)
    for i, q in enumerate(asked):
        assert node[who == i][:5].tolist() == walk(base, q, "l2", 3, 8, 5)


def test_batches_are_served_together():
    from quillon.streaming import requests

    kind = pa.struct([("request_id", pa.int64()), ("ts", pa.timestamp("us")),
                      ("session_id", pa.string()), ("query", pa.string()),
                      ("reject_reason", pa.string()), ("q_k", pa.int32()),
                      ("q_vec", pa.list_(pa.float64()))])

    def ask(i, reason=None):
        return {"request_id": i, "ts": None, "session_id": "s", "query": f"q{i}",
                "reject_reason": reason, "q_k": 1 + i % 2, "q_vec": [float(i), 0.0]}

    rows = pa.record_batch({
        "lane": pa.array(["0", "1", "1"]), "batch_no": pa.array([1, 1, 2]),
        "queue_size": pa.array([0, 0, 0]), "closed_by": pa.array(["size", "time", "time"]),
        "requests": pa.array([[ask(0), ask(1)], [ask(2, "no")], [ask(3, "no"), ask(4)]],
                             pa.list_(kind))})
    passages, vectors = ["a", "b", "c"], np.array([[0.0, 0.0], [1.0, 0.0], [4.0, 0.0]])

    def fail_for_four(texts):
        if any("q4" in t for t in texts):
            raise RuntimeError("lost")
        return texts

    for respond in (None, fail_for_four):
        (got,) = requests._served(rows, np.arange(3), passages, vectors, respond)
        one = [next(requests._served(rows.slice(i, 1), np.arange(3), passages, vectors, respond))
               for i in range(3)]
        assert got.drop_columns("processing_time").to_pylist() == [
            r for part in one for r in part.drop_columns("processing_time").to_pylist()]
        assert got["place"].to_pylist() == [1, 2, 1, 1, 2]
        assert got["batch_key"].to_pylist() == ["0-1", "0-1", "1-1", "1-2", "1-2"]
    assert got["error"].to_pylist() == [None, None, "no", "no", "Error processing request: lost"]
    assert "Context:\nb\na" in got["result"][1].as_py() and got["result"][4].as_py() is None


def test_a_text_is_split_once_for_its_embedding(spark):
    """The count of tokens was taken from the text again for each of the 16 dimensions."""
    from pyspark.sql import functions as F

    from quillon.operators.encoder import embed_column, embed_texts

    texts = spark.createDataFrame([(0, "one two two"), (1, ""), (2, None), (3, "x " * 300)],
                                  "id int, text string")
    inside = texts.select("id", embed_column(F.coalesce("text", F.lit(""))).alias("v"))
    plan = inside._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") <= 6
    want = {r["id"]: r["embedding"] for r in embed_texts(texts, "id", "text").collect()}
    for r in inside.collect():
        assert np.allclose(r["v"], want[r["id"]])
