"""Count-or-time batches: the table form against a plain loop."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import batching as B

ZERO = datetime.datetime(2024, 1, 1)


def plain(rows, size, wait):
    """(lane, id) -> (batch_no, place) by walking through every lane."""
    out, state = {}, {}
    for lane, at, i in sorted(rows):
        number, place, opened = state.get(lane, (0, size, None))
        if place >= size or at >= opened + wait:
            number, place, opened = number + 1, 0, at
        state[lane] = (number, place + 1, opened)
        out[lane, i] = (number, place + 1)
    return out


def requests(spark, rows, **extra):
    made = [(lane, ZERO + datetime.timedelta(microseconds=at), i) for lane, at, i in rows]
    return spark.createDataFrame(made, "lane string, ts timestamp, request_id long").withColumns(
        {k: F.lit(v) for k, v in extra.items()})


def made(n, seed, spread):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", "c"]), rng.randrange(spread), i) for i in range(n)]


@pytest.mark.parametrize("chunk_rows, group_rows", [(1, 10**6), (9, 10**6), (40, 50), (10**5, 10**6)])
def test_against_a_plain_walk(spark, chunk_rows, group_rows):
    for seed, spread in ((1, 400_000), (2, 6_000_000), (3, 50_000)):
        rows = made(300, seed, spread)
        df = B.placed_in_batches(requests(spark, rows, at=1, chunk="x", entry=2), "lane", 8, 100_000,
                                 chunk_rows, group_rows)
        got = {(r["lane"], r["request_id"]): (r["batch_no"], r["place"]) for r in df.collect()}
        assert got == plain(rows, 8, 100_000)
        assert df.columns == ["lane", "ts", "request_id", "at", "chunk", "entry", "batch_no", "place"]


def test_bounds_are_exact(spark):
    rows = [("a", 0, 1), ("a", 99_999, 2), ("a", 100_000, 3), ("a", 199_999, 4), ("a", 200_000, 5)]
    df = B.placed_in_batches(requests(spark, rows), "lane", 8, 100_000)
    assert [(r["batch_no"], r["place"]) for r in df.orderBy("request_id").collect()] == [
        (1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]


def test_incomplete_requests_and_empty_tables(spark):
    df = spark.createDataFrame([(None, ZERO, 1), ("a", None, 2), ("a", ZERO, None), ("a", ZERO, 4)],
                               "lane string, ts timestamp, request_id long")
    got = B.placed_in_batches(df, "lane").orderBy("batch_no").collect()
    assert [tuple(r)[2:] for r in got] == [(2, 1, 1), (4, 2, 1)]
    assert B.placed_in_batches(df.filter("false"), "lane").count() == 0


def test_chunks_are_functions_of_their_entry():
    rng = np.random.default_rng(4)
    for _ in range(200):
        micros = np.sort(rng.integers(0, 300, rng.integers(1, 60)))
        size, cut = int(rng.integers(1, 9)), int(rng.integers(0, len(micros) + 1))
        look = micros[: cut + size]
        exits = B.chunk_exits(look, min(cut, len(look)), size, 20)
        for entry in range(min(size, cut)):
            starts = B.opens(micros, size, 20, entry)
            beyond = starts[starts >= cut]
            if len(beyond):
                assert exits[entry] == (beyond[0] - cut, (starts < cut).sum())


@pytest.mark.parametrize("parts", [1, 7])
def test_dealing_to_tasks_changes_nothing(spark, parts):
    rows = made(500, 9, 3_000_000)
    df = requests(spark, rows).repartition(parts)
    got = B.placed_in_batches(df, "lane", 8, 100_000, 16)
    assert {(r["lane"], r["request_id"]): (r["batch_no"], r["place"])
            for r in got.collect()} == plain(rows, 8, 100_000)
