"""Batches, metrics, results and visits on a stream, against their table forms."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators.batching import placed_in_batches
from quillon.plans.dashboards import batch_summary
from quillon.streaming import batches as S
from quillon.streaming import requests as R
from quillon.streaming import results
from test_streaming import beat, drained, store

ZERO = datetime.datetime(2024, 1, 1)


def after(seconds):
    return ZERO + datetime.timedelta(microseconds=round(seconds * 1e6))


def in_turn(df, folder, parts):
    """Files in order of time, each written after the one before."""
    cut = df.orderBy("ts").collect()
    size = -(-len(cut) // parts)
    for i in range(0, len(cut), size):
        df.sparkSession.createDataFrame(cut[i: i + size], df.schema).coalesce(1).write.mode(
            "append").parquet(folder)


def burst(spark, folder, parts, n=240, seconds=3.0, seed=1):
    """Requests of three sessions, in ``parts`` files in order of time, and a heartbeat."""
    rng = random.Random(seed)
    rows = [(i, after(rng.uniform(0, seconds)), f"s{rng.choice([0, 0, 1, 2])}",
             f"question {i}", None, None) for i in range(n)]
    df = spark.createDataFrame(rows, R.REQUEST_SCHEMA)
    in_turn(df, folder, parts)
    beat(spark, folder, after(3600))
    return df


def members(df):
    return sorted((r["lane"], r["batch_no"], r["closed_by"], tuple(q["request_id"] for q in r["requests"]))
                  for r in df.collect())


@pytest.mark.parametrize("parts, per_trigger", [(1, None), (6, 1), (6, 2)])
def test_batches_depend_on_the_requests_alone(spark, tmp_path, parts, per_trigger):
    table = burst(spark, str(tmp_path / "in"), parts)
    stream = R.read_requests(spark, str(tmp_path / "in"), per_trigger)
    got = drained(S.batched(stream, F.col("session_id"), lateness="5 seconds"), tmp_path, "out")
    found = members(got)
    assert found == members(S.batched(table, F.col("session_id")))
    assert {c for _, _, c, _ in found} == {"size", "time"}
    placed = placed_in_batches(table, "session_id")
    assert {(r["session_id"], r["batch_no"], r["request_id"]) for r in placed.collect()} == {
        (lane, no, i) for lane, no, _, ids in found for i in ids}


def test_closings_wait_for_the_watermark():
    times = [0, 10, 20, 30, 150]
    assert S.closings(times, 40, 3, 100) == ([(0, 3, "size")], 3, 129)
    assert S.closings(times, 129, 3, 100) == ([(0, 3, "size"), (3, 4, "time")], 4, 249)
    assert S.closings(times, 15, 3, 100) == ([], 0, 20)
    assert S.closings([], 15, 3, 100) == ([], 0, None)


def test_payloads_survive_the_state(spark, tmp_path):
    table = burst(spark, str(tmp_path / "in"), 2)
    stream = R.read_requests(spark, str(tmp_path / "in"), 1)
    got = drained(S.batched(stream, F.lit("")), tmp_path, "out")
    back = got.select(F.inline("requests"))
    assert back.exceptAll(table).isEmpty() and back.count() == table.count()


def test_trigger_metrics_equal_a_recount_of_the_answers(spark, tmp_path):
    table = burst(spark, str(tmp_path / "in"), 6)
    stream = R.read_requests(spark, str(tmp_path / "in"), 1)
    answers = R.answered(stream, store(spark), lane=F.col("session_id"), lateness="200 milliseconds")
    query = R.write_stream(answers, str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    seen = S.trigger_metrics(spark, query).orderBy("trigger").collect()
    got = spark.read.parquet(str(tmp_path / "out"))
    batches = R.served_batches(got)
    whole = batch_summary(batches).first()
    assert sum(r["requests"] for r in seen) == got.count() == table.count()
    assert sum(r["batches"] for r in seen) == batches.count()
    assert max(r["max_queue_size"] for r in seen) == whole["max_queue_size"] > 0
    assert sum(r["processing_time"] for r in seen) == pytest.approx(
        batches.agg(F.sum("processing_time")).first()[0])
    arrived = served = 0
    for r in seen:
        arrived, served = arrived + r["arrived"], served + r["requests"]
        assert r["backlog"] == arrived - served >= 0
    assert seen[-1]["backlog"] == 0 and sum(r["requests"] > 0 for r in seen) > 2


def test_replayed_requests_are_served_once(spark, tmp_path):
    table = burst(spark, str(tmp_path / "in"), 2)
    table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.unrepeated(R.read_requests(spark, str(tmp_path / "in")), "10 seconds")
    got = drained(stream.filter("request_id IS NOT NULL"), tmp_path, "out")
    assert got.exceptAll(table).isEmpty() and got.count() == table.count()


def test_requests_without_a_time_get_an_error(spark, tmp_path):
    burst(spark, str(tmp_path / "in"), 1, n=5)
    spark.createDataFrame([(77, None, "s", "when", None, None)], R.REQUEST_SCHEMA).coalesce(1).write.mode(
        "append").parquet(str(tmp_path / "in"))
    got = drained(R.answered(R.read_requests(spark, str(tmp_path / "in")), store(spark)), tmp_path, "out")
    errors = {r["request_id"]: r["error"] for r in got.collect()}
    assert errors == {**dict.fromkeys(range(5)), 77: "request has no time"}


ANSWERS = "request_id long, answered_at timestamp, result string, error string"


def asked_and_answered(spark, tmp_path):
    """Requests 0 to 9 a minute apart: 3 is lost, 5 late, 7 failed, 8 answered twice, 1 before."""
    asked = [(i, after(60 * i), "s", f"q{i}", 2, "l2") for i in range(10)]
    given = [(i, after(60 * i + (500 if i == 5 else -5 if i == 1 else 20)),
              None if i == 7 else f"r{i}", "broken" if i == 7 else None)
             for i in range(10) if i != 3]
    given.append((8, after(60 * 8 + 30), "again", None))
    requests = spark.createDataFrame(asked, R.REQUEST_SCHEMA)
    answers = spark.createDataFrame(given, ANSWERS)
    requests.coalesce(1).write.parquet(str(tmp_path / "asked"))
    answers.coalesce(1).write.parquet(str(tmp_path / "given"))
    return requests, answers


EXPECTED = {**{i: (f"r{i}", None) for i in (0, 2, 4, 6, 8, 9)}, 7: (None, "broken"),
            **{i: (None, "no answer within 2 minutes") for i in (1, 3, 5)}}


def outcome(df):
    return {r["request_id"]: (r["result"], r["error"]) for r in df.collect()}


def test_results_reach_their_requests(spark, tmp_path):
    requests, answers = asked_and_answered(spark, tmp_path)
    table = results.joined(requests, answers)
    assert outcome(table) == EXPECTED and table.count() == 10
    assert results.joined(requests.filter("false"), answers).count() == 0
    assert outcome(results.joined(requests, answers.filter("false"))) == {
        i: (None, "no answer within 2 minutes") for i in range(10)}


def test_results_reach_their_requests_on_a_stream(spark, tmp_path):
    requests, answers = asked_and_answered(spark, tmp_path)
    end = after(100_000)
    beat(spark, str(tmp_path / "asked"), end)
    spark.createDataFrame([(-1, end, None, None)], ANSWERS).coalesce(1).write.mode("append").parquet(
        str(tmp_path / "given"))
    given = spark.readStream.schema(ANSWERS).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "given"))
    stream = results.joined(R.read_requests(spark, str(tmp_path / "asked"), 1), given)
    query = R.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter("request_id IS NOT NULL")
    assert outcome(got) == EXPECTED and got.count() == 10
    join = [o for o in query.recentProgress[-1]["stateOperators"]
            if o["operatorName"] == "symmetricHashJoin"][0]
    assert join["numRowsTotal"] <= 2  # the two that closed the stream; no request is left waiting


def test_visits_on_a_stream_equal_the_table(spark, tmp_path):
    rng = random.Random(6)
    rows = [(after(rng.uniform(0, 200_000)), f"s{rng.randrange(4)}", rng.random(), rng.random(),
             rng.choice(["ok", "ok", "error"])) for _ in range(300)]
    log = spark.createDataFrame(
        rows, "ts timestamp, session_id string, latency double, bias_score double, status string")
    in_turn(log, str(tmp_path / "log"), 5)
    gap = F.when(F.col("status") == "error", "5 minutes").otherwise("20 minutes")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "log"))
    got = drained(R.session_visits(stream, gap), tmp_path, "out")
    keys = ["session_id", "visit_start", "visit_end", "requests"]
    whole = R.session_visits(log, gap).select(keys)
    horizon = log.agg(F.max("ts") - F.expr("INTERVAL 10 MINUTES")).first()[0]
    closed = whole.filter(F.col("visit_end") <= F.lit(horizon))
    assert closed.count() > 20 and closed.exceptAll(got.select(keys)).isEmpty()
    assert got.select(keys).exceptAll(whole).isEmpty()
    # a visit with a request of another gap is as long as its requests say
    assert whole.filter(F.col("requests") > 2).count() > 5
