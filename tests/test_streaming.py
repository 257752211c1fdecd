"""The request stream drained to files, compared with the batch operators."""

import datetime

from pyspark.sql import functions as F

from quillon.plans.dashboards import batch_summary
from quillon.plans.retrieval import prompts, retrieve
from quillon.sources import tables
from quillon.streaming import requests as R

ROWS = 30
HOURS = 2 * 3600 * 10**6


def beat(spark, folder, ts):
    """A heartbeat far ahead, which lets the last batches close."""
    spark.createDataFrame([(None, ts)], "request_id long, ts timestamp").select(
        "request_id", "ts", *[F.lit(None).cast(kind).alias(name) for name, kind in (
            ("session_id", "string"), ("query", "string"), ("k", "int"), ("metric", "string"))]
    ).coalesce(1).write.mode("append").parquet(folder)


def backlog(spark, folder, files=3):
    rows = spark.range(ROWS).select(
        F.col("id").alias("request_id"),
        F.timestamp_seconds(F.col("id") * 600 + 1_700_000_000).alias("ts"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("session_id"),
        F.concat(F.lit("which passage is number "), F.col("id").cast("string"),
                 F.lit(" mail a@b.co")).alias("query"),
        F.when(F.col("id") % 2 == 0, 3).cast("int").alias("k"),
        F.lit(None).cast("string").alias("metric"))
    rows.repartition(files).write.parquet(folder)
    beat(spark, folder, datetime.datetime(2030, 1, 1))
    return spark.read.parquet(folder).filter("request_id IS NOT NULL")


def store(spark):
    return spark.range(12).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("passage number "), F.col("id").cast("string")).alias("text"))


def drained(stream, path, name):
    query = R.write_stream(stream, str(path / name), str(path / f"{name}-checkpoint"))
    query.awaitTermination()
    assert query.exception() is None
    return stream.sparkSession.read.parquet(str(path / name))


def test_answers_equal_the_batch_search(spark, tmp_path):
    table = backlog(spark, str(tmp_path / "in"))
    stream = R.read_requests(spark, str(tmp_path / "in"), 1)
    got = drained(R.answered(stream, store(spark), wait_micros=HOURS, lateness="1 day"), tmp_path,
                  "out")
    asked = table.withColumnRenamed("request_id", "question_id")
    found = retrieve(asked, store(spark), 50, "l2", k_column=F.coalesce("k", F.lit(2)))
    want = {r["question_id"]: r["prompt"] for r in prompts(asked, found).collect()}
    assert {r["request_id"]: r["result"] for r in got.collect()} == want
    sizes = R.served_batches(got)
    assert [r["batch_size"] for r in sizes.orderBy("batch_key").collect()] == [8, 8, 8, 6]
    assert batch_summary(sizes).first()["total_processed"] == ROWS
    same = R.answered(table, store(spark), wait_micros=HOURS)
    fields = ["request_id", "result", "error", "batch_key", "batch_size", "place", "closed_by"]
    assert same.select(fields).exceptAll(got.select(fields)).isEmpty() and same.count() == ROWS


def test_a_failed_batch_fails_each_of_its_requests(spark, tmp_path):
    backlog(spark, str(tmp_path / "in"), 1)

    def respond(made):
        if any("number 9 " in m for m in made):
            raise RuntimeError("no model")
        return [str(len(m)) for m in made]

    stream = R.read_requests(spark, str(tmp_path / "in"))
    got = drained(R.answered(stream, store(spark), respond=respond, wait_micros=HOURS), tmp_path,
                  "out")
    failed = got.filter("error IS NOT NULL")
    assert got.count() == ROWS
    assert [r["request_id"] for r in failed.orderBy("request_id").collect()] == list(range(8, 16))
    assert failed.first()["error"] == "Error processing request: no model"
    assert got.filter("error IS NULL AND result IS NULL").isEmpty()


def test_landed_requests_are_answered_once(spark, tmp_path):
    backlog(spark, str(tmp_path / "in"))
    R.land(R.read_requests(spark, str(tmp_path / "in")), str(tmp_path / "landed"),
           str(tmp_path / "landed-checkpoint")).awaitTermination()
    landed = spark.read.parquet(str(tmp_path / "landed")).filter("request_id IS NOT NULL")
    first = R.answer_landed(landed.filter("request_id < 10"), None, store(spark))
    first.write.parquet(str(tmp_path / "answers"))
    done = spark.read.parquet(str(tmp_path / "answers")).select("request_id")
    rest = R.answer_landed(landed, done, store(spark))
    assert rest.count() == ROWS - 10


def test_a_large_store_is_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "STORE_ROWS", 5)
    backlog(spark, str(tmp_path / "in"))
    try:
        R.answered(R.read_requests(spark, str(tmp_path / "in")), store(spark))
    except ValueError as refusal:
        assert "answer_landed" in str(refusal)
    else:
        raise AssertionError("a store beyond the limit was shared")


def test_guards_on_the_stream(spark, tmp_path):
    table = backlog(spark, str(tmp_path / "in"))
    got = drained(R.guarded(R.read_requests(spark, str(tmp_path / "in"))), tmp_path, "out")
    got, want = got.filter("request_id IS NOT NULL"), R.guarded(table)
    assert got.exceptAll(want).isEmpty() and got.count() == ROWS
    assert got.first()["redacted"].endswith("mail [EMAIL]")


def test_history_of_closed_windows(spark, sf, tmp_path):
    log = tables.request_log(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"), "session_id", "latency", "bias_score")
    log.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    got = drained(R.session_history(stream), tmp_path, "out")
    horizon = log.agg(F.max("ts") - F.expr("INTERVAL 10 MINUTES")).first()[0]
    whole = (log.groupBy(F.window("ts", "1 hour").alias("w"), "session_id")
             .agg(F.count("*").alias("requests"))
             .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                     "session_id", "requests"))
    closed = whole.filter(F.col("window_end") <= F.lit(horizon))
    kept = got.select(*whole.columns)
    assert closed.count() > 0 and kept.exceptAll(whole).isEmpty()
    assert closed.exceptAll(kept).isEmpty()


def test_fixed_interval(spark, tmp_path):
    backlog(spark, str(tmp_path / "in"))
    stream = R.answered(R.read_requests(spark, str(tmp_path / "in"), 1), store(spark), lateness="1 day")
    query = R.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "c"), "100 milliseconds")
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == ROWS
