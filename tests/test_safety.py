"""Bad vectors, both graph walks, commands behind the guard, loads that must not overwrite, and
requests out of range."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_vectors import frame, found, walk

from quillon.operators import blocks, graph
from quillon.operators.neighbours import knn
from quillon.plans import questions
from quillon.sources import catalog, tables
from quillon.streaming import requests as R


@pytest.mark.parametrize("bad", [[4.0], None, [1.0, None, 2.0]])
@pytest.mark.parametrize("rows", [4096, 0])
def test_vectors_without_a_distance_raise(spark, bad, rows):
    kind = "vec_id bigint, embedding array<float>"
    base = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, bad)], kind).coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], kind.replace("vec", "query"))
    with pytest.raises(Exception, match="of one length"):
        knn(asked, base, 1, broadcast_rows=rows).collect()


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot", "manhattan"])
@pytest.mark.parametrize("shared", [64 << 20, 0])
def test_both_graph_walks_are_the_plain_one(spark, monkeypatch, metric, shared):
    m = np.random.default_rng(8).normal(size=(90, 5)).astype(np.float32)
    m[::3] = m[1]
    table, asked = frame(spark, m), m[:6] + np.float32(0.1)
    links = graph.edges(table, 3, metric)
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", shared)
    got = found(graph.search(frame(spark, asked, "query_id"), table, links, 5, metric, beam=8))
    assert got == {i: walk(m, q, metric, 3, 8, 5) for i, q in enumerate(asked)}


@pytest.mark.parametrize("text", [
    "SET spark.sql.ansi.enabled=false", "USE default", "CACHE TABLE trips", "REFRESH TABLE trips",
    "LOAD DATA INPATH '/x' INTO TABLE t", "ADD JAR '/x.jar'", "-- note\nMSCK REPAIR TABLE trips"])
def test_commands_are_refused(spark, text):
    df, error = catalog.run_sql(spark, text)
    assert df is None and error.startswith("Forbidden SQL operation: ")


def test_queries_in_other_clothes_pass(spark):
    for text in ("-- note\nSELECT 1 AS a", "/* x */ WITH t AS (SELECT 1 AS a) SELECT * FROM t",
                 "(SELECT 1 AS a)", "VALUES (1)"):
        df, error = catalog.run_sql(spark, text)
        assert error is None and df.count() == 1


def test_a_failing_probe_overwrites_nothing(spark, monkeypatch):
    spark.sql("CREATE DATABASE IF NOT EXISTS probes")
    catalog.init_tables(spark, 30, database="probes")

    def broken(self):
        raise OSError("network is down")

    with monkeypatch.context() as patch:
        patch.setattr(type(spark.range(1)), "isEmpty", broken)
        with pytest.raises(OSError):
            catalog.init_tables(spark, 99, database="probes")
    assert spark.table("probes.trips").count() == 30


def test_requests_out_of_range_get_a_reason(spark):
    rows = [(1, "passage number 3", 51), (2, "passage number 4", 0), (3, "passage number 5", 50),
            (4, None, 3), (5, "passage number 1", None)]
    asked = spark.createDataFrame(rows, "request_id long, query string, k int").select(
        "request_id", F.lit(None).cast("timestamp").alias("ts"), F.lit("s").alias("session_id"),
        "query", "k", F.lit(None).cast("string").alias("metric"))
    store = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("passage number "), F.col("id").cast("string")).alias("text"))
    for answers in (R.answered(asked, store), R.answer_landed(asked, None, store)):
        got = {r["request_id"]: (r["result"], r["error"]) for r in answers.collect()}
        assert len(got) == 5
        assert got[1] == (None, "k must be at most 50") and got[2] == (None, "k must be at least 1")
        assert got[4] == (None, "query is required")
        assert got[3][0].count("passage number") == 51 and got[5][0].count("passage number") == 3


def test_row_count_is_that_of_the_whole_result(spark, sf):
    asked = spark.createDataFrame([("a", "Top 24 months by trips"), ("b", "Top 5 months by trips"),
                                   ("c", "Top 900 months by trips")], "question_id string, query string")
    base = tables.trips(spark, sf), tables.customers(spark, sf)
    count = {r["question_id"]: r["row_count"] for r in questions.answered(asked, *base).collect()}
    months = base[0].select(F.date_format("pickup_date", "yyyy-MM")).distinct().count()
    assert count == {"a": 24, "b": 5, "c": months}
    shown = {r["question_id"]: r["sql_result"].count("{")
             for r in questions.answered(asked, *base, rows=30).collect()}
    assert shown == {"a": 24, "b": 5, "c": 30}
