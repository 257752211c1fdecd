"""Ad-hoc SQL, table loads, generated tables, matrix files, exports and traces."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import encoder
from quillon.operators.neighbours import knn
from quillon.plans.answers import answer
from quillon.sources import catalog, embeddings, matrices, matrix_format, sinks, synthetic, tables
from quillon.sources.matrix_format import MatrixSource


def test_run_sql(spark, sf):
    tables.register(spark, sf)
    statements = [
        "SELECT COUNT(*) as count FROM trips",
        "SELECT location, SUM(fare) as total FROM trips GROUP BY location ORDER BY total DESC LIMIT 5",
        "SELECT region, AVG(churn)*100 as rate FROM customers GROUP BY region",
        "SELECT location, COUNT(*) as cnt FROM trips GROUP BY location LIMIT 3",
    ]
    for text in statements:
        df, error = catalog.run_sql(spark, text)
        assert error is None and df.count() > 0
    assert catalog.run_sql(spark, "SELECT * FROM trips LIMIT 1000")[0].count() == 1000
    assert catalog.run_sql(spark, "drop table trips") == (None, "Forbidden SQL operation: DROP")
    assert catalog.run_sql(spark, " ")[1]
    assert catalog.run_sql(spark, "SELECT nothing FROM nowhere")[0] is None


REFUSED = {
    "SELECT reflect('java.lang.System', 'getProperty', 'java.version')": "function reflect",
    "SELECT java_method('java.lang.System', 'getProperty', 'java.version')": "function java_method",
    "SELECT try_reflect('java.lang.System', 'exit', 1) FROM trips": "function try_reflect",
    "SELECT system.builtin.reflect('a', 'b')": "function reflect",
    "SELECT count(*) FROM text.`/etc/hostname`": "unregistered relation",
    "SELECT * FROM trips WHERE id IN (SELECT value FROM text.`/etc/hostname`)": "unregistered",
    "WITH a AS (SELECT * FROM parquet.`/tmp/x`) SELECT * FROM a": "unregistered relation",
    "SELECT exists(array(1), x -> reflect('a', 'b') = x)": "function reflect",
    "SELECT (SELECT max(reflect('a', 'b')) FROM trips)": "function reflect",
    "SELECT sum(fare) OVER (ORDER BY reflect('a', 'b')) FROM trips": "function reflect",
    "SELECT IDENTIFIER('reflect')('a', 'b')": "computed name",
    "SELECT * FROM IDENTIFIER('trips')": "computed name",
    "SELECT TRANSFORM(id) USING 'cat' FROM trips": "ScriptTransformation",
    "SELECT * FROM trips t LATERAL VIEW explode(array(reflect('a', 'b'))) x": "function reflect",
    "SELECT * FROM read_files('/etc')": "table function read_files",
    "VALUES (reflect('a', 'b'))": "function reflect",
    "FROM trips JOIN csv.`/etc/passwd` p SELECT *": "unregistered relation",
    "SELECT * FROM a.b.c": "unregistered relation",
    "SELECT FROM WHERE": "",
    "SET spark.x=1": "SET", "EXPLAIN SELECT 1": "EXPLAIN", "CACHE TABLE trips": "CACHE",
}
PLAIN = [
    "WITH a AS (SELECT location, count(*) AS n FROM trips GROUP BY location HAVING count(*) > 1) "
    "SELECT *, row_number() OVER (PARTITION BY n ORDER BY location) AS r FROM a ORDER BY n LIMIT 5",
    "SELECT DISTINCT region FROM customers WHERE id IN (SELECT id FROM customers) "
    "AND EXISTS (SELECT 1 FROM trips)",
    "SELECT location FROM trips UNION ALL SELECT id FROM range(3) INTERSECT SELECT 1 EXCEPT SELECT 9",
    "(SELECT 1 AS x) UNION VALUES (2)", "TABLE trips", "FROM trips SELECT max(fare)",
    "SELECT region, x FROM customers LATERAL VIEW explode(array(1, 2)) e AS x",
    "SELECT * FROM (SELECT region, churn FROM customers) PIVOT (count(*) FOR churn IN (0, 1))",
    "SELECT region, sum(churn) FROM customers GROUP BY CUBE (region)",
    "SELECT /*+ BROADCAST(t) */ transform(array(fare), x -> x + 1) FROM trips t LIMIT 2 OFFSET 1",
    "SELECT * FROM trips a JOIN LATERAL (SELECT a.fare AS f) b LEFT JOIN customers c ON a.id = c.id",
    "SELECT sum(fare) OVER w FROM trips WINDOW w AS (ORDER BY id)",
    "SELECT * FROM trips TABLESAMPLE (10 ROWS)",
]


@pytest.mark.parametrize("text", REFUSED)
def test_statements_that_reach_outside_are_refused(spark, sf, text):
    tables.register(spark, sf)
    df, error = catalog.run_sql(spark, text)
    assert df is None and REFUSED[text] in error


@pytest.mark.parametrize("text", PLAIN)
def test_plain_queries_run(spark, sf, text):
    tables.register(spark, sf)
    df, error = catalog.run_sql(spark, text)
    assert error is None and df.columns


def test_tables_of_a_database_are_registered_relations(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS guarded")
    spark.range(3).write.mode("overwrite").saveAsTable("guarded.numbers")
    df, error = catalog.run_sql(spark, "SELECT count(*) AS n FROM guarded.numbers")
    assert error is None and df.first()["n"] == 3


def test_init_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS loads")
    catalog.init_tables(spark, 200, database="loads")
    spark.sql("INSERT INTO loads.customers VALUES (999, 'North', 1, 0, 5.0)")
    catalog.init_tables(spark, 50, database="loads")
    assert spark.table("loads.trips").count() == 200
    assert spark.table("loads.customers").count() == 201
    rows = catalog.catalog_profile(spark, "loads").collect()
    assert {(r["table_name"], r["row_count"]) for r in rows} == {("trips", 200), ("customers", 201)}
    catalog.init_tables(spark, 50, force_recreate=True, database="loads")
    assert spark.table("loads.customers").count() == 50


def test_generated_tables(spark):
    end = F.lit("2024-06-30 00:00:00").cast("timestamp")
    trips = synthetic.synthetic_trips(spark, 5000, end)
    assert trips.exceptAll(synthetic.synthetic_trips(spark, 5000, end).repartition(7)).isEmpty()
    low = trips.agg(F.min("fare"), F.min("location"), F.max("location"), F.min("pickup_date"),
                    F.avg("fare"), F.avg((F.col("passengers") == 1).cast("int"))).first()
    assert low[0] >= 2.5 and 1 <= low[1] and low[2] <= 265 and str(low[3]) >= "2024-01-02"
    assert low[4] == pytest.approx(17.5, rel=0.05) and low[5] == pytest.approx(0.7, abs=0.03)
    people = synthetic.synthetic_customers(spark, 5000)
    late = people.groupBy((F.col("tenure") > 36).alias("late")).agg(F.avg("churn").alias("c"))
    rates = {r["late"]: r["c"] for r in late.collect()}
    assert rates[True] == pytest.approx(0.15, abs=0.03)
    assert rates[False] == pytest.approx(0.27, abs=0.03)


def test_matrix_files(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(37, 5)).astype(np.float32)
    np.savetxt(tmp_path / "m.txt", m, header="a comment")
    np.save(tmp_path / "c.npy", m)
    np.save(tmp_path / "f.npy", np.asfortranarray(m.astype(np.float64)))
    np.save(tmp_path / "one.npy", m[0])
    for name in ("m.txt", "c.npy", "f.npy"):
        table = matrices.read_matrix(spark, str(tmp_path / name), 200)
        assert table.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        rows = table.orderBy("vec_id").collect()
        assert [r["vec_id"] for r in rows] == list(range(37))
        assert np.allclose(np.array([r["embedding"] for r in rows]), m, atol=1e-6)
    one = matrices.read_matrix(spark, str(tmp_path / "one.npy")).collect()
    assert len(one) == 1 and np.allclose(one[0]["embedding"], m[0])
    assert matrices.read_matrix(spark, "") is None


def test_the_matrix_format_by_itself(spark, tmp_path):
    m = np.random.default_rng(2).normal(size=(50, 4)).astype(np.float32)
    text = "# top\n\n" + "\n".join(" ".join(map(str, r)) + ("  # note" if i % 3 else "")
                                     + ("\n" if i % 7 == 0 else "") for i, r in enumerate(m))
    (tmp_path / "m.txt").write_text(text)
    np.save(tmp_path / "m.npy", m)
    spark.dataSource.register(MatrixSource)
    for name, size in (("m.txt", 37), ("m.txt", 1000), ("m.npy", 64)):
        table = spark.read.format("matrix").option("part_bytes", size).load(str(tmp_path / name))
        rows = table.orderBy("vec_id").collect()
        assert [r["vec_id"] for r in rows] == list(range(50))
        assert np.allclose(np.array([r["embedding"] for r in rows]), m)
    (tmp_path / "none.txt").write_text("")
    assert matrices.read_matrix(spark, str(tmp_path / "none.txt")).count() == 0


def test_every_line_is_in_one_range():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lines = [bytes(rng.choice([32, 48, 49], rng.integers(0, 9)).tolist()) for _ in range(12)]
        data = b"\n".join(lines) + (b"\n" if rng.random() < 0.5 else b"")
        whole = [x for x in data.split(b"\n") if x]
        for size in (1, 3, 7, 100):
            got = [x for a, b in matrix_format.byte_ranges(len(data), size)
                   for x in matrix_format.lines_from(io.BytesIO(data), a, b) if x]
            assert got == whole


def test_texts_are_embedded_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    assert embeddings.size(spark, path) == 0
    assert embeddings.update(df.filter("id < 3"), "text", path, "first") == 1
    assert embeddings.update(df, "text", path, "second") == 2
    assert embeddings.update(df, "text", path, "third") == 0 and embeddings.size(spark, path) == 3
    got = {r["id"]: r["embedding"] for r in embeddings.of(df, "id", "text", path).collect()}
    want = {r["id"]: r["embedding"] for r in encoder.embed_texts(
        df.fillna({"text": ""}), "id", "text").collect()}
    assert got == want and got[1] == got[2] and got[4] == got[5] == [0.0] * 16
    (tmp_path / "store/commits/second").rename(tmp_path / "gone")  # as if the run had failed
    assert embeddings.size(spark, path) == 1 and embeddings.update(df, "text", path, "second") == 2


def test_datasets(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(20, 3))
    np.savetxt(tmp_path / "a.txt", m)
    np.savetxt(tmp_path / "x.txt", m[:1])
    (tmp_path / "d.json").write_text(json.dumps({
        "n": 20, "d": 3, "a_file": str(tmp_path / "a.txt"), "x_file": str(tmp_path / "x.txt"),
        "k": 4}, indent=1))
    data = matrices.read_dataset(spark, str(tmp_path / "d.json"))
    near = knn(data.queries, data.vectors, data.k).orderBy("rank").collect()
    want = np.argsort(((m - m[0]) ** 2).sum(1))[:4]
    assert [r["vec_id"] for r in near] == want.tolist()
    free = matrices.read_dataset(spark, "")
    table = np.array([r["embedding"] for r in free.vectors.collect()])
    assert table.shape == (1000, 100) and abs(table.mean()) < 0.02 and abs(table.std() - 1) < 0.02
    assert free.queries.count() == 1 and free.k == 10


def test_export(spark):
    rows = spark.range(50).select((F.col("id") % 2).alias("q"), F.col("id").alias("o"),
                                  F.col("id").alias("value"))
    out = {r["q"]: r for r in sinks.exported(rows, "q", "o", 20).collect()}
    assert out[0]["row_count"] == 20
    assert json.loads(out[1]["records"])[:2] == [{"value": 1}, {"value": 3}]


def test_traces(spark, sf, tmp_path):
    requests = spark.createDataFrame(
        [("a", "Top 3 locations by fare " + "x" * 200, 3, "l2", "s"), ("b", "bad", 0, "l2", "s")],
        "question_id string, query string, k int, metric string, session_id string")
    store = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id bigint, text string")
    done = answer(requests, store, tables.trips(spark, sf), tables.customers(spark, sf))
    records = sinks.trace_records(done, F.lit(12.5), F.lit("2024-05-01 10:00:00").cast("timestamp"))
    path = str(tmp_path / "trace")
    assert sinks.read_trace(spark, path) is None
    assert [sinks.append_trace(records, path, "one") for _ in range(3)] == [True, False, False]
    got = sinks.read_trace(spark, path)
    assert got.count() == 2 and (tmp_path / "trace/batches/folder=one/dt=2024-05-01").exists()
    ok = got.filter("status = 'ok'").first()
    assert len(ok["query"]) == 100 and ok["docs_retrieved"] == 2
    assert ok["full_query"] == "Top 3 locations by fare " + "x" * 200
    assert json.loads(ok["trace"])["latency_ms"] == 12.5
    failed = got.filter("status = 'error'").first()
    assert failed["error"] == failed["full_error"] == "k must be at least 1"
    assert json.loads(failed["trace"]) == {
        "query": "bad", "sql_query": None, "narrative": None, "bias_score": None,
        "latency_ms": 12.5, "timestamp": "2024-05-01T10:00:00.000Z", "error": "k must be at least 1"}


def test_long_errors_are_whole_beside_the_shortened_ones(spark):
    answers = spark.createDataFrame(
        [("q" * 150, "boom " * 100, [1])], "query string, error string, retrieved_docs array<int>"
    ).withColumns({c: F.lit(None).cast("string") for c in ("narrative", "sql_query", "session_id",
                                                           "metric", "k", "bias_score")})
    row = sinks.trace_records(answers, F.lit(1.0), F.lit("2024-05-01").cast("timestamp")).first()
    assert (len(row["query"]), len(row["full_query"])) == (100, 150)
    assert (len(row["error"]), len(row["full_error"])) == (200, 500)


def test_a_batch_without_its_marker_is_replaced(spark, tmp_path):
    path = str(tmp_path / "trace")
    rows = spark.range(5).withColumn("dt", F.lit("2024-05-01"))
    rows.limit(3).withColumn("batch_id", F.lit("two")).write.partitionBy("dt").parquet(
        f"{path}/batches/folder=two")
    assert sinks.append_trace(rows.limit(1), path, "one")
    assert sinks.read_trace(spark, path).count() == 1  # the half-written batch does not count
    assert sinks.append_trace(rows, path, "two")
    assert sinks.read_trace(spark, path).count() == 6


def test_encoders(spark, tmp_path):
    df = spark.createDataFrame([(0, "a b a"), (1, ""), (2, "Ünï b"), (3, "b b a")],
                               "id int, text string")
    pooled = {r["id"]: r["embedding"] for r in encoder.embed_texts(df, "id", "text").collect()}
    inline = {r["id"]: r["e"] for r in df.select(
        "id", encoder.embed_column(F.col("text")).alias("e")).collect()}
    assert all(np.allclose(pooled[i], inline[i]) for i in range(4))
    assert pooled[1] == [0.0] * 16
    cut = {r["id"]: r["embedding"] for r in
           encoder.embed_texts(df, "id", "text", max_tokens=1).collect()}
    assert np.allclose((2 * np.array(cut[0]) + np.array(cut[3])) / 3, pooled[0])
    lengths = encoder.encode_with(lambda texts: np.array([[len(t), 1] for t in texts]))
    assert [r[0] for r in df.orderBy("id").select(lengths("text")).collect()] == [
        [5, 1], [0, 1], [5, 1], [5, 1]]
