"""Slots, answers, charts and sentences for known questions, against the statements run in DuckDB."""

import json

import duckdb
import pytest

from quillon.functions.slots import with_slots
from quillon.plans import answers, questions
from quillon.sources import tables

ASKED = {
    "Top 5 locations by fare": "SELECT location, SUM(fare) as sum_fare FROM trips "
                               "GROUP BY location ORDER BY sum_fare DESC LIMIT 5",
    "Bottom 10 locations by fare": "SELECT location, SUM(fare) as sum_fare FROM trips "
                                   "GROUP BY location ORDER BY sum_fare ASC LIMIT 10",
    "Churn rate by region": "SELECT region, AVG(churn) * 100 as churn_rate, COUNT(*) as total "
                            "FROM customers GROUP BY region ORDER BY churn_rate DESC LIMIT 5",
    "Average revenue by region": "SELECT region, AVG(revenue) as avg_revenue FROM customers "
                                 "GROUP BY region ORDER BY avg_revenue DESC LIMIT 5",
    "Trips by month": "SELECT strftime('%Y-%m', pickup_date), COUNT(*) as count FROM trips "
                      "GROUP BY strftime('%Y-%m', pickup_date) ORDER BY count DESC LIMIT 5",
    "Average fare by passengers": "SELECT passengers, AVG(fare) as avg_fare FROM trips "
                                  "GROUP BY passengers ORDER BY avg_fare DESC LIMIT 5",
    "Tenure vs churn analysis": "SELECT tenure, AVG(churn) as avg_churn FROM customers "
                                "GROUP BY tenure ORDER BY avg_churn DESC LIMIT 5",
    "Revenue by month": "SELECT region, SUM(revenue) as sum_revenue FROM customers "
                        "GROUP BY region ORDER BY sum_revenue DESC LIMIT 5",
    "number of customers": "SELECT region, COUNT(revenue) as count_revenue FROM customers "
                           "GROUP BY region ORDER BY count_revenue DESC LIMIT 5",
    "topic of 3 babies": "SELECT location, SUM(fare) as sum_fare FROM trips "
                         "GROUP BY location ORDER BY sum_fare DESC LIMIT 3",
    "lowest 30 trips by zone": "SELECT location, COUNT(*) as count FROM trips "
                               "GROUP BY location ORDER BY count ASC LIMIT 30",
}
BROKEN = {"Customers by location": "no such column: location",
          "Customer fare by region": "no such column: fare"}
QUIET = ["Hello there", "", "Top 0 locations by fare"]


@pytest.fixture(scope="module")
def base(spark, sf):
    return tables.trips(spark, sf).cache(), tables.customers(spark, sf).cache()


@pytest.fixture(scope="module")
def answered(spark, base):
    rows = [(str(i), q) for i, q in enumerate([*ASKED, *BROKEN, *QUIET])]
    df = questions.answered(spark.createDataFrame(rows, "question_id string, query string"), *base)
    got = df.withColumnsRenamed({"sql_result": "result", "viz_code": "chart"})
    return {r["query"]: r for r in got.collect()}


def test_statements(answered):
    assert {q: answered[q]["statement"] for q in ASKED} == ASKED


def test_answers_equal_the_statements(answered, base):
    con = duckdb.connect()
    con.register("trips", base[0].toPandas())
    con.register("customers", base[1].toPandas())
    for query, statement in ASKED.items():
        sql = statement.replace("strftime('%Y-%m', pickup_date)",
                                "strftime(pickup_date, '%Y-%m')")
        want = con.execute(sql).fetchall()[:20]
        rows = json.loads(answered[query]["result"])
        assert len(rows) == len(want), query
        for row, expected in zip(rows, want):
            value = list(row.values())[1]
            assert value == pytest.approx(expected[1], abs=1e-4), query
        if len({w[1] for w in want}) == len(want):
            assert [str(list(r.values())[0]) for r in rows] == [str(w[0]) for w in want], query


def test_problems_become_errors(answered):
    for query, error in BROKEN.items():
        assert answered[query]["error"] == error and answered[query]["result"] is None


def test_nothing_to_show(answered):
    for query in QUIET:
        row = answered[query]
        assert row["result"] is None and row["chart"] is None and row["error"] is None
        assert row["narrative"] == f"Query processed: {query}. See visualization for details."
    assert answered["Hello there"]["statement"] is None


def test_charts(answered):
    chart = json.loads(answered["Top 5 locations by fare"]["chart"])
    rows = json.loads(answered["Top 5 locations by fare"]["result"])
    series, layout = chart["data"][0], chart["layout"]
    assert series["x"] == [0, 1, 2, 3, 4] and series["y"] == [r["sum_fare"] for r in rows]
    assert layout["xaxis"]["ticktext"] == [f"Loc {r['location']}" for r in rows]
    assert series["text"] == [f"{r['sum_fare']:.2f}" for r in rows]
    assert series["hovertext"][0] == f"Loc {rows[0]['location']}: {rows[0]['sum_fare']:.2f}"
    assert layout["title"] == "Sum Fare by Location" and layout["showlegend"] is False
    months = json.loads(answered["Trips by month"]["chart"])
    assert all(isinstance(y, int) for y in months["data"][0]["y"])
    regions = json.loads(answered["Churn rate by region"]["chart"])["layout"]["xaxis"]["ticktext"]
    assert "Middle East" in regions


def test_sentences(answered):
    row = answered["Churn rate by region"]
    top = json.loads(row["result"])[0]
    assert row["narrative"] == (
        f"Analysis: Found 5 results. Top result: Geographic region '{top['region']}' has the "
        f"highest churn rate of {top['churn_rate']:.2f}. This segment requires retention focus.")
    top = json.loads(answered["Trips by month"]["result"])[0]
    assert answered["Trips by month"]["narrative"] == (
        f"Analysis: Found 5 results. Top result: month '{top['month']}' has "
        f"{top['count']:.2f} total records.")


def test_slots_of_odd_numbers(spark):
    df = spark.createDataFrame([("top 99999999999999999999 x",), ("top 7 or 8",)], "query string")
    assert [r["row_limit"] for r in with_slots(df).collect()] == [5, 7]


def test_full_answers(spark, base):
    requests = spark.createDataFrame(
        [("a", "Top 3 locations by fare", None, None, None),
         ("b", "he hacks the server attack on a server", 2, "cosine", "s1"),
         ("c", "too many", 51, "l2", "s1"), ("d", "Top 3 locations by fare", None, None, "s2")],
        "question_id string, query string, k int, metric string, session_id string")
    store = spark.createDataFrame([(i, f"passage {i} about fare") for i in range(4)],
                                  "doc_id bigint, text string")
    got = {r["question_id"]: r for r in answers.answer(requests, store, *base).collect()}
    assert got["a"]["session_id"] == "default" and len(got["a"]["retrieved_docs"]) == 4
    assert got["a"]["retrieved_docs"] == got["d"]["retrieved_docs"]
    assert len(got["b"]["retrieved_docs"]) == 2 and not got["b"]["is_safe"]
    assert got["b"]["bias_score"] == 1.0 and got["b"]["sql_query"] is None
    assert got["c"]["error"] == "k must be at most 50" and got["c"]["narrative"] is None
    brief = answers.brief(answers.answer(requests, store, *base))
    assert brief.columns == ["query", "result"] and brief.count() == 4
