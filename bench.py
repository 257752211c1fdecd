"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local threads. Every query is run to the end
into a sink that keeps nothing; a first small pass loads the JVM and the Python workers. Beside the
queries two comparisons are timed: exact search against inverted cells, and all questions in one
pass against one statement at a time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sample_top_locations", "sample_avg_fare_by_passengers", "sample_churn_by_region",
    "sample_tenure_buckets", "sample_trips_per_month", "question_answers", "chart_specs",
    "narratives", "agent_answers", "retrieve_docs", "rag_prompts", "pool_embeddings", "knn_l2",
    "knn_cosine", "knn_dot", "knn_manhattan", "kmeans_l2", "ivf_search", "ivf_single_probe",
    "graph_edges", "graph_search", "recall_by_method", "bias_analyze", "redact_pii",
    "check_query", "batch_groups",
    "latency_percentiles", "session_series", "sql_joins", "sql_windows",
]
ONE_BY_ONE = 20


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    start = time.time()
    work()
    return round(time.time() - start, 3)


def main() -> None:
    from quillon.operators import ivf
    from quillon.operators.neighbours import knn
    from quillon.plans import questions
    from quillon.plans import vector_queries as vq
    from quillon.plans.registry import QUERIES
    from quillon.session import build_session
    from quillon.sources import catalog, tables

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in ("sample_top_locations", "knn_l2"):
            run(QUERIES[name](spark, small))
    seconds = {name: timed(lambda n=name: run(QUERIES[n](spark, folder))) for name in names}

    extra = {}
    if not sys.argv[1:]:
        table = vq.vectors(spark, folder)
        asked = vq.as_queries(table)
        index = ivf.ivf(table, "l2")
        index.members.persist().count()
        extra["exact_all_vectors"] = timed(lambda: run(knn(asked, table, 10)))
        extra["cells_all_vectors_fitted"] = timed(lambda: run(ivf.search(asked, index)))
        index.members.unpersist()
        tables.register(spark, folder)
        asked_for = questions.answered(
            tables.question_log(spark, folder), tables.trips(spark, folder),
            tables.customers(spark, folder)).filter("row_count > 0")
        statements = [r["statement"].replace("strftime('%Y-%m', pickup_date)",
                                             "date_format(pickup_date, 'yyyy-MM')")
                      for r in asked_for.select("statement").distinct()
                      .orderBy("statement").limit(ONE_BY_ONE).collect()]

        def one_by_one() -> None:
            for text in statements:
                df, _ = catalog.run_sql(spark, text)
                if df is not None:
                    run(df)

        extra[f"statements_one_by_one_{ONE_BY_ONE}"] = timed(one_by_one)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
        "comparisons": extra}))


if __name__ == "__main__":
    main()
