"""The flagship: every request of a log turned into its full answer row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.functions.audit import answer_bias
from quillon.functions.guards import is_safe, validated_requests
from quillon.plans.questions import answered
from quillon.plans.retrieval import in_rank_order, retrieve
from quillon.session import written
from quillon.sources import tables


def answer(requests: DataFrame, store: DataFrame, trips: DataFrame, customers: DataFrame) -> DataFrame:
    """Answer rows for requests(question_id, query, k, metric, session_id).

    Requests that fail validation come back with the reason as their error and nothing else.
    Equal requests are written once and search the store once. Joining the finds back meets hot requests on the request
    side only, where a skewed partition may be split.
    """
    checked = validated_requests(requests)
    good = checked.filter(F.col("reject_reason").isNull())
    distinct = written(good.groupBy("query", "k", "metric").agg(
        F.min("question_id").alias("question_id")), "distinct-questions")
    found = retrieve(distinct, store, C.MAX_K, F.col("metric"), k_column=F.col("k"))
    finds = (found.groupBy("question_id")
             .agg(in_rank_order("text").alias("retrieved_docs"),
                  in_rank_order("doc_id").alias("retrieved_ids"))
             .join(distinct, "question_id").drop("question_id"))
    rows = (
        answered(good, trips, customers)
        .join(finds, ["query", "k", "metric"], "left")
        .select(
            "question_id", "query", "session_id", "k", "metric",
            is_safe(F.col("query")).alias("is_safe"), F.col("statement").alias("sql_query"),
            "sql_result", "error", "narrative", "viz_code",
            answer_bias(F.col("narrative"))["bias_score"].alias("bias_score"),
            F.coalesce("retrieved_docs", F.array().cast("array<string>")).alias("retrieved_docs"),
            F.coalesce("retrieved_ids", F.array().cast("array<bigint>")).alias("retrieved_ids"))
    )
    refused = checked.filter(F.col("reject_reason").isNotNull()).select(
        "question_id", "query", "session_id", "k", "metric",
        F.col("reject_reason").alias("error"))
    return rows.unionByName(refused, allowMissingColumns=True)


def brief(answers: DataFrame) -> DataFrame:
    """The short answer shape: the query and its sentence."""
    return answers.select("query", F.col("narrative").alias("result"))


def agent_answers(spark: SparkSession, folder: str) -> DataFrame:
    """All logged questions over all trips and customers, with context from the short passages.

    The found texts and ids are shown as joined text.
    """
    store = tables.read(spark, folder, "benchmark").select(
        F.col("item_id").alias("doc_id"), "text")
    rows = answer(tables.question_log(spark, folder), store, tables.trips(spark, folder),
                  tables.customers(spark, folder))
    return rows.withColumns({
        "retrieved_docs": F.array_join("retrieved_docs", "\n"),
        "retrieved_ids": F.array_join(F.col("retrieved_ids").cast("array<string>"), ",")})
