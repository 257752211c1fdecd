"""Guards, redaction and bias scores run over the text, statement and question tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import audit, guards
from quillon.functions.scalars import preview
from quillon.sources import tables


def guard_sql_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return tables.statement_log(spark, folder).withColumn(
        "error", guards.forbidden_operation(F.col("statement")))


def sanitize_sql(spark: SparkSession, folder: str) -> DataFrame:
    return tables.statement_log(spark, folder).withColumn(
        "sanitized", guards.sanitize_sql(F.col("statement")))


def check_query(spark: SparkSession, folder: str) -> DataFrame:
    checked = guards.with_safety(tables.texts(spark, folder), "text")
    return checked.select("text_id", "safety.is_safe", "safety.reason", "safety.modified_query")


def redact_pii(spark: SparkSession, folder: str) -> DataFrame:
    return tables.texts(spark, folder).select(
        "text_id", guards.redact_pii(F.col("text")).alias("redacted"))


def validate_requests(spark: SparkSession, folder: str) -> DataFrame:
    return guards.validated_requests(tables.question_log(spark, folder))


def recent_user_queries(spark: SparkSession, folder: str) -> DataFrame:
    return tables.user_turns(spark, folder).select(
        "question_id",
        preview(F.col("query")).alias("shown_query"),
        F.right("session_id", F.lit(8)).alias("shown_session"),
        F.lit("User").alias("type"),
    )


def bias_analyze(spark: SparkSession, folder: str) -> DataFrame:
    scored = audit.with_bias(tables.texts(spark, folder), "text")
    return scored.select(
        "text_id", "bias.bias_score", "bias.category", "bias.details", "bias.male_terms",
        "bias.female_terms", "bias.stereotypes_found",
        F.array_join("bias.recommendations", " | ").alias("recommendations"))


def bias_tool(spark: SparkSession, folder: str) -> DataFrame:
    scored = tables.texts(spark, folder).withColumn("b", audit.answer_bias(F.col("text")))
    return scored.select("text_id", "b.bias_score", "b.details")


def ethics_report(spark: SparkSession, folder: str) -> DataFrame:
    """Each text reported on, read both as the answer and as the query that asked for it."""
    report = audit.with_ethics_report(
        tables.texts(spark, folder).withColumn("query", F.col("text")), "text", "query")
    return report.select(
        "text_id", "ethics.ethical_score", "ethics.passed", "bias.bias_score",
        "ethics.query_safety.is_safe", "ethics.summary")


def bias_by_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.spread(tables.read(spark, folder, "documents").select(
        "doc_id", "lang", "source", "text"), "doc_id")
    score, category = F.col("bias.bias_score"), F.col("bias.category")
    # scores have four decimals: whole ten-thousandths add up the same in any order
    mean = F.sum(F.round(score * 10000).cast("bigint")) / F.count("*") / 10000
    return (
        audit.with_bias(docs, "text").groupBy("lang", "source")
        .agg(F.count("*").alias("documents"),
             F.round(mean, 4).alias("avg_bias"),
             F.max(score).alias("max_bias"),
             F.count_if(category == "high").alias("high"),
             F.count_if(category == "moderate").alias("moderate"))
    )
