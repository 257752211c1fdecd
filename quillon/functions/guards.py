"""Safety columns: harmful queries, statement guards, redaction, request validation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.functions.scalars import contains_any, first_contained


def _needed_words(pattern: str) -> list[list[str]]:
    """The word alternatives that any match of a harmful pattern must contain."""
    bare = re.sub(r"\\[bs]", " ", pattern)
    return [group.split("|") for group in re.findall(r"[a-z][a-z|]+", bare)]


def _harmful(lowered: Column) -> Column:
    """Any harmful pattern. Plain substring tests come first, and spare most texts the pattern.

    ``.`` stops at a newline only.
    """
    def matches(pattern: str) -> Column:
        needed = [contains_any(lowered, words) for words in _needed_words(pattern)]
        return reduce(lambda a, b: a & b, [*needed, lowered.rlike(f"(?Ud){pattern}")])

    return reduce(lambda a, b: a | b, [matches(p) for p in C.HARMFUL_PATTERNS])


def is_safe(text: Column) -> Column:
    """For short texts; ``with_safety`` lower-cases long ones only once."""
    low = F.lower(text)
    return ~F.coalesce(_harmful(low) | contains_any(low, C.BLOCKED_TOPICS), F.lit(False))


def with_safety(df: DataFrame, text: str, out: str = "safety") -> DataFrame:
    """``df`` plus ``struct(is_safe, reason, modified_query)``; an empty query is safe."""
    low = F.col("_low")
    topic = first_contained(low, C.BLOCKED_TOPICS)
    reason = (
        F.when(_harmful(low), "Query contains potentially harmful content")
        .otherwise(F.concat(F.lit("Query contains blocked topic: "), topic))
    )
    judged = df.withColumn("_low", F.lower(text)).withColumn("_reason", reason)
    safe = F.col("_reason").isNull()
    return judged.withColumn(out, F.struct(
        safe.alias("is_safe"), F.col("_reason").alias("reason"),
        F.when(safe, F.col(text)).alias("modified_query"))).drop("_low", "_reason")


def forbidden_operation(statement: Column) -> Column:
    """Error text naming the first forbidden word of a read-only statement, else NULL."""
    word = first_contained(F.upper(statement), C.READ_ONLY_FORBIDDEN)
    return F.when(word.isNotNull(), F.concat(F.lit("Forbidden SQL operation: "), word))


def sanitize_sql(statement: Column) -> Column:
    """The statement unchanged, or NULL if it is empty, writes, comments or is stacked."""
    parts = F.filter(F.split(statement, ";"), lambda p: p.rlike(r"(?U)\S"))
    unsafe = (
        (statement == "")
        | contains_any(F.upper(statement), C.SANITIZE_FORBIDDEN)
        | contains_any(statement, ["--", "/*"])
        | (F.size(parts) > 1)
    )
    return F.when(~unsafe, statement)


def redact_pii(text: Column) -> Column:
    """E-mails, phones, SSNs and cards replaced, each rule over the result of the one before."""
    return reduce(
        lambda c, rule: F.regexp_replace(c, f"(?U){rule[0]}", rule[1].replace("[", r"\[")),
        C.PII_PATTERNS, text)


def validated_requests(requests: DataFrame) -> DataFrame:
    """Requests with defaults filled in, and ``reject_reason`` where a field is out of range.

    Filter on ``reject_reason IS NULL`` for the good ones; the rest is the quarantine.
    """
    k = F.coalesce("k", F.lit(C.DEFAULT_K))
    reason = (
        F.when(F.col("query").isNull(), "query is required")
        .when(k < C.MIN_K, f"k must be at least {C.MIN_K}")
        .when(k > C.MAX_K, f"k must be at most {C.MAX_K}")
    )
    session = F.when(F.coalesce("session_id", F.lit("")) == "", C.DEFAULT_SESSION)\
        .otherwise(F.col("session_id"))
    return requests.withColumns({
        "reject_reason": reason,
        "k": k,
        "metric": F.coalesce("metric", F.lit(C.DEFAULT_METRIC)),
        "session_id": session,
        "query_length": F.length("query"),
    })
