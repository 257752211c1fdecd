"""Text functions callable from SQL, over the same fixed values as the column versions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillon import constants as C
from quillon.functions import vectors


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(words: list[str]) -> str:
    return "array(" + ", ".join(_quoted(w) for w in words) + ")"


def _redacted() -> str:
    out = "t"
    for pattern, tag in C.PII_PATTERNS:
        out = f"regexp_replace({out}, {_quoted('(?U)' + pattern)}, {_quoted(tag)})"
    return out


def _safe() -> str:
    harmful = [f"lower(t) RLIKE {_quoted('(?Ud)' + p)}" for p in C.HARMFUL_PATTERNS]
    topics = [f"contains(lower(t), {_quoted(w)})" for w in C.BLOCKED_TOPICS]
    return f"NOT coalesce({' OR '.join(harmful + topics)}, false)"


_WORDS = r"array_distinct(regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+', 0))"
_COUNT = "size(array_intersect(audit_words(t), {0}))"

TEXT_FUNCTIONS = {
    "redact_pii": f"(t STRING) RETURNS STRING RETURN {_redacted()}",
    "is_safe_query": f"(t STRING) RETURNS BOOLEAN RETURN {_safe()}",
    "audit_words": f"(t STRING) RETURNS ARRAY<STRING> RETURN {_WORDS}",
    "gender_share": "(m INT, f INT, words INT) RETURNS DOUBLE RETURN CASE WHEN m + f = 0 THEN 0D "
                    "ELSE abs(m - f) / greatest(m + f, 1) "
                    "* CASE WHEN words < 20 AND m + f = 1 THEN 0.5D ELSE 1D END END",
    "bias_formula": "(m INT, f INT, s INT, words INT) RETURNS DOUBLE RETURN least(1D, "
                    "double(format_number(0.7D * gender_share(m, f, words) + 0.3D * "
                    "least(10D * s / greatest(words, 1), 1D), '0.0000')))",
    "bias_score": "(t STRING) RETURNS DOUBLE RETURN coalesce(bias_formula("
                  + ", ".join(_COUNT.format(_array(w)) for w in (
                      C.AUDIT_MALE, C.AUDIT_FEMALE, C.AUDIT_STEREOTYPES))
                  + ", size(audit_words(t))), 0D)",
}


def register(spark: SparkSession) -> None:
    """Distances, redaction, safety and bias as temporary SQL functions of the session."""
    vectors.register_sql_functions(spark)
    for name, body in TEXT_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
