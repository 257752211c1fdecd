"""Gender-bias scores and the combined ethics report, as columns over any text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.functions.guards import with_safety
from quillon.functions.scalars import (
    blank, common, percent_text, score_round, space_tokens, word_tokens,
)


def with_bias(df: DataFrame, text: str) -> DataFrame:
    """``df`` plus a ``bias`` struct.

    Counts are taken once in a first projection; the later ones only combine them.
    """
    male, female, stereo, total = (F.col(c) for c in ("_male", "_female", "_stereo", "_total"))
    words = F.array_distinct(word_tokens(F.col(text)))
    counted = (
        df.withColumn("_words", words)
        .withColumns({
            "_male": common(F.col("_words"), C.AUDIT_MALE),
            "_female": common(F.col("_words"), C.AUDIT_FEMALE),
            "_stereo": common(F.col("_words"), C.AUDIT_STEREOTYPES),
            "_total": F.size("_words"),
            "_blank": blank(F.col(text)),
        })
        .drop("_words")
    )
    gendered = male + female
    imbalance = F.when(gendered == 0, 0.0).otherwise(
        F.abs(male - female) / F.when(gendered > 0, gendered))
    softened = F.when((total < 20) & (gendered == 1), imbalance * 0.5).otherwise(imbalance)
    share = F.when(stereo == 0, 0.0).otherwise(stereo / F.when(total > 0, total))
    raw = F.lit(0.7) * softened + F.lit(0.3) * F.least(share * 10, F.lit(1.0))
    score = F.when(F.col("_blank"), 0.0).otherwise(F.least(score_round(raw), F.lit(1.0)))
    s = F.col("_score")
    category = (F.when(F.col("_blank"), "neutral").when(s < 0.1, "minimal").when(s < 0.3, "low")
                .when(s < 0.5, "moderate").otherwise("high"))
    details = F.when(F.col("_blank"), "No text provided").otherwise(F.format_string(
        "Male terms: %d, Female terms: %d, Stereotypes: %d", male, female, stereo))
    advice = F.array_compact(F.array(
        F.when(male > female + 2, "Consider using more gender-neutral language"),
        F.when(female > male + 2, "Consider balancing gendered references"),
        F.when(stereo > 2, "Review stereotypical language usage"),
    ))
    zero_if_blank = {n: F.when(F.col("_blank"), 0).otherwise(c)
                     for n, c in (("male_terms", male), ("female_terms", female),
                                  ("stereotypes_found", stereo))}
    return (
        counted.withColumn("_score", score)
        .withColumn("bias", F.struct(
            s.alias("bias_score"), category.alias("category"), details.alias("details"),
            *[c.alias(n) for n, c in zero_if_blank.items()],
            F.when(F.col("_blank"), F.array().cast("array<string>")).otherwise(advice)
            .alias("recommendations")))
        .drop("_male", "_female", "_stereo", "_total", "_blank", "_score")
    )


def answer_bias(text: Column) -> Column:
    """``struct(bias_score, details)`` from whitespace tokens and the short word lists."""
    words = space_tokens(text)
    male, female = common(words, C.ANSWER_MALE), common(words, C.ANSWER_FEMALE)
    gendered = male + female
    empty = F.coalesce(text, F.lit("")) == ""
    score = F.when(empty | (gendered == 0), 0.0).otherwise(
        score_round(F.abs(male - female) / F.when(gendered > 0, gendered)))
    details = (
        F.when(empty, "No text provided")
        .when(gendered == 0, "No gendered language detected")
        .otherwise(F.format_string("Male terms: %d, Female terms: %d", male, female))
    )
    return F.struct(score.alias("bias_score"), details.alias("details"))


def with_ethics_report(df: DataFrame, text: str, query: str) -> DataFrame:
    """``df`` plus ``bias`` and an ``ethics`` struct; a missing query counts as safe."""
    scored = with_safety(with_bias(df, text), query, "_safety")
    safe = F.col("_safety.is_safe")
    penalty = F.when(safe, 0.0).otherwise(0.5)
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("bias.bias_score") * 0.5 - penalty)
    return (
        scored.withColumn("_ethical", score)
        .withColumn("ethics", F.struct(
            score_round(F.col("_ethical")).alias("ethical_score"),
            (F.col("_ethical") >= 0.5).alias("passed"),
            F.col("_safety").alias("query_safety"),
            F.concat(
                F.lit("Ethical score: "), percent_text(F.col("_ethical")),
                F.lit(" | Bias: "), F.col("bias.category"),
                F.lit(" | Safe: "), F.when(safe, "True").otherwise("False"),
            ).alias("summary")))
        .drop("_safety", "_ethical")
    )
