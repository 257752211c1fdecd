"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, chosen by a hash of the id.

    ``rows`` bounds what is broadcast and fitted on: of rows that share an id the one with the least
    text hash is taken. A null label or id is no label; an id labelled more than once counts as its
    rounded mean. Labels without a document are left out before the
    choice. Most ids are cut by a hash threshold in the tasks, so the final ordering sees a few
    times ``rows`` at most.
    """
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
             .join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(),
                   "doc_id", "left_semi"))
    steps = 1 << 20
    share = min(1.0, 2.0 * rows / max(1, labels.count()))
    place = F.xxhash64("doc_id")
    chosen = (known.filter(F.pmod(place, F.lit(steps)) < int(share * steps) + 1)
              .orderBy(place, "doc_id").limit(rows))
    own = F.struct(F.xxhash64("text").alias("h"), "text")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min(own).alias("own"))
            .select("doc_id", F.col("own.text").alias("text"), "y"))


def judged(scored: DataFrame, modulus: int, held: int, threshold: float) -> DataFrame:
    """``held_out`` by the id's remainder (false for a null id) and the 0/1 prediction."""
    return scored.select(
        "doc_id", F.coalesce(remainder("doc_id", modulus) == held, F.lit(False))
        .alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
