"""A kept store of text embeddings, by digest of the text: no text is embedded twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.encoder import embed_texts
from quillon.session import written
from quillon.sources import committed


def _digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest")


def update(texts: DataFrame, text: str, path: str, batch_id: str,
           encode: Callable[[Column], Column] | None = None) -> int:
    """Embed the texts that the store at ``path`` does not hold; how many those were.

    The new embeddings are one batch, which counts when it is whole: a run that fails leaves the
    store as it was, and one with the same ``batch_id`` that got through is not repeated. Equal
    texts are embedded once; null counts as the empty text.
    """
    spark = texts.sparkSession
    kept = committed.read(spark, path)
    asked = texts.select(_digest(text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if kept is not None:
        asked = asked.join(kept.select("digest"), "digest", "left_anti")
    fresh = written(asked.dropDuplicates(["digest"]), "fresh-texts")
    made = fresh.select("digest", encode(F.col("text")).alias("embedding")) if encode else \
        embed_texts(fresh, "digest", "text")
    count = fresh.count()
    if count:
        committed.append(made, path, batch_id)
    return count


def of(rows: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``(key, embedding)`` of all rows whose text the store holds."""
    kept = committed.read(rows.sparkSession, path)
    if kept is None:
        raise ValueError(f"no embeddings are kept at {path}")
    return rows.select(key, _digest(text)).join(kept.select("digest", "embedding"), "digest").select(
        key, "embedding")


def size(spark: SparkSession, path: str) -> int:
    kept = committed.read(spark, path)
    return 0 if kept is None else kept.count()
