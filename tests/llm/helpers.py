"""Small tables for the operators' tests: awkward rows first."""

from __future__ import annotations

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def docs(spark, rows, **extra):
    """``rows``: (doc_id, text). Extra columns may clash with names used inside an operator."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [(i, t, None, None, None if t is None else len(t)) for i, t in rows], DOCS)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def awkward(long_words: int = 30_000):
    """Null and empty texts, null and repeated ids, white space only, other scripts, a long text."""
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "no id here"),
            (5, "Größe ΑΣ 東京 é  x\u0085y <|endoftext|> don't"), (None, None),
            (6, " ".join(f"w{i % 977}" for i in range(long_words)))]
