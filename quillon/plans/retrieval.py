"""Texts found for a question, and the prompts made of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.functions.vectors import rounded
from quillon.operators.encoder import embed_column, embed_texts, encode_with
from quillon.operators.neighbours import knn
from quillon.session import checkpoint_dir
from quillon.sources import embeddings, tables

PROMPT_DOCUMENTS = 2


def retrieve(questions: DataFrame, store: DataFrame, k: int, metric: str | Column = "l2",
             eps: float = C.RETRIEVAL_EPS, k_column: Column | None = None,
             encode: Callable[[Column], Column] | None = None,
             vectors: DataFrame | None = None) -> DataFrame:
    """``(question_id, rank, doc_id, distance, text)`` for questions(question_id, query, ...) over
    store(doc_id, text).

    Question ids are unique. ``encode`` turns a text column into vectors of a model of
    the caller's (``encoder.encode_with``); without it both sides get mean token vectors, questions
    within their row. ``vectors`` (doc_id, embedding) are the store's if they are kept, see
    ``sources.embeddings``. The store is counted before anything of it is embedded.
    """
    asked = questions.withColumn("embedding", encode(F.col("query")) if encode else embed_column(
        F.coalesce("query", F.lit(""))))
    if vectors is not None:
        passages = vectors.select("doc_id", "embedding")
    elif encode:
        passages = store.select("doc_id", encode(F.col("text")).alias("embedding"))
    else:
        passages = embed_texts(store, "doc_id", "text")
    found = knn(asked, passages, k, metric, eps, k_column, query_id="question_id", vec_id="doc_id",
                count_base=store.count)
    return (found.withColumnsRenamed({"query_id": "question_id", "vec_id": "doc_id"})
            .join(store.select("doc_id", "text"), "doc_id")
            .select("question_id", "rank", "doc_id", "distance", "text"))


def in_rank_order(column: str) -> Column:
    """The column's values of a group as an array by rank; groups hold at most k rows."""
    return F.transform(F.sort_array(F.collect_list(F.struct("rank", column))),
                       lambda r: r[column])


def prompts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """``(question_id, query, prompt)``; a question for which nothing was found keeps its row."""
    context = found.groupBy("question_id").agg(
        F.array_join(in_rank_order("text"), "\n").alias("context"))
    return questions.join(context, "question_id", "left").select(
        "question_id", "query", prompt(F.col("query"), F.coalesce("context", F.lit(""))))


# --- fixed values: the parts of a prompt --------------------------------------------------------
BEFORE_QUERY, BEFORE_CONTEXT, AFTER_CONTEXT = "Question: ", "\nContext:\n", "\nAnswer:"


def prompt(query: Column, context: Column) -> Column:
    return F.concat(F.lit(BEFORE_QUERY), query, F.lit(BEFORE_CONTEXT), context,
                    F.lit(AFTER_CONTEXT)).alias("prompt")


def prompt_text(query: str, context: str) -> str:
    """The same prompt inside a task."""
    return f"{BEFORE_QUERY}{query}{BEFORE_CONTEXT}{context}{AFTER_CONTEXT}"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = tables.read(spark, folder, "documents").select("doc_id", "text")
    return tables.spread(documents, "doc_id")


def pool_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    pooled = embed_texts(_documents(spark, folder), "doc_id", "text")
    return pooled.select("doc_id", F.posexplode("embedding").alias("position", "v")).select(
        "doc_id", "position", rounded(F.col("v"), 6).alias("value"))


def retrieve_docs(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieve(tables.user_turns(spark, folder), _documents(spark, folder), 10)
    return found.withColumn("distance", rounded(F.sqrt("distance")))


def rag_prompts(spark: SparkSession, folder: str) -> DataFrame:
    asked = tables.user_turns(spark, folder)
    return prompts(asked, retrieve(asked, _documents(spark, folder), PROMPT_DOCUMENTS))


def retrieve_docs_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The same finds from kept embeddings; documents that the store knows are not embedded again."""
    documents = _documents(spark, folder)
    path = f"{checkpoint_dir(spark)}/embeddings-{uuid.uuid4().hex}"
    embeddings.update(documents.filter("doc_id % 2 = 0"), "text", path, "even")
    embeddings.update(documents, "text", path, "all")
    kept = embeddings.of(documents, "doc_id", "text", path)
    found = retrieve(tables.user_turns(spark, folder), documents, 10, vectors=kept)
    return found.withColumn("distance", rounded(F.sqrt("distance")))


def embed_with_encoder(spark: SparkSession, folder: str) -> DataFrame:
    """Documents encoded by a model plugged in: here one that counts characters and vowels."""
    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[len(t), *(t.count(v) for v in "aeiou")] for t in texts], np.float32)

    vectors = _documents(spark, folder).select(
        "doc_id", encode_with(encode)(F.coalesce("text", F.lit(""))).alias("embedding"))
    return vectors.select("doc_id", F.posexplode("embedding").alias("position", "value"))
