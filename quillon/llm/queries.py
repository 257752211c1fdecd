"""The registered queries of the training-data operators, with their contracts' columns."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontamination, divergence, hnsw, labelled, licenses, near_duplicates, oracles, packing, personal, quality, repeats, sharding, spellings, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op1_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"),
                                 table(spark, sf_dir, "benchmark"))


def op2_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op6_rare_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(labelled.remainder("doc_id", 5) != 0))
    return labelled.judged(toxicity.score(docs, model), 5, 0, 0.5)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("word_bpe_49k.json"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), 3, 85)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(labelled.remainder("doc_id", 4) != 2))
    return labelled.judged(quality.score(docs, model), 4, 2, 0.7)


def op11_pair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_checked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(table(spark, sf_dir, "documents"))


def op13_bloom_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op9_minhash": op9_minhash,
    "op10_quality": op10_quality,
    "op1_string_tiling": op1_string_tiling,
    "op2_path_templates": op2_path_templates,
    "op3_repeated_phrases": op3_repeated_phrases,
    "op4_label_propagation": op4_label_propagation,
    "op5_hnsw": op5_hnsw,
    "op6_rare_token_index": op6_rare_token_index,
    "op7_toxicity": op7_toxicity,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op11_pair_merge": op11_pair_merge,
    "op12_checked_spans": op12_checked_spans,
    "op13_bloom_edits": op13_bloom_edits,
}
ORACLES: dict[str, str] = oracles.ORACLES
