"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns they were given. ``run`` writes every stage to the shared folder and rereads it,
so a lost executor costs a stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, labelled, near_duplicates, packing, quality, repeats
from quillon.llm.queries import table
from quillon.session import ship, written

QUALITY_THRESHOLD = 0.7
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts. It is fitted on labelled ids outside the held-out
    fold."""
    labels = table(spark, sf_dir, "labels").filter(labelled.remainder("doc_id", 4) != 2)
    return quality.keep(docs, quality.fit(docs, labels), QUALITY_THRESHOLD)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate group: that with the smallest id, rows without an id last."""
    return near_duplicates.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the words of passages that an earlier document holds too."""
    return repeats.remove(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every text that is left, with its sequence and place."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_copies),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: The fitted model, tiling, automata and packing have no SQL form; tests hold every stage against a
#: plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
