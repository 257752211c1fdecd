"""Matrix files and dataset descriptors as vector tables ``(vec_id, embedding)``."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.matrix_format import (
    PART_BYTES, MatrixSource, byte_ranges, lines_from, numbers, opened)
from quillon.sources.synthetic import uniform

# --- fixed values: size of the default random dataset ------------------------------------------
DEFAULT_ROWS, DEFAULT_WIDTH, DEFAULT_K = 1000, 100, 10


@dataclass
class Dataset:
    n: int
    d: int
    vectors: DataFrame
    queries: DataFrame | None
    k: int


def read_matrix(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame | None:
    """A ``.npy`` or whitespace-separated text matrix, rows numbered from 0; None for no path.

    Rows of a text are in file order; comments after ``#`` and empty lines do not count. Its rows are
    counted per byte range in the tasks, so that each range can number its own.
    """
    if path == "":
        return None
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format("matrix").option("part_bytes", part_bytes)
    if not path.endswith(".npy"):
        reader = reader.option("rows_before", json.dumps(_rows_before(spark, path, part_bytes)))
    return reader.load(path)


def _rows_before(spark: SparkSession, path: str, part_bytes: int) -> list[int]:
    """For each byte range the number of rows that start before it: a number per range."""
    with opened(path) as handle:
        cuts = byte_ranges(handle.size(), part_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch["id"].to_pylist():
                with opened(path) as handle:
                    n = sum(numbers(line) is not None for line in lines_from(handle, *cuts[number]))
                yield pa.record_batch({"part": pa.array([number]), "n": pa.array([n])})

    found = spark.range(0, len(cuts), 1, len(cuts)).mapInArrow(count, "part bigint, n bigint")
    counts = [r["n"] for r in sorted(found.collect(), key=lambda r: r["part"])]
    return [sum(counts[:i]) for i in range(len(counts))]


def normal_vector(key: Column, salt: str, width: int) -> Column:
    """Standard normal numbers that depend on the key and position alone."""
    def at(i: Column) -> Column:
        cell = F.concat(key.cast("string"), F.lit("/"), i.cast("string"))
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(cell, f"{salt} r")))
        return (radius * F.cos(uniform(cell, f"{salt} a") * (2 * math.pi))).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at)


def random_vectors(spark: SparkSession, rows: int, width: int, salt: str) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("vec_id"),
                                    normal_vector(F.col("id"), salt, width).alias("embedding"))


def read_dataset(spark: SparkSession, descriptor: str) -> Dataset:
    """The dataset a JSON descriptor ``{n, d, a_file, x_file, k}`` names; random for no path."""
    if descriptor == "":
        return Dataset(DEFAULT_ROWS, DEFAULT_WIDTH,
                       random_vectors(spark, DEFAULT_ROWS, DEFAULT_WIDTH, "vectors"),
                       _queries(random_vectors(spark, 1, DEFAULT_WIDTH, "queries")), DEFAULT_K)
    named = spark.read.json(descriptor, multiLine=True).first().asDict()
    queries = named.get("x_file")
    return Dataset(named["n"], named["d"], read_matrix(spark, named["a_file"]),
                   _queries(read_matrix(spark, queries)) if queries else None, named["k"])


def _queries(vectors: DataFrame) -> DataFrame:
    return vectors.withColumnRenamed("vec_id", "query_id")
