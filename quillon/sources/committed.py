"""Tables that take every batch once.

A batch of rows lands in a folder of its own and counts when its commit marker is there. A batch that
is written again is skipped, one that failed half-way is replaced, and readers see committed batches
only. All files go through Spark and Hadoop's file systems, so the table may lie in any store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, batch_id: str, *partitions: str) -> bool:
    """Add a batch of rows unless it is there already; whether it was added.

    The marker is written after the data, so a batch without one is rewritten from the start.
    """
    spark = rows.sparkSession
    if not batches(spark, path).filter(F.col("batch_id") == batch_id).isEmpty():
        return False
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").partitionBy(
        *partitions).parquet(f"{path}/batches/folder={batch_id}")
    spark.createDataFrame([(batch_id,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/commits/{batch_id}")
    return True


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The ids of the batches that count."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "batch_id string")
    return spark.read.option("recursiveFileLookup", "true").schema("value string").text(
        f"{path}/commits").select(F.col("value").alias("batch_id"))


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed batches, None before the first."""
    done = batches(spark, path)
    if done.isEmpty():
        return None
    return spark.read.parquet(f"{path}/batches").drop("folder").join(done, "batch_id", "left_semi")
