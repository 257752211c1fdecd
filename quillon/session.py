"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the one the cluster names, else a local one in tests.

    A machine-local folder is refused on a cluster, where a lost node would take the data with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    already = spark.sparkContext.getCheckpointDir()
    if already:
        return already
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="quillon-checkpoints-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back.

    The plan is run once, its lineage ends here, and a lost executor costs a re-read instead of a
    re-run. Sampling-based partitioning and row numbers become fixed facts.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def erase(*frames: DataFrame) -> None:
    """Delete the folders of frames made by ``written`` that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, so that their kernels load wherever the driver started."""
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillon-package-")
    archive = shutil.make_archive(os.path.join(folder, "quillon"), "zip", os.path.dirname(here),
                                  os.path.basename(here))
    context.addPyFile(archive)
    context._quillon_shipped = True
