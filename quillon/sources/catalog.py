"""Ad-hoc SQL behind the statement guard, the catalog profile, and idempotent table loads."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.sources import statements, synthetic, tables

DAMAGED = ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER")
QUERY_WORDS = {"SELECT", "WITH", "VALUES", "FROM", "TABLE"}


def run_sql(spark: SparkSession, text: str) -> tuple[DataFrame | None, str | None]:
    """``(frame, None)`` for a read-only statement, else ``(None, error)``. The frame is lazy.

    Besides the guard's words, anything that is not a plain query of registered tables by its parsed
    plan is refused, see ``statements.refusal``.
    """
    upper = text.upper()
    for word in C.READ_ONLY_FORBIDDEN:
        if word in upper:
            return None, f"Forbidden SQL operation: {word}"
    if not text.strip():
        return None, "empty statement"
    first = re.match(r"(?s)(?:\s|--[^\n]*\n|/\*.*?\*/|\()*([A-Za-z]+)", text)
    if not first or first[1].upper() not in QUERY_WORDS:
        return None, f"Forbidden SQL operation: {first[1].upper() if first else text.split()[0]}"
    if refused := statements.refusal(spark, text):
        return None, refused
    try:
        return spark.sql(text), None
    except PySparkException as failure:
        return None, str(failure)


def profile(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per table column: name, type, and the table's row count."""

    def one(name: str, df: DataFrame) -> DataFrame:
        cells = F.array(*[
            F.struct(F.lit(f.name).alias("column_name"),
                     F.lit(f.dataType.simpleString()).alias("data_type")) for f in df.schema])
        return df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), F.inline(cells), "row_count")

    return reduce(DataFrame.unionByName, [one(n, d) for n, d in frames.items()])


def table_profile(spark: SparkSession, folder: str) -> DataFrame:
    frames = {n: tables.read(spark, folder, n) for n in tables.BASE_TABLES}
    frames["trips"] = tables.trips(spark, folder)
    frames["customers"] = tables.customers(spark, folder)
    return profile(frames)


def catalog_profile(spark: SparkSession, database: str = "default") -> DataFrame:
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    return profile({n: spark.table(f"{database}.{n}") for n in names})


def init_tables(spark: SparkSession, rows: int = 10_000, force_recreate: bool = False,
                database: str = "default") -> None:
    """Create and fill ``trips`` and ``customers`` once.

    An existing table with rows is left alone; an empty one is filled. One whose files are damaged is
    replaced, as is any with ``force_recreate``; every other failure to read is raised, and nothing
    is overwritten.
    """
    sources = {"trips": synthetic.synthetic_trips, "customers": synthetic.synthetic_customers}
    for name, make in sources.items():
        full = f"{database}.{name}"
        if not force_recreate and _has_rows(spark, full):
            continue
        make(spark, rows).write.mode("overwrite").format("parquet").saveAsTable(full)


def _has_rows(spark: SparkSession, table: str) -> bool:
    if not spark.catalog.tableExists(table):
        return False
    try:
        return not spark.table(table).isEmpty()
    except PySparkException as failure:
        if any(sign in str(failure) for sign in DAMAGED):
            return False
        raise
