"""Runs registered queries on Spark and DuckDB and compares every value.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


TIMES = [0.0, 0.0]


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0 if value != int(value) else int(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else a short account of the difference."""
    began = time.time()
    found_names, found = _rows(df.columns, [tuple(r) for r in df.collect()])
    collected = time.time()
    result = con.execute(sql)
    TIMES[:] = [collected - began, time.time() - collected]
    expected_names, expected = _rows([d[0] for d in result.description], result.fetchall())
    if found_names != expected_names:
        return f"columns {found_names} != {expected_names}"
    if not found:
        return "no rows on either side" if not expected else f"no rows vs {len(expected)}"
    if found != expected:
        extra, missing = found - expected, expected - found
        return (f"{sum(found.values())} rows vs {sum(expected.values())}; "
                f"{sum(extra.values())} differ; e.g. spark {str(list(extra)[:2])[:600]} "
                f"duckdb {str(list(missing)[:2])[:600]}")
    return None


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from quillon.session import build_session

    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{args.sf}"
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                verdict = compare(df, con, sql[name]) or "equal"
                verdict += f" (collect {TIMES[0]:.1f}s, duckdb {TIMES[1]:.1f}s)"
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as failure:
            verdict = f"FAILED {type(failure).__name__}: {str(failure)[:1500]}"
        print(f"{name:32s} {time.time() - start:6.2f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
