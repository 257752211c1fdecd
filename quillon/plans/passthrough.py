"""SELECT forms a user may submit, each run unchanged through Spark SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.tables import register

STATEMENTS = {
    "sql_joins": """
        SELECT n_name, count(*) AS customers, count(o.n) AS with_orders,
               coalesce(sum(o.n), 0) AS orders, round(coalesce(sum(o.total), 0), 2) AS revenue
        FROM customer c
        JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total
                   FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey
        GROUP BY n_name""",
    "sql_semi_anti": """
        SELECT p_brand,
               count(*) AS unsold_or_returned,
               count(CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)
                          THEN 1 END) AS unsold
        FROM part
        WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')
           OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)
        GROUP BY p_brand""",
    "sql_set_ops": """
        (SELECT 'both' AS kind, k FROM (
            SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) a)
        UNION
        (SELECT 'customer only' AS kind, k FROM (
            SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) b)
        UNION
        (SELECT 'no orders' AS kind, k FROM (
            SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) c)""",
    "sql_windows": """
        SELECT o_custkey, month, revenue,
               rank() OVER (PARTITION BY o_custkey ORDER BY revenue DESC) AS best,
               round(sum(revenue) OVER (PARTITION BY o_custkey ORDER BY month
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running
        FROM (SELECT o_custkey, year(o_orderdate) * 100 + month(o_orderdate) AS month,
                     round(sum(o_totalprice), 2) AS revenue
              FROM orders GROUP BY o_custkey, year(o_orderdate) * 100 + month(o_orderdate)) m""",
    "sql_cte_having": """
        WITH spending AS (
            SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
        SELECT c_mktsegment, c_nationkey, count(*) AS big_spenders, round(avg(total), 6) AS mean
        FROM spending JOIN customer ON o_custkey = c_custkey
        WHERE total > (SELECT avg(total) FROM spending)
        GROUP BY c_mktsegment, c_nationkey
        HAVING count(*) > 1""",
    "sql_distinct": """
        SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts,
               count(DISTINCT l_suppkey) AS suppliers, count(*) AS lines
        FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "sql_json": """
        SELECT event_type, CAST(get_json_object(props, '$.k') AS INT) AS k, count(*) AS events,
               round(sum(value), 2) AS total
        FROM events GROUP BY event_type, CAST(get_json_object(props, '$.k') AS INT)""",
}


def statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        register(spark, folder)
        return spark.sql(STATEMENTS[name])

    return run
