"""A question's slots, read off its words: table, group, measure, order, limit, statement text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.functions.scalars import contains_any, first_number

# --- fixed values: what each table can be grouped by and measured on ---------------------------
GROUPS = {"trips": ["location", "passengers", "month"], "customers": ["region", "tenure"]}
MEASURED = {"trips": ["fare", "*"], "customers": ["revenue", "churn", "*"]}


def needs_sql(query: Column) -> Column:
    return contains_any(F.lower(query), C.NEEDS_SQL_WORDS)


def with_slots(df: DataFrame, query: str = "query") -> DataFrame:
    """``df`` plus the slot columns; NULL slots where the question needs no statement.

    ``statement`` is the text shown to the user, ``problem`` the first column of it that its table
    lacks. Rows are answered from the shared aggregates, not by running the text.
    """
    low = F.col("_low")

    def has(*words: str) -> Column:
        return contains_any(low, list(words))

    def either(trips: str, customers: str) -> Column:
        return F.when(F.col("base_table") == "trips", trips).otherwise(customers)

    func = (F.when(has("average", "avg"), "AVG").when(has("count", "number"), "COUNT")
            .otherwise("SUM"))
    group = (
        F.when(has("passenger"), "passengers")
        .when(has("tenure"), "tenure")
        .when(has("region"), "region")
        .when(has("location", "zone"), "location")
        .when(contains_any(low, C.MONTH_WORDS) & (F.col("base_table") == "trips"), "month")
        .otherwise(either("location", "region"))
    )
    measure = (F.when(has("fare"), "fare").when(has("revenue"), "revenue")
               .when(has("churn"), "churn").when(has("trip", "count"), "*")
               .otherwise(either("fare", "revenue")))
    func_used = (F.when(F.col("measure") == "churn", "AVG").when(F.col("measure") == "*", "COUNT")
                 .otherwise(func))
    rate = has("churn") & has("rate")
    value_name = (F.when(rate, "churn_rate").when(F.col("measure") == "*", "count")
                  .otherwise(F.concat_ws("_", F.lower(F.col("func")), F.col("measure"))))
    staged = (
        df.withColumn("_low", F.lower(query))
        .withColumn("base_table", F.when(contains_any(low, C.CUSTOMER_WORDS), "customers")
                    .otherwise("trips"))
        .withColumns({
            "needs_sql": F.coalesce(contains_any(low, C.NEEDS_SQL_WORDS), F.lit(False)),
            "group_col": group,
            "measure": measure,
            "direction": F.when(contains_any(low, C.ASCENDING_WORDS), "ASC").otherwise("DESC"),
            "row_limit": F.coalesce(first_number(F.col(query)), F.lit(C.DEFAULT_LIMIT)),
        })
        .withColumn("func", func_used)
        .withColumn("value_name", value_name)
    )
    slots = ["base_table", "group_col", "measure", "func", "direction", "row_limit", "value_name"]
    return (
        staged.withColumns({"statement": _statement(), "problem": _problem()})
        .withColumns({c: F.when(F.col("needs_sql"), F.col(c))
                      for c in [*slots, "statement", "problem"]})
        .drop("_low")
    )


def _statement() -> Column:
    """The statement as text, in the shape its measure asks for."""
    group = F.when(F.col("group_col") == "month", C.MONTH_EXPRESSION).otherwise(F.col("group_col"))
    value = F.col("value_name")
    picked = (
        F.when(value == "churn_rate", "AVG(churn) * 100 as churn_rate, COUNT(*) as total")
        .when(value == "count", "COUNT(*) as count")
        .otherwise(F.format_string("%s(%s) as %s", F.col("func"), F.col("measure"), value))
    )
    return F.format_string(
        "SELECT %s, %s FROM %s GROUP BY %s ORDER BY %s %s LIMIT %d",
        group, picked, F.col("base_table"), group, value, F.col("direction"), F.col("row_limit"))


def _problem() -> Column:
    def lacks(name: str, known: dict[str, list[str]]) -> Column:
        inside = [(F.col("base_table") == t) & F.col(name).isin(cols) for t, cols in known.items()]
        return ~(inside[0] | inside[1])

    column = (F.when(lacks("group_col", GROUPS), F.col("group_col"))
              .when((F.col("value_name") != "churn_rate") & lacks("measure", MEASURED),
                    F.col("measure")))
    return F.when(column.isNotNull(), F.concat(F.lit("no such column: "), column))
