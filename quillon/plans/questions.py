"""A table of questions answered in one job.

Each base table is aggregated once for all questions. The best and worst rows of every group and
measure, with every possible number of rows, make at most 960 finished answers (result, chart,
sentence), which travel to the questions. The questions themselves are only projected and looked
up, never shuffled, so a question asked a billion times costs no more than a billion different ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import constants as C
from quillon.functions.scalars import json_text, label_of, month_key, title_of, two_decimals
from quillon.functions.slots import needs_sql, with_slots
from quillon.operators.ranking import first_per_group
from quillon.sources import tables

WHOLE_NUMBERS = ["count", "count_fare", "count_revenue"]
# Amounts are summed as whole millionths, so a total does not depend on the order of rows.
MICRO = 1_000_000
SLOT_KEYS = ["base_table", "group_col", "value_name", "direction"]


def micro(amount: Column) -> Column:
    """An amount in whole millionths."""
    return (amount.cast("decimal(20,6)") * F.lit(MICRO).cast("decimal(7,0)")).cast("decimal(26,0)")


def _measure(name: str, millionths: Column, count: Column, total: Column | None = None) -> Column:
    """A measure ``millionths / count``: its value, and the value to four decimals (halves up, from
    the exact quotient) for display."""
    exact, n = millionths.cast("decimal(36,0)"), count.cast("decimal(20,0)")
    shown = F.floor((exact * 2 + n * 100).cast("decimal(38,0)") / (n * 200).cast("decimal(24,0)"))
    return F.struct(
        F.lit(name).alias("value_name"),
        (exact.cast("double") / (float(MICRO)) / count.cast("double")).alias("value"),
        (shown.cast("decimal(20,0)") * F.lit("0.0001").cast("decimal(5,4)"))
        .cast("decimal(24,4)").alias("shown"),
        (F.lit(None).cast("bigint") if total is None else total).alias("total"))


def _long(df: DataFrame, table: str, group: Column, number: Column, text: Column,
          measures: list[Column]) -> DataFrame:
    """One row per group value and measure."""
    return df.select(F.lit(table).alias("base_table"), group.alias("group_col"),
                     number.cast("bigint").alias("key_number"), text.alias("key_text"),
                     F.inline(F.array(*measures)))


def metric_catalogue(trips: DataFrame, customers: DataFrame) -> DataFrame:
    """Every group value under every measure: one pass over each table by grouping sets."""
    fare = trips.withColumn("month", month_key(F.col("pickup_date")))
    keys = ["location", "passengers", "month"]
    per_trip = fare.groupingSets([[F.col(k)] for k in keys], *keys).agg(
        F.grouping_id().alias("gid"),
        F.sum(micro(F.col("fare"))).alias("fares"), F.count("fare").alias("n_fares"),
        F.count("*").alias("n"))
    one = F.lit(1)
    place = F.col("gid") == 0b011
    people = F.col("gid") == 0b101
    trip_rows = _long(
        per_trip, "trips",
        F.when(place, "location").when(people, "passengers").otherwise("month"),
        F.when(place, F.col("location")).when(people, F.col("passengers")),
        F.when(place, F.col("location").cast("string"))
        .when(people, F.col("passengers").cast("string")).otherwise(F.col("month")),
        [_measure("sum_fare", F.col("fares"), one), _measure("avg_fare", F.col("fares"),
                                                             F.col("n_fares")),
         _measure("count_fare", F.col("n_fares") * MICRO, one),
         _measure("count", F.col("n") * MICRO, one)])
    kept = ["region", "tenure"]
    per_customer = customers.groupingSets([[F.col(k)] for k in kept], *kept).agg(
        F.grouping_id().alias("gid"),
        F.sum(micro(F.col("revenue"))).alias("revenues"), F.count("revenue").alias("n_revenues"),
        F.sum("churn").alias("churned"), F.count("churn").alias("n_churn"),
        F.count("*").alias("n"))
    area = F.col("gid") == 0b01
    customer_rows = _long(
        per_customer, "customers", F.when(area, "region").otherwise("tenure"),
        F.when(~area, F.col("tenure")),
        F.when(area, F.col("region")).otherwise(F.col("tenure").cast("string")),
        [_measure("sum_revenue", F.col("revenues"), one),
         _measure("avg_revenue", F.col("revenues"), F.col("n_revenues")),
         _measure("count_revenue", F.col("n_revenues") * MICRO, one),
         _measure("avg_churn", F.col("churned") * MICRO, F.col("n_churn")),
         _measure("churn_rate", F.col("churned") * 100 * MICRO, F.col("n_churn"), F.col("n")),
         _measure("count", F.col("n") * MICRO, one)])
    return trip_rows.unionByName(customer_rows)


def ranked_answers(catalogue: DataFrame, rows: int = C.RESULT_ROWS) -> DataFrame:
    """At most 48 slots: the first ``rows`` of each group and measure in each direction, in order,
    and how many there are in all.

    Rows are ranked by the unrounded value. Both directions rank in the same pass, cut to ``rows``
    per task before the shuffle.
    """
    both = catalogue.withColumn("direction", F.explode(F.array(F.lit("ASC"), F.lit("DESC"))))
    height = F.when(F.col("direction") == "ASC", F.col("value")).otherwise(-F.col("value"))
    first = first_per_group(both, SLOT_KEYS, [height, "key_number", "key_text"], rows)
    entry = F.struct("rank", F.coalesce("key_text", F.lit("None")).alias("key"), "value", "shown",
                     "total")
    ranked = first.groupBy(*SLOT_KEYS).agg(F.sort_array(F.collect_list(entry)).alias("ranked"))
    slot = [k for k in SLOT_KEYS if k != "direction"]
    sizes = catalogue.groupBy(*slot).agg(F.count(F.lit(1)).alias("all_rows"))
    return ranked.join(sizes, slot)


def finished_answers(ranked: DataFrame, rows: int = C.RESULT_ROWS) -> DataFrame:
    """Each slot's answer for every row limit from 1 to ``rows``: built once, not per question."""
    limits = F.explode(F.sequence(F.lit(1), F.lit(rows))).alias("shown_rows")
    return (
        ranked.select(*SLOT_KEYS, limits, "ranked", "all_rows")
        .withColumn("rows", F.slice("ranked", F.lit(1), F.col("shown_rows"))).drop("ranked")
        .select(*SLOT_KEYS, "shown_rows", "all_rows",
                result_json().alias("sql_result"), chart_json().alias("viz_code"),
                sentence().alias("sentence"))
    )


def answered(questions: DataFrame, trips: DataFrame, customers: DataFrame,
             *extra: str, rows: int = C.RESULT_ROWS) -> DataFrame:
    """Questions with ``statement``, ``error`` and, where rows were found, the finished answer.

    ``row_count`` is that of the whole result; result, chart and sentence show its first ``rows``,
    a display length that a caller may set as high as questions ask. ``extra`` names the slot
    columns to keep.
    """
    answers = finished_answers(ranked_answers(metric_catalogue(trips, customers), rows), rows)
    asked = with_slots(questions).withColumn(
        "shown_rows", F.least(F.col("row_limit"), F.lit(rows)).cast("int"))
    kept = [asked[c] for c in [*questions.columns, *extra]]
    # null-safe, so that a later filter does not add null tests on every slot's long expression
    same = reduce(lambda a, b: a & b, [asked[c].eqNullSafe(answers[c])
                                       for c in [*SLOT_KEYS, "shown_rows"]])
    count = F.when(F.col("all_rows").isNotNull(), F.least(asked["row_limit"], F.col("all_rows")))
    return asked.join(F.broadcast(answers), same, "left").select(
        *kept, "statement", F.col("problem").alias("error"),
        F.coalesce(count, F.lit(0)).cast("int").alias("row_count"), "sql_result", "viz_code",
        narrative().alias("narrative"))


def _whole() -> Column:
    return F.col("value_name").isin(WHOLE_NUMBERS)


def result_json() -> Column:
    """The rows as a JSON list of records named after the statement's columns."""
    key_is_text = F.col("group_col").isin("region", "month")

    def record(r: Column) -> Column:
        key = F.when(key_is_text, json_text(r["key"])).otherwise(
            F.when(r["key"] == "None", "null").otherwise(r["key"]))
        value = F.when(_whole(), r["value"].cast("bigint").cast("string")).otherwise(
            r["shown"].cast("string"))
        total = F.when(r["total"].isNotNull(),
                       F.concat(F.lit(', "total": '), r["total"].cast("string"))).otherwise("")
        return F.concat(F.lit("{"), json_text(F.col("group_col")), F.lit(": "), key, F.lit(", "),
                        json_text(F.col("value_name")), F.lit(": "), value, total, F.lit("}"))

    return F.concat(F.lit("["), F.array_join(F.transform("rows", record), ", "), F.lit("]"))


def result_rows(answers: DataFrame, result: str = "sql_result") -> DataFrame:
    """A result text read back: a row per record and field, with its ``text`` or its ``number``.

    All other columns are kept; an answer without a result has no rows, and neither has a text that
    is no JSON list of records.
    """
    records = F.from_json(result, "array<map<string,string>>")
    fields = answers.select("*", F.posexplode(records).alias("position", "_record")).select(
        "*", F.explode("_record").alias("name", "_value")).drop("_record", result)
    number = F.expr("try_cast(_value AS DOUBLE)")
    return fields.withColumns({"number": number, "text": F.when(number.isNull(), F.col("_value"))}
                              ).drop("_value")


CHART_SCHEMA = ("data array<struct<type string, x array<int>, y array<double>, name string, "
                "text array<string>, hovertext array<string>>>, layout struct<title string, "
                "xaxis struct<title string, ticktext array<string>>, yaxis struct<title string>>")


def chart_points(charts: DataFrame, chart: str = "chart") -> DataFrame:
    """A chart text read back: a row per point with its series, place, height, text and label."""
    read = charts.withColumn("_c", F.from_json(chart, CHART_SCHEMA))
    points = F.arrays_zip(F.col("_s.x").alias("x"), F.col("_s.y").alias("y"),
                          F.col("_s.text").alias("text"), F.col("_c.layout.xaxis.ticktext")
                          .alias("label"))
    return (read.select("*", F.explode("_c.data").alias("_s"))
            .select("*", F.explode(points).alias("_p"))
            .select(*[c for c in charts.columns if c != chart],
                    F.col("_c.layout.title").alias("title"), F.col("_s.name").alias("series"),
                    F.col("_p.x").alias("position"), F.col("_p.y").alias("height"),
                    F.col("_p.text").alias("shown"), F.col("_p.label").alias("label")))


def chart_json(kind: str = "bar") -> Column:
    """Chart series and layout of the rows: first column across, second up."""
    value_title, group_title = title_of(F.col("value_name")), title_of(F.col("group_col"))
    labels = F.transform("rows", lambda r: label_of(F.col("group_col"), r["key"]))
    spots = F.transform("rows", lambda r: r["rank"] - 1)

    def spec(number, text) -> Column:
        shown = F.transform("rows", lambda r: text(r["value"]))
        hover = F.transform("rows", lambda r: F.concat(
            label_of(F.col("group_col"), r["key"]), F.lit(": "), text(r["value"])))
        series = F.struct(
            F.lit(kind).alias("type"), spots.alias("x"),
            F.transform("rows", number).alias("y"),
            F.col("value_name").alias("name"), shown.alias("text"),
            F.lit("auto").alias("textposition"), hover.alias("hovertext"))
        layout = F.struct(
            F.concat(value_title, F.lit(" by "), group_title).alias("title"),
            F.struct(group_title.alias("title"), F.lit("array").alias("tickmode"),
                     spots.alias("tickvals"), labels.alias("ticktext"),
                     F.lit(0).alias("tickangle")).alias("xaxis"),
            F.struct(value_title.alias("title")).alias("yaxis"),
            F.lit("plotly_dark").alias("template"), F.lit(False).alias("showlegend"))
        return F.to_json(F.struct(F.array(series).alias("data"), layout.alias("layout")))

    return F.when(_whole(), spec(lambda r: r["value"].cast("bigint"),
                                 lambda v: v.cast("bigint").cast("string"))).otherwise(
        spec(lambda r: r["shown"], two_decimals))


def sentence() -> Column:
    """One sentence about the first row, chosen by what was measured."""
    names = F.create_map(*[F.lit(x) for pair in C.COLUMN_DESCRIPTIONS.items() for x in pair])
    group = F.coalesce(F.try_element_at(names, F.col("group_col")), F.col("group_col"))
    value = two_decimals(F.col("rows")[0]["value"])
    name = F.col("value_name")
    found = F.concat(
        F.lit("Analysis: Found "), F.size("rows").cast("string"), F.lit(" results. Top result: "),
        group, F.lit(" '"), F.col("rows")[0]["key"], F.lit("'"))
    # fixed values: sentence endings by measure
    ending = (
        F.when(name.contains("revenue"), F.concat(
            F.lit(" generated highest revenue of $"), value,
            F.lit(". This segment leads in financial performance.")))
        .when(name.contains("churn"), F.concat(
            F.lit(" has the highest churn rate of "), value,
            F.lit(". This segment requires retention focus.")))
        .when(name.contains("fare"), F.concat(
            F.lit(" recorded the highest fare total of $"), value,
            F.lit(". High demand segment identified.")))
        .when(name.contains("count") | name.contains("total"), F.concat(
            F.lit(" has "), value, F.lit(" total records.")))
        .otherwise(F.concat(F.lit(" with "), name, F.lit(" "), value,
                            F.lit(". See chart for details.")))
    )
    return F.concat(found, ending)


def narrative() -> Column:
    """The answer's sentence, or a plain one for a question without rows."""
    return F.coalesce("sentence", F.concat(
        F.lit("Query processed: "), F.col("query"), F.lit(". See visualization for details.")))


def _answered(spark: SparkSession, folder: str) -> DataFrame:
    return answered(tables.question_log(spark, folder), tables.trips(spark, folder),
                    tables.customers(spark, folder))


def question_classify(spark: SparkSession, folder: str) -> DataFrame:
    return tables.question_log(spark, folder).select(
        "question_id", needs_sql(F.col("query")).alias("needs_sql"))


def question_slots(spark: SparkSession, folder: str) -> DataFrame:
    return with_slots(tables.question_log(spark, folder)).select(
        "question_id", "base_table", "group_col", "measure", "func", "direction", "row_limit",
        "statement")


def question_answers(spark: SparkSession, folder: str) -> DataFrame:
    return _answered(spark, folder).select("question_id", "error", "row_count", "sql_result")


def chart_specs(spark: SparkSession, folder: str) -> DataFrame:
    return _answered(spark, folder).filter(F.col("row_count") > 0).select(
        "question_id", F.col("viz_code").alias("chart"))


def narratives(spark: SparkSession, folder: str) -> DataFrame:
    return _answered(spark, folder).select("question_id", "narrative")


#: The most rows that the logged questions of the events ask for.
ASKED_ROWS = 24


def question_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All asked rows of every answer, read back from its JSON text."""
    whole = answered(tables.question_log(spark, folder), tables.trips(spark, folder),
                     tables.customers(spark, folder), rows=ASKED_ROWS)
    return result_rows(whole.select("question_id", "sql_result"))


def chart_values(spark: SparkSession, folder: str) -> DataFrame:
    """The points of every chart, read back from its JSON text."""
    return chart_points(chart_specs(spark, folder))
