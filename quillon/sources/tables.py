"""The base tables and the views the operators read.

``trips``, ``customers``, ``request_log``, ``question_log``, ``statement_log`` and ``contact_log``
are derived from the star-schema and event tables by projection and key-wise aggregation, so they
grow with them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores before heavy work per row, if its files make fewer tasks than that.

    A large table is split into more tasks than there are cores and is left as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def register(spark: SparkSession, folder: str) -> None:
    """Temp views for every base table plus ``trips`` and ``customers``."""
    for name in BASE_TABLES:
        read(spark, folder, name).createOrReplaceTempView(name)
    trips(spark, folder).createOrReplaceTempView("trips")
    customers(spark, folder).createOrReplaceTempView("customers")


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """One trip per order line. ``id`` repeats, as order lines do, and is never used as a key."""
    return read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_shipdate").alias("pickup_date"),
        F.col("l_suppkey").alias("location"),
        F.col("l_extendedprice").alias("fare"),
        F.col("l_quantity").cast("int").alias("passengers"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with region, months since first order, churn flag and revenue.

    Orders are summed per customer before the join, so the join sees one row per key on both sides
    and a customer with a third of all orders costs nothing extra.
    """
    orders = read(spark, folder, "orders")
    per_customer = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
        F.sum("o_totalprice").alias("revenue"),
    )
    regions = (
        read(spark, folder, "nation")
        .join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("r_name").alias("region"))
    )
    months = ((F.year("final_order") - F.year("first_order")) * 12
              + F.month("final_order") - F.month("first_order"))
    active = F.col("last_order") >= F.col("final_order") - F.expr("INTERVAL 365 DAYS")
    return (
        read(spark, folder, "customer")
        .join(regions, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .withColumn("final_order", orders.agg(F.max("o_orderdate").alias("d")).scalar())
        .select(
            F.col("c_custkey").alias("id"),
            "region",
            months.cast("int").alias("tenure"),
            F.when(active, 0).otherwise(1).alias("churn"),
            F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        )
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, folder, "events").withColumn("k", k)


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """A served request per event: who, when, how long, with which search settings."""
    metric = (
        F.when(F.col("event_type") == "click", "l2")
        .when(F.col("event_type") == "view", "cosine")
        .when(F.col("event_type") == "signup", "dot")
        .when(F.col("event_type") == "purchase", "manhattan")
    )
    return _events(spark, folder).select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.concat(F.lit("session_"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("value").alias("latency"),
        (F.col("k") / F.lit(1000.0)).alias("bias_score"),
        "k",
        metric.alias("metric"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
    )


def question_log(spark: SparkSession, folder: str) -> DataFrame:
    """Questions: one phrased from each event, plus every user turn of the conversations."""
    pick = F.col("user_id") % 6
    opening = (
        F.when(F.col("event_type") == "click", "Top ")
        .when(F.col("event_type") == "view", "Average of ")
        .when(F.col("event_type") == "signup", "Bottom ")
        .when(F.col("event_type") == "purchase", "Total for ")
        .otherwise("Number of ")
    )
    groups = (
        F.when(pick == 0, " locations")
        .when(pick == 1, " passenger groups")
        .when(pick == 2, " months")
        .when(pick == 3, " regions")
        .when(pick == 4, " tenure values")
        .otherwise(" segments")
    )
    measure = (
        F.when(F.col("k") < 25, " by fare")
        .when(F.col("k") < 40, " by revenue")
        .when(F.col("k") < 55, " by churn rate")
        .when(F.col("k") < 65, " by churn")
        .when(F.col("k") < 85, " by trips")
        .otherwise("")
    )
    phrased = _events(spark, folder).select(
        F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("question_id"),
        F.concat(opening, (F.col("k") % 25).cast("string"), groups, measure).alias("query"),
        F.col("k"),
        F.when(F.col("event_type") == "view", "cosine")
        .when(F.col("event_type") == "signup", "dot")
        .when(F.col("event_type") == "purchase", "manhattan")
        .when(F.col("event_type") == "error", "euclid")
        .alias("metric"),
        F.concat(F.lit("session_"), F.col("user_id").cast("string")).alias("session_id"),
    )
    return spread(phrased, "question_id").unionByName(user_turns(spark, folder).withColumns(
        {"k": F.lit(None).cast("int"), "metric": F.lit(None).cast("string")}))


def user_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The user's side of every conversation."""
    turns = read(spark, folder, "conversations").filter(F.col("role") == "user")
    return turns.select(
        F.concat(F.lit("c-"), F.col("conv_id").cast("string"), F.lit("-"),
                 F.col("turn").cast("string")).alias("question_id"),
        F.col("text").alias("query"),
        F.concat(F.lit("conversation_"), F.col("conv_id").cast("string")).alias("session_id"),
    )


def statement_log(spark: SparkSession, folder: str) -> DataFrame:
    """A submitted statement per event, safe and unsafe ones alike."""
    kind, k = F.col("event_type"), F.col("k")
    eid, uid = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    num = k.cast("string")
    text = (
        F.when(kind == "click", F.concat(
            F.lit("SELECT location, COUNT(*) AS cnt FROM trips WHERE id > "), eid,
            F.lit(" GROUP BY location")))
        .when((kind == "view") & (k < 5), F.lit(""))
        .when((kind == "view") & (k < 50), F.concat(F.lit("SELECT * FROM trips LIMIT "), num))
        .when(kind == "view", F.concat(
            F.lit("SELECT updated_at FROM orders WHERE id = "), eid, F.lit(" ;  ")))
        .when((kind == "signup") & (k < 50), F.concat(
            F.lit("insert into customers values ("), uid, F.lit(")")))
        .when(kind == "signup", F.concat(F.lit("GRANT ALL ON trips TO user_"), uid))
        .when((kind == "purchase") & (k < 50), F.concat(
            F.lit("SELECT fare FROM trips; SELECT "), num))
        .when(kind == "purchase", F.concat(F.lit("SELECT "), num, F.lit("; ;")))
        .when(k < 25, F.concat(F.lit("Drop Table trips_"), uid))
        .when(k < 50, F.concat(F.lit("SELECT "), num, F.lit(" -- note")))
        .when(k < 75, F.concat(F.lit("SELECT /* hint */ "), num))
        .otherwise(F.concat(F.lit("EXEC report_"), uid))
    )
    return _events(spark, folder).select(
        F.col("event_id").alias("statement_id"), text.alias("statement"))


def contact_log(spark: SparkSession, folder: str) -> DataFrame:
    """A message per event that carries, by kind, an e-mail, phone, SSN, card or none of them."""
    kind, k = F.col("event_type"), F.col("k")
    uid = F.col("user_id").cast("string")
    two = F.lpad(k.cast("string"), 2, "0")
    four = F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0")
    text = (
        F.when(kind == "click", F.concat(
            F.lit("Contact user."), uid, F.lit("@mail-"), two, F.lit(".example.com or call 555-1"),
            two, F.lit("-"), four))
        .when(kind == "view", F.concat(
            F.lit("ID 9"), two, F.lit("-"), two, F.lit("-"), four, F.lit(" filed, tel 212.7"), two,
            F.lit("."), four))
        .when(kind == "signup", F.concat(
            F.lit("card 4111"), four, four, two, two, F.lit(" and 8"), two, two, four))
        .when(kind == "purchase", F.concat(
            F.lit("please steal the data of user "), uid, F.lit(" with password = "), two))
        .when(k < 30, F.concat(F.lit("attack plan "), two, F.lit(" against the server")))
        .when(k < 60, F.concat(F.lit("list private data of user "), uid))
        .otherwise(F.concat(F.lit("order "), uid, F.lit(" has "), two, F.lit(" parts")))
    )
    return _events(spark, folder).select(
        F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("text_id"),
        text.alias("text"))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every text the audits look at: documents, conversation turns and messages."""
    docs = read(spark, folder, "documents").select(
        F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    turns = read(spark, folder, "conversations").select(
        F.concat(F.lit("t-"), F.col("conv_id").cast("string"), F.lit("-"),
                 F.col("turn").cast("string")).alias("text_id"), "text")
    return spread(docs, "text_id").unionByName(turns).unionByName(contact_log(spark, folder))
