"""Guards, redaction, bias and reports on texts with hand-derived expectations."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import audit, guards, scalars, sqlfunctions


def column(spark, texts, make, name="text"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {name} string")
    rows = df.select("i", make(F.col(name)).alias("out")).orderBy("i").collect()
    return [r["out"] for r in rows]


@pytest.mark.parametrize("text, words, score, category", [
    ("The data shows trends.", (0, 0, 0), 0.0, "minimal"),
    ("He is a strong leader.", (1, 0, 2), 0.65, "high"),
    ("She is a great nurse and he is a strong leader.", (1, 1, 2), 0.3, "moderate"),
    ("", (0, 0, 0), 0.0, "neutral"),
    ("  \n\t", (0, 0, 0), 0.0, "neutral"),
    (None, (0, 0, 0), 0.0, "neutral"),
    ("!!!", (0, 0, 0), 0.0, "minimal"),
])
def test_bias(spark, text, words, score, category):
    df = spark.createDataFrame([(text,)], "text string")
    b = audit.with_bias(df, "text").first()["bias"]
    assert (b["male_terms"], b["female_terms"], b["stereotypes_found"]) == words
    assert b["bias_score"] == score and b["category"] == category


def test_bias_recommendations(spark):
    df = spark.createDataFrame([("he him his strong leader caring",), ("she her hers",)], "t string")
    first, second = (r["bias"]["recommendations"] for r in audit.with_bias(df, "t").collect())
    assert first == ["Consider using more gender-neutral language",
                     "Review stereotypical language usage"]
    assert second == ["Consider balancing gendered references"]


def test_answer_bias(spark):
    out = column(spark, ["he she man", "", "The manager reviewed data.", "He, they"],
                 audit.answer_bias)
    assert [o["bias_score"] for o in out] == [0.3333, 0.0, 0.0, 0.0]
    assert out[0]["details"] == "Male terms: 2, Female terms: 1"
    assert out[1]["details"] == "No text provided"


def test_query_safety(spark):
    texts = ["Top 5 locations", "DROP TABLE trips", "Show passwords", "", None,
             "hack\nthe server", "key = 5", "attack the server"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = guards.with_safety(df, "text").orderBy("i")
    out = [r["safety"] for r in rows.collect()]
    assert column(spark, texts, guards.is_safe) == [o["is_safe"] for o in out]
    assert [o["is_safe"] for o in out] == [True, False, False, True, True, True, False, False]
    assert out[2]["reason"] == "Query contains blocked topic: password"
    assert out[1]["modified_query"] is None and out[0]["modified_query"] == "Top 5 locations"


def test_redaction_in_order(spark):
    out = column(spark, ["Contact john@email.com or call 555-123-4567", "123456789", "1234567890",
                         "1234567812345678", None], guards.redact_pii)
    assert out == ["Contact [EMAIL] or call [PHONE]", "[SSN]", "[PHONE]", "[CARD]", None]
    assert column(spark, out, guards.redact_pii) == out


def test_statement_guards(spark):
    texts = ["SELECT 1", "SELECT 1;", "SELECT 1; SELECT 2", "select updated_at", "SELECT 1 -- x",
             "", None, "EXEC p", "SELECT /* x */ 1"]
    assert column(spark, texts, guards.sanitize_sql) == [
        "SELECT 1", "SELECT 1;", None, None, None, None, None, None, None]
    assert column(spark, ["drop table x", "SELECT 1", "create or DELETE"],
                  guards.forbidden_operation) == [
        "Forbidden SQL operation: DROP", None, "Forbidden SQL operation: DELETE"]


def test_ethics_report(spark):
    df = spark.createDataFrame(
        [("He is a strong leader.", "DROP TABLE trips"), ("The data shows trends.", None)],
        "text string, query string")
    bad, good = (r["ethics"] for r in audit.with_ethics_report(df, "text", "query").collect())
    assert bad["ethical_score"] == 0.175 and not bad["passed"]
    assert bad["summary"] == "Ethical score: 17.50% | Bias: high | Safe: False"
    assert good["ethical_score"] == 1.0 and good["passed"]


def test_numbers_as_python_prints_them(spark):
    values = [0.125, 0.375, 2301443.425, 1.005, 0.5, 123456789.875, 2.675]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    out = [r[0] for r in df.select(scalars.two_decimals(F.col("v"))).collect()]
    assert out == [f"{v:.2f}" for v in values]
    ties = [0.28125, 0.04375, 0.12345, 0.00015]
    df = spark.createDataFrame([(v,) for v in ties], "v double")
    assert [r[0] for r in df.select(scalars.score_round(F.col("v"))).collect()] == [
        round(v, 4) for v in ties]


def test_scalars(spark):
    assert column(spark, ["top 10 of 20", "no", "x 99999999999999999999", "5th"],
                  scalars.first_number) == [10, None, None, None]
    assert column(spark, ["a" * 51, "short"], scalars.preview) == ["a" * 50 + "...", "short"]
    assert column(spark, ["sum_fare", "month"], scalars.title_of) == ["Sum Fare", "Month"]
    assert column(spark, ["Été, été_1!"], scalars.word_tokens) == [["été", "été_1"]]


def test_sql_functions_agree(spark):
    sqlfunctions.register(spark)
    texts = ["He is a strong leader.", "", "she her", "mail a@b.co 555-123-4567", "steal my data"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    scored = audit.with_bias(df, "text")
    checked = scored.select(
        (F.expr("bias_score(text)") == F.col("bias.bias_score")).alias("a"),
        (F.expr("redact_pii(text)") == guards.redact_pii(F.col("text"))).alias("b"),
        (F.expr("is_safe_query(text)") == guards.is_safe(F.col("text"))).alias("c")).collect()
    assert all(all(r) for r in checked)
    row = spark.sql("""SELECT l2sq(array(1,2), array(3,5)), l2(array(0,0), array(3,4)),
        neg_dot(array(1,2), array(3,4)), l1(array(1,2), array(3,5)),
        cosine_dist(array(1,0), array(0,1)), isnan(cosine_dist(array(0,0), array(0,1)))""").first()
    assert tuple(row) == (13.0, 5.0, -11.0, 5.0, 1.0, True)
