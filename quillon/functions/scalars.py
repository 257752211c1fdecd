"""Column helpers shared by the plans: labels, previews, tokens, keyword tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, words: list[str]) -> Column:
    """True if any word occurs anywhere in the text, inside other words too."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_contained(text: Column, words: list[str]) -> Column:
    """The first word, in list order, that occurs in the text; NULL if none does."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def word_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Whitespace-separated pieces of the lower-cased text, in order."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def common(left: Column, right: list[str]) -> Column:
    """How many distinct members of ``right`` the array holds."""
    return F.size(F.array_intersect(left, F.array(*[F.lit(w) for w in right])))


def first_number(text: Column) -> Column:
    """The first all-digit piece as a BIGINT; NULL if there is none or it does not fit."""
    return F.regexp_extract(text, r"(?U)(?:^|\s)([0-9]+)(?=\s|$)", 1).try_cast("bigint")


def blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def preview(text: Column, length: int = 50) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("...")))\
        .otherwise(text)


def title_of(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def label_of(column: Column, value: Column) -> Column:
    """Axis label of a group value: ``Loc 7`` for places, Title Case for regions, text otherwise."""
    name = F.lower(column)
    return (F.when(name.isin("location", "id", "zone"), F.concat(F.lit("Loc "), value))
            .when(name == "region", F.initcap(value))
            .otherwise(value))


def decimals(value: Column, digits: int) -> Column:
    """Text with that many decimals, rounded on the exact binary value, exact halves to even.

    ``format_string`` would round the printed digits half up instead.
    """
    pattern = "0." + "0" * digits
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def json_text(value: Column) -> Column:
    """A text as a JSON string, quoted and escaped; ``null`` for NULL."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def two_decimals(value: Column) -> Column:
    return decimals(value, 2)


def score_round(value: Column, digits: int = 4) -> Column:
    """A score rounded as its text would be."""
    return decimals(value, digits).cast("double")


def percent_text(value: Column) -> Column:
    return F.concat(decimals(value * 100, 2), F.lit("%"))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def tenure_bucket(tenure: Column) -> Column:
    return (F.when(tenure <= 12, "0-12 months").when(tenure <= 24, "13-24 months")
            .when(tenure <= 36, "25-36 months").otherwise("37+ months"))
