"""Normalisers of field values, as column expressions.

Blanks and character classes are ASCII. Two-decimal texts come from exact decimals, half up; a number is
what NUMBER matches, so NaN, infinities and digit separators are not numbers here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import AMOUNTS, DATE, IDENTIFIERS

BLANKS = " \t\n\r\f\x0b"
NUMBER = r"\A[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\z"


def stripped(value: Column) -> Column:
    return F.btrim(F.coalesce(value, F.lit("")), F.lit(BLANKS))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it; branches of CASE share nothing otherwise."""
    return F.element_at(F.transform(F.array(x), f), 1)


def is_blank(value: Column) -> Column:
    return stripped(value) == ""


def without(value: Column, *parts: str) -> Column:
    for p in parts:
        value = F.replace(value, F.lit(p), F.lit(""))
    return value


def round2(x: Column) -> Column:
    """Half up on the hundredfold; the same arithmetic in any engine."""
    return F.floor(x * 100 + 0.5) / F.lit(100.0)


def mean2(x: Column) -> Column:
    """Aggregate: the mean of numbers of two decimals, to two decimals. Hundredths are summed as integers, so that
    the order of rows cannot change it."""
    return F.floor(F.try_divide(F.sum(F.floor(x * 100 + 0.5)), F.count(x)) + 0.5) / F.lit(100.0)


def two_decimals(number: Column, otherwise: Column) -> Column:
    """The number as text with two decimals, or otherwise where the text is no number."""
    exact = number.try_cast("double").try_cast("decimal(38,2)").cast("string")
    return F.when(number.rlike(NUMBER), F.coalesce(exact, otherwise)).otherwise(otherwise)


def _one_mark(v: Column) -> Column:
    """With both marks the right-most is the decimal one; a comma alone always is."""
    both = v.contains(",") & v.contains(".")
    comma_last = v.rlike(r",[^.]*\z")
    return (
        F.when(both & comma_last, F.replace(without(v, "."), F.lit(","), F.lit(".")))
        .when(both, without(v, ","))
        .otherwise(F.replace(v, F.lit(","), F.lit(".")))
    )


def comparison_amount(value: Column) -> Column:
    """For comparing: what is no number comes back upper-cased."""
    bare = without(stripped(value), "$", "€", "₹", "Rs.", "Rs", " ")
    return let(let(bare, _one_mark), lambda v: two_decimals(v, F.upper(v)))


def extracted_amount(value: Column) -> Column:
    """For extraction: several dots and no comma are thousands marks; what is no number comes back as it is."""

    def marked(v: Column) -> Column:
        many_dots = ~v.contains(",") & (F.length(v) - F.length(without(v, ".")) > 1)
        return F.when(many_dots, without(v, ".")).otherwise(_one_mark(v))

    bare = F.regexp_replace(without(F.coalesce(value, F.lit("")), "$", "€", "₹"), r"\s+", "")
    return let(let(bare, marked), lambda v: two_decimals(v, v))


def drafted_amount(value: Column) -> Column:
    """For drafts of the truth: commas go where there is a dot; of several the last may part two decimals; else blank."""

    def marked(v: Column) -> Column:
        commas = F.length(v) - F.length(without(v, ","))
        last = F.substring_index(v, ",", -1)
        return (
            F.when(v.rlike(r"\A[0-9]+[.,][0-9]{2}\z"), F.replace(v, F.lit(","), F.lit(".")))
            .when((commas > 0) & v.contains("."), without(v, ","))
            .when((commas > 1) & (F.length(last) == 2), F.concat(without(F.regexp_replace(v, r",[^,]*\z", ""), ","), F.lit("."), last))
            .when(commas > 1, without(v, ","))
            .otherwise(v)
        )

    return let(let(without(stripped(value), "₹", "$", "€", "£", " "), marked), lambda v: two_decimals(v, F.lit("")))


def normalize_value(field: Column, value: Column, dot_dates: bool = True) -> Column:
    """The form in which values of a field are compared. dot_dates: dots part a date as dashes do."""

    def of(v: Column) -> Column:
        return (
            F.when(field.isin(IDENTIFIERS), F.upper(F.regexp_replace(v, "[^A-Za-z0-9]", "")))
            .when(field == DATE, F.upper(F.translate(v, "-." if dot_dates else "-", "//" if dot_dates else "/")))
            .when((v != "") & field.isin(AMOUNTS), comparison_amount(v))
            .otherwise(F.upper(v))
        )

    return let(F.regexp_replace(stripped(value), r"\s+", " "), of)


def normalize_token(value: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), "[^A-Za-z0-9]", ""))


def tokens(value: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))


def safe_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def percent(value: Column) -> Column:
    """Two decimals and a sign, or a dash for null."""
    return F.coalesce(F.format_string("%.2f%%", value), F.lit("—"))


def shortened(value: Column) -> Column:
    """For tables: more than 28 characters become 25 and three dots."""
    return F.when(F.length(value) > 28, F.concat(F.substring(value, 1, 25), F.lit("..."))).otherwise(value)


def keyword_flags(text: Column) -> Column:
    return F.struct(*[F.coalesce(text.contains(w), F.lit(False)).alias(w.lower()) for w in ("Invoice", "Total", "Bank")])


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


def char_count(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")
