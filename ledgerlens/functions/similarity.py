"""Similarity of values: edit distance, character accuracy, exact match, and the matching-blocks ratio."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import let, normalize_value, round2


def accuracy_of(predicted: Column, actual: Column) -> Column:
    """character_accuracy of normalised values: null without a truth, else 0 to 100."""
    share = 1 - F.levenshtein(predicted, actual) / F.greatest(F.length(predicted), F.length(actual))
    return F.when(actual == "", None).when(predicted == actual, 100.0).when(predicted == "", 0.0).otherwise(round2(F.greatest(F.lit(0.0), share * 100)))


def match_of(predicted: Column, actual: Column) -> Column:
    return F.when(actual == "", None).otherwise((predicted != "") & (predicted == actual))


def _both(field: Column, predicted: Column, actual: Column, f: Callable[[Column, Column], Column]) -> Column:
    pair = F.struct(normalize_value(field, predicted).alias("p"), normalize_value(field, actual).alias("a"))
    return let(pair, lambda x: f(x["p"], x["a"]))


def certainly_equal(predicted: Column, actual: Column) -> Column:
    """Equal as they stand, and not blank in any normal form, since digits stay in all of them."""
    return (predicted == actual) & actual.rlike("[0-9]")


def scores(field: Column, predicted: Column, actual: Column) -> Column:
    """struct(match, accuracy) of one pair; only texts that differ as they stand, or have no digit, are normalised."""
    found = _both(field, predicted, actual, lambda p, a: F.struct(match_of(p, a).alias("match"), accuracy_of(p, a).alias("accuracy")))
    return F.when(certainly_equal(predicted, actual), F.struct(F.lit(True).alias("match"), F.lit(100.0).alias("accuracy"))).otherwise(found)


def character_accuracy(field: Column, predicted: Column, actual: Column) -> Column:
    return _both(field, predicted, actual, accuracy_of)


def field_matches(field: Column, predicted: Column, actual: Column) -> Column:
    """Null without a truth, else whether the normalised values are equal."""
    return _both(field, predicted, actual, match_of)


def ratio(a: str, b: str) -> float:
    """Ratcliff and Obershelp: twice the matching characters over all characters; without a search where one text holds the
    other, unless b is so long that frequent characters are not matched."""
    if a == b:
        return 1.0
    if len(b) < 200 and (a in b or b in a):
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def quality_score(n_words: Column, confidence: Column) -> Column:
    """Four fifths the confidence and one fifth the words, of which a hundred are enough; 0 to 100."""
    conf = F.coalesce(F.nanvl(confidence.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    words = F.least(n_words / F.lit(100.0), F.lit(1.0)) * 100
    return round2(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.8 * conf + 0.2 * words)))
