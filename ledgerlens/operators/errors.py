"""Error analysis over a detailed results table, whatever its columns are called."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import normalize_value, round2
from ..functions.similarity import certainly_equal
from ..schemas import AMOUNTS, DATE, FIELDS, IDENTIFIERS

# fixed values: names under which the columns may appear, and the categories
COLUMN_NAMES = {
    "method": ["method", "preprocessing_method", "preprocessing"],
    "field": ["field", "field_name"],
    "ground_truth": ["ground_truth", "groundtruth", "expected", "actual", "true_value"],
    "predicted": ["predicted", "prediction", "extracted_value", "ocr_value"],
    "image": ["image", "filename", "invoice", "file"],
}
CATEGORIES = ["Missing Extraction", "Date Error", "Numeric / Amount Error", "Character / Identifier Error", "Other Field Mismatch"]


def find_column(columns: list[str], names: list[str]) -> str | None:
    """The column that the first of names to be found stands for; letters and digits count. Of two alike the later."""
    plain = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    known = {plain(c): c for c in columns}
    return next((known[plain(n)] for n in names if plain(n) in known), None)


def locate_columns(df: DataFrame) -> dict[str, str | None]:
    return {k: find_column(df.columns, names) for k, names in COLUMN_NAMES.items()}


def error_category(field: Column, predicted_norm: Column) -> Column:
    return (
        F.when(predicted_norm == "", CATEGORIES[0]).when(field == DATE, CATEGORIES[1]).when(field.isin(AMOUNTS), CATEGORIES[2]).when(field.isin(IDENTIFIERS), CATEGORIES[3]).otherwise(CATEGORIES[4])
    )


def error_details(detailed: DataFrame) -> DataFrame:
    """(image, method, field, ground_truth, predicted, error_category) of all pairs that do not agree.

    A pair without a truth is an error, too. Only the benchmark's fields count. Dots in dates are kept here.
    """
    where = locate_columns(detailed)
    lost = [k for k, c in where.items() if c is None and k != "image"]
    if lost:
        raise ValueError(f"no column for {', '.join(lost)} among {', '.join(detailed.columns)}")
    text = lambda k: F.coalesce(F.col(f"`{where[k]}`").cast("string"), F.lit("")) if where[k] else F.lit("")
    rows = detailed.select(*[text(k).alias(k) for k in ("image", "method", "field", "ground_truth", "predicted")])
    rows = rows.withColumn("field", F.trim("field")).filter(F.col("field").isin(FIELDS) & ~certainly_equal(F.col("predicted"), F.col("ground_truth")))
    rows = rows.withColumns({"_t": normalize_value(F.col("field"), F.col("ground_truth"), False), "_p": normalize_value(F.col("field"), F.col("predicted"), False)})
    wrong = rows.filter(~((F.col("_t") != "") & (F.col("_t") == F.col("_p"))))
    return wrong.withColumn("error_category", error_category(F.col("field"), F.col("_p"))).drop("_t", "_p")


def category_summary(errors: DataFrame) -> DataFrame:
    """By method and category, with the method's total and the share of it."""
    out = errors.groupBy("method", "error_category").agg(F.count(F.lit(1)).alias("error_count"))
    out = out.withColumn("total_errors", F.sum("error_count").over(Window.partitionBy("method")))
    return out.withColumn("percentage_of_errors", round2(F.col("error_count") * F.lit(100.0) / F.col("total_errors")))


def field_error_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("method", "field").agg(F.count(F.lit(1)).alias("error_count"))


def error_pivot(errors: DataFrame) -> DataFrame:
    """A row per method, a column per category, 0 where there is none."""
    return errors.groupBy("method").pivot("error_category", CATEGORIES).agg(F.count(F.lit(1))).na.fill(0)


def errors_by_category(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_category").agg(F.count(F.lit(1)).alias("error_count"))
