"""Figures of a batch and views for a dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import is_blank, round2
from ..schemas import FIELDS

STATUS_NAMES = ["status", "decision", "review_status", "Validation Status"]


def batch_kpis(status: Column, review: Column, seconds: Column) -> list[Column]:
    """Aggregates: total, auto_accepted, manual_review, errors, both rates, average_seconds; rates of nothing are 0."""
    n = F.count(F.lit(1))
    accepted, reviewed = F.count_if(status == "AUTO ACCEPT"), F.count_if(review == "YES")
    rate = lambda part: F.when(n > 0, round2(F.try_divide(part * F.lit(100.0), n))).otherwise(0.0)
    mean = F.avg(seconds.cast("string").try_cast("double"))
    return [
        n.alias("total"), accepted.alias("auto_accepted"), reviewed.alias("manual_review"), F.count_if(status == "ERROR").alias("errors"),
        rate(accepted).alias("straight_through_rate"), rate(reviewed).alias("manual_review_rate"), F.when(n > 0, F.floor(mean * 1000 + 0.5) / F.lit(1000.0)).otherwise(0.0).alias("average_seconds"),
    ]


def batch_summary(batch: DataFrame) -> DataFrame:
    return batch.agg(*batch_kpis(F.col("Validation Status"), F.col("Manual Review"), F.col("`Processing Time (seconds)`")))


def status_column(df: DataFrame) -> str | None:
    return next((c for c in STATUS_NAMES if c in df.columns), None)


def status_counts(df: DataFrame, column: str | None = None) -> DataFrame:
    """Rows whose status says accept, review, or error or failed, in any case; one row may count for several."""
    s = F.lower(F.coalesce(F.col(f"`{column or status_column(df)}`").cast("string"), F.lit("")))
    return df.agg(F.count_if(s.contains("accept")).alias("accepted"), F.count_if(s.contains("review")).alias("review"), F.count_if(s.contains("error") | s.contains("failed")).alias("errors"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Most frequent first, ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def missing_counts(records: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(field_id, field, missing): blank values of each field, in one pass."""
    one = records.agg(*[F.count_if(is_blank(F.col(f"`{f}`"))).alias(f"m{k}") for k, f in enumerate(fields)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("field_id"), F.lit(f).alias("field"), F.col(f"m{k}").alias("missing")) for k, f in enumerate(fields)])))


def method_row(summary: DataFrame, method: str) -> DataFrame:
    return summary.filter(F.lower("method") == method.lower())


def overview(summary: DataFrame, improved: str = "Threshold", baseline: str = "Original") -> DataFrame:
    """(metric, baseline, improved, delta): three metrics of two methods, the change with sign and unit."""
    wide = [("Field Accuracy", "aggregate_field_accuracy"), ("Character Accuracy", "character_accuracy"), ("Manual Review Rate", "manual_review_proxy_rate")]
    b = method_row(summary, baseline).select(*[F.col(c).alias(f"b_{c}") for _, c in wide])
    i = method_row(summary, improved).select(*[F.col(c).alias(f"i_{c}") for _, c in wide])
    rows = [
        F.struct(F.lit(k).alias("metric_id"), F.lit(n).alias("metric"), F.col(f"b_{c}").alias("baseline"), F.col(f"i_{c}").alias("improved"), F.format_string("%+.2f pp", F.col(f"i_{c}") - F.col(f"b_{c}")).alias("delta"))
        for k, (n, c) in enumerate(wide)
    ]
    return b.crossJoin(i).select(F.inline(F.array(*rows)))  # one row with one row


def rows_naming(df: DataFrame, word: str) -> DataFrame:
    """Rows in which any column contains word, in any case."""
    return df.filter(reduce(Column.__or__, [F.coalesce(F.lower(F.col(f"`{c}`").cast("string")).contains(word.lower()), F.lit(False)) for c in df.columns]))


def numeric(df: DataFrame, column: str) -> DataFrame:
    """df with column as a number, without the rows in which it is none."""
    return df.withColumn(column, F.col(f"`{column}`").cast("string").try_cast("double")).filter(F.col(f"`{column}`").isNotNull())


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that df has."""
    return df.select(*[F.col(f"`{c}`") for c in columns if c in df.columns])


def field_metrics(comparison: DataFrame) -> DataFrame:
    """The field rows of a comparison, with the field as label."""
    overall = ["Character Accuracy", "Overall Field Accuracy", "Amount Fields Accuracy"]
    out = comparison.filter(F.col("metric").endswith("Accuracy") & ~F.col("metric").isin(overall))
    return out.withColumn("label", F.regexp_replace("metric", " Accuracy$", ""))
