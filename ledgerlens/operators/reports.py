"""Text reports and the series behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import quality_score
from ..schemas import DEFAULT_METHOD


# fixed values: the report's sentences
HEAD = "===== OCR METHOD COMPARISON =====\n\nMethod        Words     Characters   OCR Conf.     Time\n" + "-" * 55 + "\n"
WINNER = "\nDATASET-VALIDATED RECOMMENDATION\nRecommended Method: "
ACCURACY = "\nGround-truth field accuracy: "
ADVICE = "\n\nThis recommendation comes from results held against verified values.\nIt is a dataset-level recommendation, not a claim that every individual invoice has the same optimal preprocessing method.\n"
WITHOUT = (
    f"\nRECOMMENDED METHOD: {DEFAULT_METHOD}\n\nThe validated benchmark summary was not found.\n{DEFAULT_METHOD} is the project's validated benchmark winner and is used as the configured default.\n"
)


def _wide(value: Column, n: int) -> Column:
    return F.when(F.length(value) < n, F.rpad(value, n, " ")).otherwise(value)


def _shown(value: Column, pattern: str) -> Column:
    """A number by pattern; what is no number as it stands."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isNull(), F.coalesce(value.cast("string"), F.lit("None"))).otherwise(F.format_string(pattern, number))


def method_lines(runs: DataFrame) -> DataFrame:
    """(method_id, line): the comparison table's lines from rows (method_id, method, words, chars, confidence, time)."""
    line = F.concat(_wide(F.col("method"), 14), _wide(F.col("words").cast("string"), 10), _wide(F.col("chars").cast("string"), 13), _wide(_shown(F.col("confidence"), "%.1f%%"), 13), _shown(F.col("time"), "%.3fs"))
    return runs.select("method_id", line.alias("line"))


def comparison_report(runs: DataFrame, winner: DataFrame) -> DataFrame:
    """(report, recommended_method): the table and the recommendation; winner is one row (method, accuracy).

    The winner comes from verified results, never from the run's own counts; without one the default is named.
    """
    lines = method_lines(runs).agg(F.transform(F.array_sort(F.collect_list(F.struct("method_id", "line"))), lambda x: x["line"]).alias("lines"))
    found = F.concat(F.lit(WINNER), F.col("method"), F.lit(ACCURACY), F.format_string("%.2f%%", F.col("accuracy")), F.lit(ADVICE))
    body = F.concat(F.lit(HEAD), F.array_join("lines", "\n"), F.lit("\n"), F.when(F.col("accuracy").isNull(), WITHOUT).otherwise(found))
    return lines.crossJoin(winner).select(body.alias("report"), F.when(F.col("accuracy").isNull(), DEFAULT_METHOD).otherwise(F.col("method")).alias("recommended_method"))  # one row with one row


def run_series(runs: DataFrame) -> DataFrame:
    """(method_id, method, confidence, quality, words): the three charts of a run."""
    return runs.select("method_id", "method", "confidence", quality_score(F.col("words"), F.col("confidence")).alias("quality"), "words")


def benchmark_series(summary: DataFrame) -> DataFrame:
    """(chart, method, value): the bars of the benchmark's charts by method."""
    charts = ["aggregate_field_accuracy", "character_accuracy", "manual_review_proxy_rate", "average_tesseract_confidence"]
    return summary.select("method", F.inline(F.array(*[F.struct(F.lit(c).alias("chart"), F.col(c).alias("value")) for c in charts]))).select("chart", "method", "value")
