"""Scoring of predictions against ground truth, and the ranking and comparison of methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import mean2, round2
from ..functions.similarity import scores
from ..schemas import AMOUNTS, BASELINE, DEFAULT_METHOD, FIELDS


def to_long(wide: DataFrame, value: str, *key: str) -> DataFrame:
    """(key, field_id, field, value): one row for each field of each row."""
    cells = F.array(*[F.struct(F.lit(k).alias("field_id"), F.lit(f).alias("field"), F.coalesce(F.col(f"`{f}`"), F.lit("")).alias(value)) for k, f in enumerate(FIELDS)])
    return wide.select(*key, F.inline(cells))


def join_images(truth: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truth rows whose image is there, and those whose is missing; rows without a name are skipped."""
    named = truth.filter(F.trim(F.coalesce("image", F.lit(""))) != "")
    return named.join(images.select("image").distinct(), "image", "left_semi"), named.join(images.select("image"), "image", "left_anti")


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (…, field, actual, predicted) with match (null without a truth), exact_match and character_accuracy.

    Without a truth the pair counts as wrong, with accuracy 0, in the detailed table.
    """
    out = pairs.withColumn("_s", scores(F.col("field"), F.col("predicted"), F.col("actual")))
    return out.withColumns({"match": F.col("_s.match"), "exact_match": F.coalesce("_s.match", F.lit(False)), "character_accuracy": F.coalesce("_s.accuracy", F.lit(0.0))}).drop("_s")


def detailed_results(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Long truth (image, field_id, field, actual) with every method's prediction; a missing one is blank.

    predicted: (image, method, ocr_confidence, field, predicted), read once: an image's predictions by one method, few
    as its fields are, come together before they meet its truth.
    """
    got = predicted.groupBy("image", "method").agg(F.collect_set(F.struct("ocr_confidence")).alias("_runs"), F.collect_list(F.struct("field", "predicted")).alias("_got"))
    pairs = truth.join(got.select("image", "method", F.explode("_runs").alias("_run"), "_got"), "image").withColumn("ocr_confidence", F.col("_run.ocr_confidence"))
    pairs = pairs.withColumn("_hit", F.explode_outer(F.filter("_got", lambda g: g["field"] == F.col("field"))))
    return scored(pairs.withColumn("predicted", F.coalesce("_hit.predicted", F.lit(""))).drop("_got", "_hit", "_run"))


def _rate(part: Column, whole: Column) -> Column:
    """part of whole in percent, two decimals; 0 of nothing."""
    return F.when(whole > 0, round2(F.try_divide(part * F.lit(100.0), whole))).otherwise(0.0)


def image_summary(facts: DataFrame) -> DataFrame:
    """By image and method, over the fields that have a truth."""
    known = F.col("match").isNotNull()
    out = facts.groupBy("image", "method").agg(F.count_if("match").alias("correct"), F.count_if(known).alias("evaluated"), mean2(F.when(known, F.col("character_accuracy"))).alias("acc"))
    return out.select(
        "image", "method", "correct", "evaluated", _rate(F.col("correct"), F.col("evaluated")).alias("field_accuracy"), F.coalesce("acc", F.lit(0.0)).alias("character_accuracy"),
        (F.col("evaluated") - F.col("correct")).alias("incorrect"), _rate(F.col("evaluated") - F.col("correct"), F.col("evaluated")).alias("review_proxy"),
    )


def field_summary(facts: DataFrame) -> DataFrame:
    out = facts.groupBy("method", "field_id", "field").agg(F.count_if("exact_match").alias("correct"), F.count(F.lit(1)).alias("evaluated"), mean2(F.col("character_accuracy")).alias("acc"))
    return out.select("method", "field_id", "field", "correct", "evaluated", _rate(F.col("correct"), F.col("evaluated")).alias("exact_field_accuracy"), F.col("acc").alias("character_accuracy"))


def method_summary(facts: DataFrame) -> DataFrame:
    """One aggregation by image first keeps the distinct count of images out of the large shuffle."""
    hundredths = lambda c: F.floor(F.col(c) * 100 + 0.5)  # noqa: E731  exact in any order of rows
    by_image = facts.groupBy("method", "image").agg(
        F.count_if("exact_match").alias("c"), F.count(F.lit(1)).alias("n"), F.sum(hundredths("character_accuracy")).alias("a"), F.sum(hundredths("ocr_confidence")).alias("s"), F.count("ocr_confidence").alias("k")
    )
    out = by_image.groupBy("method").agg(
        F.count(F.lit(1)).alias("invoices_tested"), F.sum("c").alias("correct_fields"), F.sum("n").alias("evaluated_fields"), F.sum("a").alias("a"), F.try_divide(F.sum("s"), F.sum("k")).alias("conf")
    )
    n = F.col("evaluated_fields")
    return out.select(
        "method", "invoices_tested", "correct_fields", "evaluated_fields", _rate(F.col("correct_fields"), n).alias("aggregate_field_accuracy"), (F.floor(F.col("a") / n + 0.5) / F.lit(100.0)).alias("character_accuracy"),
        _rate(n - F.col("correct_fields"), n).alias("manual_review_proxy_rate"), (F.floor(F.col("conf") + 0.5) / F.lit(100.0)).alias("average_tesseract_confidence"),
    )


def ranked(summary: DataFrame) -> DataFrame:
    """summary with rank: best accuracy first, ties by name. A few rows, one per method."""
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("aggregate_field_accuracy"), "method")))


def best_method(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("aggregate_field_accuracy"), "method").limit(1)


def winner(summary: DataFrame, accuracy: str = "aggregate_field_accuracy") -> DataFrame:
    """(method, accuracy) of the first row, in order of the column ord, with the greatest accuracy that is a number;
    the default method and null if there is none."""
    usable = summary.select("method", F.col(accuracy).cast("string").try_cast("double").alias("accuracy"), "ord").filter("accuracy > -1 and not isnan(accuracy) and trim(method) != ''")
    top = usable.agg(F.max_by("method", F.struct("accuracy", -F.col("ord"))).alias("method"), F.max("accuracy").alias("accuracy"))
    return top.select(F.coalesce("method", F.lit(DEFAULT_METHOD)).alias("method"), "accuracy")


def baseline_comparison(summary: DataFrame, fields: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Metric rows of the baseline and the best method. For the review rate less is better.

    If the baseline itself is best all improvements are 0. Without a baseline row the table is empty.
    """
    best = best_method(summary)
    wide = ["character_accuracy", "aggregate_field_accuracy", "manual_review_proxy_rate"]
    base = summary.filter(F.col("method") == baseline).select(F.col("method").alias("baseline_method"), *[F.col(c).alias(f"b_{c}") for c in wide])
    pair = best.select(F.col("method").alias("improved_method"), *[F.col(c).alias(f"i_{c}") for c in wide]).crossJoin(base)  # one row with one row

    def row(k: int, label: str, column: str, sign: int) -> Column:
        b, i = F.col(f"b_{column}"), F.col(f"i_{column}")
        return F.struct(F.lit(k).alias("metric_id"), F.lit(label).alias("metric"), "baseline_method", "improved_method", b.alias("b"), i.alias("i"), (sign * (i - b)).alias("gain"))

    labels = [("Character Accuracy", wide[0], 1), ("Overall Field Accuracy", wide[1], 1), ("Manual Review Proxy Rate", wide[2], -1)]
    rows = [pair.select(F.inline(F.array(*[row(k, *x) for k, x in enumerate(labels)])))]
    names = pair.select("baseline_method", "improved_method")
    by = fields.select("method", "field_id", "field", "exact_field_accuracy")
    b = by.select(F.col("method").alias("baseline_method"), "field_id", "field", F.col("exact_field_accuracy").alias("b"))
    i = by.select(F.col("method").alias("improved_method"), "field_id", F.col("exact_field_accuracy").alias("i"))
    both = names.join(b, "baseline_method").join(i, ["improved_method", "field_id"])
    gain = (F.col("i") - F.col("b")).alias("gain")
    rows.append(both.select((F.col("field_id") + 3).alias("metric_id"), F.concat("field", F.lit(" Accuracy")).alias("metric"), "baseline_method", "improved_method", "b", "i", gain))
    money = both.filter(F.col("field").isin(AMOUNTS)).groupBy("baseline_method", "improved_method").agg(F.avg("b").alias("b"), F.avg("i").alias("i"))
    rows.append(money.select(F.lit(3 + len(FIELDS)).alias("metric_id"), F.lit("Amount Fields Accuracy").alias("metric"), "baseline_method", "improved_method", "b", "i", gain))
    out = reduce(DataFrame.unionByName, rows)
    return out.select("metric_id", "metric", "baseline_method", "improved_method", round2(F.col("b")).alias("baseline_value"), round2(F.col("i")).alias("improved_value"), round2(F.col("gain")).alias("improvement_percentage_points"))


def amount_accuracy(fields: DataFrame) -> DataFrame:
    """By method the mean of the money fields' rounded accuracies."""
    return fields.filter(F.col("field").isin(AMOUNTS)).groupBy("method").agg(round2(F.avg("exact_field_accuracy")).alias("amount_fields_accuracy"))
