"""Confidence, review, scoring, errors, figures, images, sources and the stream on worked cases."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import confidence, errors, evaluate, images, kpi, ocr, parties, reports, review
from ledgerlens.schemas import BATCH_COLUMNS, FIELDS
from ledgerlens.sources import bitmaps, sinks, tables
from ledgerlens.streaming import pipeline

WORDS = "array<struct<text:string,confidence:double>>"


def test_field_confidence(spark):
    say = lambda *w: [{"text": t, "confidence": c} for t, c in w]
    rows = [
        (0, "Invoice Number", "INV-001", say(("Invoice", 99.0), ("no", 99.0), ("INV", 95.0), ("001", 95.0))),
        (1, "Invoice Number", "INV-001", say(("WRONG", 95.0))),
        (2, "Invoice Number", "INV-001", say(("INV-001", 50.0))),
        (3, "Gross Worth", "118.00", say(("Gross", 80.0), ("118", 90.0), ("00", 90.0))),
        (4, "VAT", " ", say(("VAT", 90.0))),
        (5, "VAT", "1.00", None),
        (6, "VAT", "12", say(("12", 84.0), ("x", -1.0), ("", 5.0), (None, 7.0))),
        (7, "VAT", "1234567890", say(("12345X7890", 61.0))),
        (8, "VAT", "ab cd", say(("cd", 70.0), ("zz", 1.0), ("ab", 75.0))),
        (9, "VAT", "ab", say(("ab", 84.5), ("q", 84.5))),
    ]
    got = confidence.analyze_fields(spark.createDataFrame(rows, f"i int, field string, value string, words {WORDS}")).orderBy("i").collect()
    assert [(r.confidence, r.status) for r in got] == [(95, "OK"), (None, "OCR CONF. N/A"), (50, "LOW OCR"), (90, "OK"), (None, "MANUAL REVIEW"), (None, "OCR CONF. N/A"), (84, "CHECK"), (61, "CHECK"), (72, "CHECK"), (84, "CHECK")]
    assert [r.review for r in got][:2] == [False, True] and got[4].confidence_source == "none" and got[0].confidence_source == "field_word_level"
    overall = spark.createDataFrame([(84.6,), (85.0,), (59.9,), (float("nan"),)], "c double").select(confidence.field_confidence_overall(F.lit("x"), F.col("c")).alias("r")).collect()
    assert [(r.r.confidence, r.r.status) for r in overall] == [(85, "CHECK"), (85, "OK"), (60, "LOW OCR"), (0, "LOW OCR")]


def plain_match(value, words, labels):
    """The search without any short cut."""
    target = "".join(c for c in value if c.isalnum()).upper()

    def best(start, end):
        found, score = None, 0.0
        for a in range(start, min(end, len(words))):
            for b in range(a + 1, min(a + 4, end, len(words)) + 1):
                joined = "".join(words[a:b])
                if joined == target:
                    return list(range(a, b)), 1.0
                r = SequenceMatcher(None, target, joined).ratio()
                if r > score:
                    found, score = list(range(a, b)), r
        return found, score

    top, score = None, 0.0
    for at in labels:
        found, s = best(at + 1, at + 12)
        if s == 1.0:
            return found
        if found and s > score:
            top, score = found, s
    found, s = best(0, len(words))
    if found and s > score:
        top, score = found, s
    if top and score >= 0.8:
        return top
    used = []
    for part in value.upper().replace("-", " ").split():
        free = [k for k in range(len(words)) if k not in used]
        same = [k for k in free if words[k] == part]
        if not same:
            ratios = [SequenceMatcher(None, part, words[k]).ratio() for k in free]
            if not ratios or max(ratios) < 0.75:
                return []
            same = [free[int(np.argmax(ratios))]]
        used.append(same[0])
    return used


def test_short_cuts_change_nothing():
    rng = random.Random(7)
    for _ in range(600):
        words = ["".join(rng.choice("AB12") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 20))]
        value = "-".join("".join(rng.choice("AB12") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4)))
        labels = sorted(rng.sample(range(len(words)), rng.randrange(0, min(3, len(words)) + 1)))
        assert confidence.matched(value, words, labels) == plain_match(value, words, labels)


def test_review(spark):
    columns = "image string, method string, " + ", ".join(f"`{f}` string" for f in FIELDS) + ", ocr_confidence double, seconds double, error string"
    full = ["x"] * 8
    rows = [("a", "T", *full, 70.0, 1.23456, None), ("b", "T", *full, 69.99, 1.0, None), ("c", "T", *full[:4], " ", *full[5:], 10.0, 1.0, None), ("d", "T", *[None] * 8, None, None, "cannot read")]
    got = review.batch_results(spark.createDataFrame(rows, columns)).orderBy("Invoice").collect()
    assert got[0].asDict().keys() == set(BATCH_COLUMNS)
    assert [(r["Validation Status"], r["Manual Review"], r["Review Reason"]) for r in got] == [
        ("AUTO ACCEPT", "NO", "All benchmark fields present"), ("MANUAL REVIEW", "YES", "Low OCR confidence"), ("MANUAL REVIEW", "YES", "Missing: Seller IBAN"), ("ERROR", "YES", "cannot read")]
    k = kpi.batch_summary(review.batch_results(spark.createDataFrame(rows, columns))).head()
    assert (k.total, k.auto_accepted, k.manual_review, k.errors, k.straight_through_rate, k.manual_review_rate) == (4, 1, 3, 1, 25.0, 75.0)
    none = kpi.batch_summary(review.batch_results(spark.createDataFrame([], columns))).head()
    assert none.total == 0 and none.straight_through_rate == 0.0


def test_report_round_trip(spark):
    rows = [(0, "Invoice Number", "INV 1", 95, False), (1, "VAT", "x", None, True), (2, "Gross Worth", "1.00", 70, True), (3, "Invoice Date", "1.1", 99, False)]
    df = spark.createDataFrame([("a", *r) for r in rows], "image string, field_id int, field string, value string, confidence int, review boolean")
    judged = review.field_review(df)
    assert [r.review_status for r in judged.orderBy("field_id").collect()] == ["INVALID", "INVALID", "LOW OCR", "INVALID"]
    printed = review.printed_report(judged, "image")
    assert printed.head().report.startswith("FIELD               EXTRACTED VALUE")
    back = review.parse_report(printed.select("image", F.explode(F.split("report", "\n")).alias("line"))).collect()
    assert sorted((r.field, r.value) for r in back) == sorted((r[1], r[2]) for r in rows)
    assert review.review_counts(judged, "image").head().manual_review_count == 4


TRUTH, READ = ["INV1", "01/02/2026", "123-45-6789", "987-65-4321", "GB82WEST12345698765432", "1.00", "2.00", "3.00"], ["INV1", "", "123-45-678O", "", "GB82WEST12345698765432", "1,00", "2.00", "4.00"]


def test_scores_and_errors(spark):
    wide = spark.createDataFrame([("i", *TRUTH), ("j", "", *TRUTH[1:])], "image string, " + ", ".join(f"`{f}` string" for f in FIELDS))
    truth = evaluate.to_long(wide, "actual", "image")
    read = [(im, m, 80.0, f, v) for im in "ij" for m, vs in (("Original", READ), ("Gray", TRUTH)) for f, v in zip(FIELDS, vs, strict=True) if v]
    detailed = evaluate.detailed_results(truth, spark.createDataFrame(read, "image string, method string, ocr_confidence double, field string, predicted string"))
    assert detailed.count() == 32
    summary = {r.method: r for r in evaluate.method_summary(detailed).collect()}
    assert (summary["Original"].correct_fields, summary["Gray"].correct_fields, summary["Gray"].invoices_tested, summary["Gray"].aggregate_field_accuracy) == (7, 15, 2, 93.75)
    by_image = {(r.image, r.method): r for r in evaluate.image_summary(detailed).collect()}
    assert by_image["j", "Gray"].evaluated == 7 and by_image["j", "Gray"].field_accuracy == 100.0  # a blank truth is left out here
    comparison = evaluate.baseline_comparison(evaluate.method_summary(detailed), evaluate.field_summary(detailed)).orderBy("metric_id").collect()
    assert len(comparison) == 12 and comparison[2].improvement_percentage_points == 50.0 and {r.improved_method for r in comparison} == {"Gray"}
    only = evaluate.method_summary(detailed.filter("method = 'Original'"))
    same = evaluate.baseline_comparison(only, evaluate.field_summary(detailed.filter("method = 'Original'"))).collect()
    assert len(same) == 12 and {r.improvement_percentage_points for r in same} == {0.0}
    wrong = errors.error_details(detailed.withColumnRenamed("actual", "Ground-Truth"))
    assert {(r.field, r.error_category) for r in wrong.filter("method = 'Original' and image = 'i'").collect()} == {
        ("Invoice Date", "Missing Extraction"), ("Seller Tax ID", "Character / Identifier Error"), ("Client Tax ID", "Missing Extraction"), ("Gross Worth", "Numeric / Amount Error")}
    assert wrong.filter("method = 'Gray'").count() == 1  # here a blank truth is an error
    shares = errors.category_summary(wrong).filter("method = 'Original'").collect()
    assert sum(r.error_count for r in shares) == shares[0].total_errors == 9
    with pytest.raises(ValueError, match="no column for method"):
        errors.error_details(detailed.drop("method"))
    assert errors.find_column(["Field Name", "field_name"], ["field", "field_name"]) == "field_name"


def test_winner(spark):
    rows = [("A", "90.0", 0), ("B", "x", 1), ("C", "95.5", 2), ("D", "95.5", 3), ("", "99", 4)]
    df = spark.createDataFrame(rows, "method string, aggregate_field_accuracy string, ord long")
    assert tuple(evaluate.winner(df).head()) == ("C", 95.5)
    assert tuple(evaluate.winner(df.limit(0)).head()) == ("Threshold", None)
    runs = spark.createDataFrame([(0, "Original", 5, 9, "x", "0.5")], "method_id int, method string, words long, chars long, confidence string, time string")
    out = reports.comparison_report(runs, evaluate.winner(df.limit(0))).head()
    assert out.recommended_method == "Threshold" and "Original      5         9            x            0.500s" in out.report


def test_parties(spark):
    box = lambda im, k, t, x, y: (im, k, t, x, y, 60, 20)
    rows = [box("a", 0, "Seller:", 100, 100), box("a", 1, "Client:", 600, 100), box("a", 2, "Doe", 180, 130), box("a", 3, "John", 100, 130), box("a", 4, "123-45-6789", 100, 150), box("a", 5, "Late", 100, 210), box("a", 6, "Smith&Co", 600, 125), box("a", 7, "Tax", 660, 125), box("b", 0, "Seller", 1, 1)]
    got = {r.image: (r.seller, r.client) for r in parties.party_names(spark.createDataFrame(rows, "image string, pos int, text string, left int, top int, width int, height int")).collect()}
    assert got == {"a": ("John Doe", "Smith&Co"), "b": ("", "")}


def test_kernels():
    img = np.zeros((4, 5, 3), np.uint8)
    img[1, 2] = (10, 200, 90)
    gray = images.to_gray(img)
    assert gray.shape == (4, 5) and gray[1, 2] == round(0.299 * 90 + 0.587 * 200 + 0.114 * 10)
    assert images.threshold(np.array([[150, 151]], np.uint8)).tolist() == [[0, 255]]
    assert images.resize(np.array([[0, 100]], np.uint8)).tolist() == [[0, 25, 75, 100]] * 2
    assert images.sharpen(np.full((3, 3), 7, np.uint8)).tolist() == [[7] * 3] * 3
    assert images.sharpen(np.array([[0, 0, 0], [0, 60, 0], [0, 0, 0]], np.uint8))[1, 1] == 255
    flat = np.full((30, 30), 90, np.uint8)
    assert (images.adaptive_threshold(flat) == 255).all() and (images.denoise(flat) == 90).all()
    flat[15, 15] = 0
    assert images.adaptive_threshold(flat)[15, 15] == 0 and images.adaptive_threshold(flat)[0, 0] == 255


def test_images_to_words(spark, tmp_path):
    img = np.random.default_rng(1).integers(0, 255, (6, 7, 3), dtype=np.uint8)
    (tmp_path / "a.PPM").write_bytes(bitmaps.encode(img))
    (tmp_path / "b.ppm").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"x")
    pixels = tables.decode_bitmaps(tables.read_images(spark, str(tmp_path), ["ppm"]))
    got = {r.image: r.pixels for r in pixels.collect()}
    assert got["b.ppm"] is None and np.array_equal(images.decoded(got["a.PPM"].asDict()), img) and len(got) == 2
    assert images.variants(pixels).count() == 7
    some = images.variants(pixels, ["Threshold", "Gray"])

    def engine(a):
        if (a == 255).any() and ((a == 0) | (a == 255)).all():
            raise RuntimeError("no text")
        return [(" INV-1 ", 1, 2, 3, 4, 90.0), ("", 0, 0, 0, 0, 95.0), ("x", 0, 0, 0, 0, -1.0), ("y", 0, 0, 0, 0, 80.0)]

    boxes = ocr.ocr_boxes(some, engine)
    table = {r.method: r for r in ocr.ocr_table(boxes).collect()}
    assert table["Gray"].text == "INV-1 y" and table["Gray"].n_words == 2 and table["Threshold"].text == ""
    assert {r.method: r.error for r in boxes.collect()} == {"Gray": None, "Threshold": "RuntimeError: no text"}
    report = {r.method: r.confidence for r in ocr.run_report(ocr.ocr_table(boxes)).collect()}
    assert report == {"Gray": 85.0, "Threshold": 0.0}
    assert sinks.image_files(some).count() == 2


def test_tables(spark, tmp_path):
    path = str(tmp_path / "truth.csv")
    df = spark.createDataFrame([("a.png", *TRUTH), ("b.png", "NA", "null", *TRUTH[2:])], "image string, " + ", ".join(f"`{f}` string" for f in FIELDS))
    sinks.export_csv(df.orderBy("image"), path)
    back = tables.read_truth(spark, path).orderBy("image").collect()
    assert back[0]["Seller IBAN"] == TRUTH[4] and back[1]["Invoice Number"] == "" == back[1]["Invoice Date"]
    with pytest.raises(tables.MissingColumns, match="Validation Status"):
        tables.read_batch(spark, path)
    assert tables.read_tolerant(spark, str(tmp_path / "none.csv")) is None and tables.read_tolerant(spark, path).count() == 2
    sinks.write_csv(df, str(tmp_path / "out"), one_file=True)
    assert tables.read_truth(spark, str(tmp_path / "out")).count() == 2
    assert {r.field: r.missing for r in kpi.missing_counts(tables.read_truth(spark, path)).collect()}["Invoice Date"] == 1


def test_views(spark):
    df = spark.createDataFrame([("Auto Accept",), ("MANUAL REVIEW",), ("failed",), (None,)], "`Validation Status` string")
    assert tuple(kpi.status_counts(df).head()) == (1, 1, 1)
    assert kpi.value_counts(df, "Validation Status").count() == 4 and kpi.rows_naming(df, "acc").count() == 1
    assert kpi.present(df, ["x", "Validation Status"]).columns == ["Validation Status"]


def test_stream(spark, tmp_path):
    rows = [("a", "Invoice no: 1", 90.0, "2026-01-01 00:10:00"), ("b", "x", 10.0, "2026-01-01 05:00:00")]
    spark.createDataFrame(rows, "image string, text string, confidence double, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    texts = pipeline.read_texts(spark, str(tmp_path / "in"))
    pipeline.run_available(pipeline.routed(texts), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["Invoice Number"] for r in got.collect()} == {"1", ""} and got.filter("`Validation Status` = 'MANUAL REVIEW'").count() == 2
    pipeline.run_available(pipeline.running_kpis(pipeline.routed(texts)), str(tmp_path / "kpi"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kpi")).agg(F.sum("total")).head()[0] in (1, 2)
