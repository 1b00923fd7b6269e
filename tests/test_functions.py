"""Normalisers, similarity, validation and extraction on worked cases."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import extract, normalize, similarity, validate
from ledgerlens.schemas import FIELDS

AMOUNTS = [  # text, compared, extracted, drafted
    ("1,500.00", "1500.00", "1500.00", "1500.00"), ("$2,500.50", "2500.50", "2500.50", "2500.50"), ("2500,50", "2500.50", "2500.50", "2500.50"), ("1.234,56", "1234.56", "1234.56", "1.23"),
    ("5 640,17", "5640.17", "5640.17", "5640.17"), ("1,16,800.00", "116800.00", "116800.00", "116800.00"), ("1,500", "1.50", "1.50", ""), ("1,234,567", "1.234.567", "1.234.567", "1234567.00"),
    ("1,23,45", "1.23.45", "1.23.45", "123.45"), ("1.2.3", "1.2.3", "123.00", ""), ("£5.00", "£5.00", "£5.00", "5.00"), ("Rs. 100", "100.00", "Rs.100", ""), ("abc", "ABC", "abc", ""), (None, "", "", ""), ("", "", "", ""),
    ("nan", "NAN", "nan", ""), ("1_000", "1_000", "1_000", ""), ("5d", "5D", "5d", ""), ("-3", "-3.00", "-3.00", "-3.00"), ("1e2", "100.00", "100.00", "100.00"),
]


def test_amounts(spark):
    v = F.col("v")
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(AMOUNTS)], "i int, v string")
    got = df.select("i", normalize.comparison_amount(v).alias("a"), normalize.extracted_amount(v).alias("b"), normalize.drafted_amount(v).alias("c")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [a[1:] for a in AMOUNTS]


CASES = [  # field, predicted, actual, normalised prediction, match, accuracy
    ("Invoice Number", "INV-001", "INV001", "INV001", True, 100.0), ("Invoice Number", "INV-002", "INV001", "INV002", False, 83.33), ("Gross Worth", "$1,500.00", "1500.00", "1500.00", True, 100.0), ("VAT", "", "1.00", "", False, 0.0),
    ("VAT", "1", "", "1.00", None, None), ("VAT", None, None, "", None, None), ("Invoice Date", "01-02.2026", "01/02/2026", "01/02/2026", True, 100.0), ("Seller Tax ID", "942-92-5992", "938-91-6436", "942925992", False, 22.22),
    ("Client Tax ID", "913941721", "9139941721", "913941721", False, 90.0), ("Other", " a \t b\n", "A B", "A B", True, 100.0),
]


def test_similarity(spark):
    f, p, a = F.col("f"), F.col("p"), F.col("a")
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, f string, p string, a string")
    got = df.select("i", normalize.normalize_value(f, p).alias("n"), similarity.field_matches(f, p, a).alias("m"), similarity.character_accuracy(f, p, a).alias("c")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[3:] for c in CASES]
    kept = df.filter("f = 'Invoice Date'").select(normalize.normalize_value(f, p, False)).head()[0]
    assert kept == "01/02.2026"


def test_tokens_ratio_quality(spark):
    df = spark.createDataFrame([("KA-01-AB-1234",), ("inv-001",), (None,), ("1,16,800.00",)], "v string")
    assert [r[0] for r in df.select(normalize.normalize_token(F.col("v"))).collect()] == ["KA01AB1234", "INV001", "", "11680000"]
    assert df.limit(1).select(similarity.sequence_ratio(F.lit("INV001"), F.lit("INV002"))).head()[0] == pytest.approx(0.8333, abs=1e-4)
    q = spark.createDataFrame([(50, 90.0), (100, 90.0), (250, 90.0), (0, None), (100, float("nan"))], "w long, c double").select(similarity.quality_score(F.col("w"), F.col("c")))
    assert [r[0] for r in q.collect()] == [82.0, 92.0, 92.0, 0.0, 20.0]


VALID = [
    ("GSTIN", "29abcde1234f1z5", True), ("GSTIN", "2ABCDE1234F1Z5", False), ("Invoice Number", "A/1-2_3.4", True), ("Invoice Number", "-1", False), ("Invoice Number", "1\n", True), ("Invoice Date", "31/12/2025", True), ("Invoice Date", "12/31/25", True),
    ("Invoice Date", "5-Jan-26", True), ("Invoice Date", "5-jan-2026", True), ("Invoice Date", "2026-02-30", False), ("Invoice Date", "01/02/202", False), ("Invoice Date", "1.2.2026", False), ("Vehicle Number", "ka 01 ab 1234", True), ("Vehicle Number", "KA1A12", False),
    ("IFSC", "abcd0123456", True), ("IFSC", "ABCD1123456", False), ("Account Number", "123 456", True), ("Account Number", "12345", False), ("Total Amount", "₹1,500.50", True), ("Total Amount", "-1", False), ("Total Amount", "nan", False), ("Total Amount", "5d", False),
    ("Company Name", "ab", False), ("Company Name", "123", False), ("Bank Name", "éab", True), ("Seller IBAN", "x", False), ("Seller IBAN", "xy", True), ("VAT", " ", False), ("VAT", None, False),
]


def test_validation(spark):
    df = spark.createDataFrame([(i, f, v) for i, (f, v, _) in enumerate(VALID)], "i int, f string, v string")
    got = df.select("i", validate.validate_field(F.col("f"), F.col("v")).alias("r")).orderBy("i").collect()
    assert [r.r.valid for r in got] == [v for *_, v in VALID]
    assert got[-1].r.reason == "Field is empty" and got[0].r.reason == "Valid GSTIN format"
    one = spark.range(1).select(validate.validate_invoice(F.create_map(F.lit("VAT"), F.lit("1.00"))).alias("a"), validate.validate_invoice(F.lit(None).cast("map<string,string>")).alias("b")).head()
    assert one.a["VAT"].valid and one.a["VAT"].value == "1.00" and one.b == {}


TEXT = "Invoice no: INV-001\nDate of issue: 15/08/2026\nSeller: x\nTax Id: 123-45-6789\nIBAN: GB82WEST12345698765432\nClient: y\nTax Id: 987-65-4321\nSUMMARY\nTotal 100.00 18.00 118.00"


def test_extraction(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in f(F.col("t")).items()]).head().asDict()
    want = dict(zip(FIELDS, ["INV-001", "15/08/2026", "123-45-6789", "987-65-4321", "GB82WEST12345698765432", "100.00", "18.00", "118.00"], strict=True))
    assert one(TEXT, extract.extract_fields) == want
    assert one(TEXT.replace("Total 100.00 18.00 118.00", "Total $100.00 $18.00 $118.00"), extract.draft_fields) == want
    assert one(TEXT, extract.draft_fields)["VAT"] == ""  # there, blanks do not part amounts
    assert one(None, extract.extract_fields) == dict.fromkeys(FIELDS, "") == one("", extract.draft_fields)
    # a lost first id shifts the second; amounts may swallow an integer before them; fewer than three amounts give none
    assert one("Tax Id: 987-65-4321", extract.extract_fields)["Seller Tax ID"] == "987-65-4321"
    assert one("Total 3 100.00 6 204,19 $ 1.00", extract.extract_fields)["Net Worth"] == "3100.00"
    assert one("Total 1.00 2.00", extract.extract_fields)["VAT"] == ""
    assert one("IBAN:\nGB82 WEST 1234 5698 7654 32", extract.extract_fields)["Seller IBAN"] == "GB82WEST12345698765432"
    assert one("SUMMARY $5.00 $5.00 $6.00 $11.00", extract.draft_fields)["Net Worth"] == "5.00"


def test_iban_and_labels(spark):
    df = spark.createDataFrame([("GB82WEST12345698765432",), ("IN57228NORTHDOUGLAS",), ("GB821234",), ("gb82-west 1234.5698/7654_32",), (None,)], "v string")
    assert [r[0] for r in df.select(extract.cleaned_iban(F.col("v"))).collect()] == ["GB82WEST12345698765432", "", "", "GB82WEST12345698765432", ""]
    labels = spark.createDataFrame([("Seller",), ("SELLLER",), ("C1ient",), ("cllent!",), ("x",)], "v string").select(extract.party_label(F.col("v"))).collect()
    assert [r[0] for r in labels] == ["seller", "seller", "", "client", ""]
