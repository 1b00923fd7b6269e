"""Confidences of whole pages: as row by row, with words prepared once and few ratios taken."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import confidence
from ledgerlens.plans import queries

WORDS = "array<struct<text:string,confidence:double>>"


def test_pages_are_judged_as_their_rows(spark):
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("AB12-") for _ in range(rng.randrange(0, 9)))
    odd = [(None, 50.0), ("A1", None), ("B2", float("nan")), ("12", -1.0), ("AB", 250.0), ("--", 9.0), None]
    pages = []
    for i in range(60):
        words = [(text(), float(rng.randrange(101))) for _ in range(rng.randrange(0, 25))] + [("VAT", 40.0), ("Net", 41.0)] * (i % 3) + rng.sample(odd, 3)
        fields = [(k, f, v) for k, (f, v) in enumerate([("VAT", text()), ("Net Worth", text()), (None, "A1"), ("VAT", None), ("VAT", " "), ("Seller IBAN", text() + text())])]
        pages.append((i, fields[: i % 7], words if i % 10 else None))
    df = spark.createDataFrame(pages, f"i int, fields array<struct<field_id:int,field:string,value:string>>, words {WORDS}")
    rows = df.select("i", "words", F.inline("fields")).select("i", "field_id", "field", "value", "words")
    want = confidence.analyze_fields(rows).drop("words")
    got = confidence.analyze_pages(df)
    assert got.columns == [*want.columns, "one_word"]
    ready = F.transform(confidence.prepared_words(F.col("words")), lambda w: w["normalized"])
    spelt = rows.select("i", "field_id", F.array_contains(ready, confidence.normalize_token(F.col("value"))).alias("one")).collect()
    assert sorted((r.i, r.field_id, r.one) for r in spelt) == sorted((r.i, r.field_id, r.one_word) for r in got.collect())
    assert sorted(map(str, got.drop("one_word").collect())) == sorted(map(str, want.collect()))
    exact = confidence.analyze_pages(df, alike=False).filter("one_word").drop("one_word").collect()
    assert exact and sorted(map(str, exact)) == sorted(map(str, got.filter("one_word").drop("one_word").collect()))


def test_few_ratios_are_taken(monkeypatch):
    taken = []
    plain = confidence.ratio
    monkeypatch.setattr(confidence, "ratio", lambda a, b: taken.append(b) or plain(a, b))
    words = ["INVOICE", *["1234567", "7654321", "89"] * 12, "12345678"]
    assert confidence.matched("1234567890", words, [0, 3, 6]) == confidence.matched("1234567890", words, [0])
    assert len(taken) <= 2 * len(set(taken)) and len(set(taken)) <= 6


@pytest.mark.parametrize("name", ["field_confidence", "exact_confidence"])
def test_values_and_words_come_from_one_row(spark, sf, name):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("ArrowEvalPython") == 1 and queries.QUERIES[name]
