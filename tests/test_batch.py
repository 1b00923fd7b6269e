"""Files to routed rows, text from boxes, and confidences, against SQL; extraction from texts of several lines."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerlens.functions import extract
from ledgerlens.operators import images, ocr, review
from ledgerlens.plans import batch
from ledgerlens.sources import bitmaps


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", ["truth_round_trip", "batch_round_trip", "ocr_lines", "process_images", "first_processed", "exact_variants", "exact_confidence", "manual_review_counts", "detailed_results", "label_positions"])
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = __spark_entry__.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert ordered(got.select(*columns).collect()) == ordered(want.fetchall())


def test_every_oracle_is_a_text():
    assert all(isinstance(x, str) for x in __spark_entry__.oracle_sql().values())


def test_damaged_files_and_failing_engines_keep_their_rows(spark):
    picture = bitmaps.encode(np.unpackbits(np.frombuffer(b"Invoice no: 7", np.uint8))[None] * 255)
    files = spark.createDataFrame([("b.pgm", "b", picture), ("a.pgm", "a", b"damaged"), ("c.pgm", "c", None), ("d.pgm", "d", bitmaps.encode(np.zeros((1, 8), np.uint8)))], "image string, path string, content binary")
    rows = review.in_file_order(review.process_images(files, batch.bit_reader)).collect()
    assert [(r.Invoice, r["Invoice Number"], r["Validation Status"]) for r in rows] == [("a.pgm", "", "ERROR"), ("b.pgm", "7", "MANUAL REVIEW"), ("c.pgm", "", "ERROR"), ("d.pgm", "", "ERROR")]
    assert [r["Review Reason"] for r in rows][0] == "Image could not be read" and rows[3]["Review Reason"] == "Processing error: ValueError: an empty picture"


def test_plain_text_keeps_its_lines_and_failures_are_blank(spark):
    def engine(img):
        if not img.any():
            raise ValueError("black")
        return "two\nlines"

    shots = spark.createDataFrame([("a", images.encoded(np.full((2, 2), 200, np.uint8))), ("b", images.encoded(np.zeros((2, 2), np.uint8)))], "image string, pixels struct<height:int,width:int,channels:int,data:binary>")
    texts = ocr.plain_texts(images.variants(shots, ["Gray"]), engine)
    assert sorted((r.image, r.text) for r in texts.collect()) == [("a", "two\nlines"), ("b", "")]
    words = F.array(F.struct(F.lit("from").alias("text"), F.lit(90.0).alias("confidence")), F.struct(F.lit("boxes").alias("text"), F.lit(80.0).alias("confidence")))
    got = texts.select("image", ocr.primary_text(F.col("text"), words).alias("t")).collect()
    assert sorted((r.image, r.t) for r in got) == [("a", "two\nlines"), ("b", "from boxes")]


def test_extraction_from_several_lines(spark):
    text = "Invoice no: 51109338\nDate of issue:\n04/13/2013\nSeller: Client:\nTax Id: 945-82-2137 Tax Id: 942-80-0517\nIBAN: GB75MCRL06841367619257\nSUMMARY\nVAT [%] Net worth VAT Gross worth\nTotal $ 5 640,17 $ 564,02 $ 6 204,19\n"
    row = spark.createDataFrame([(text,)], "text string").select(*[c.alias(k) for k, c in extract.extract_fields(F.col("text")).items()]).head()
    assert (row["Invoice Number"], row["Invoice Date"], row["Seller Tax ID"], row["Client Tax ID"], row["Seller IBAN"]) == ("51109338", "04/13/2013", "945-82-2137", "942-80-0517", "GB75MCRL06841367619257")
    assert row["Net Worth"] and row["VAT"] and row["Gross Worth"]
