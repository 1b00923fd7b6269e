"""Dates are read by one format each, and lines of a report are matched once for each cell."""

from datetime import datetime

from pyspark.sql import functions as F

from ledgerlens.functions import validate
from ledgerlens.operators import review


def test_dates_are_read_by_one_format(spark):
    formats = {"/": ["%d/%m/%Y", "%m/%d/%Y", "%d/%m/%y", "%m/%d/%y"], "-": ["%d-%m-%Y", "%d-%m-%y", "%Y-%m-%d", "%d-%b-%Y", "%d-%b-%y"]}

    def readable(text):
        for f in formats["/" if "/" in text else "-"]:
            try:
                return bool(datetime.strptime(text, f))
            except ValueError:
                pass
        return False

    numbers = ["0", "2", "02", "11", "12", "13", "29", "30", "31", "32"]
    texts = [f"{a}{x}{b}{x}{y}" for x in "/-" for a in numbers for b in numbers for y in ("1900", "2024", "24", "23")]
    texts += [f"{y}-{a}-{b}" for y in ("0001", "2023", "2024") for a in numbers for b in numbers] + ["3-Jan-24", "31-feb-2024", "1-JUN-2024"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", validate.is_date(F.col("t")).alias("d")).collect()
    assert [r.t for r in rows if r.d != readable(r.t)] == []


def test_lines_are_matched_once_a_cell(spark):
    lines = spark.createDataFrame([(1, "VAT   1.20   91%   ✓ OK"), (2, "VAT      N/A   ⚠ INVALID"), (3, "= VAT 1 91% ✓ OK"), (4, None)], "i int, line string")
    out = review.parse_report(lines)
    assert [tuple(r) for r in out.collect()] == [(1, "VAT", "1.20")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
