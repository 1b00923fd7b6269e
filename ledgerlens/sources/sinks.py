"""Writing of tables, reports and images."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Single-file exports go through the driver, so they are for reports and no longer than this.
MOST_ROWS = 1_000_000


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header; as many files as df has partitions, or one for small results."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def _bounded(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write a folder of files")
    return rows


def export_csv(df: DataFrame, path: str) -> None:
    """One local file with a byte order mark, as spreadsheets like it."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        out.writerows(_bounded(df))


def export_xlsx(df: DataFrame, path: str, sheet: str = "OCR Results") -> None:
    """One local workbook with a frozen, filtered header; needs openpyxl."""
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise RuntimeError("writing workbooks needs openpyxl") from e
    book = Workbook()
    page = book.active
    page.title = sheet
    rows = _bounded(df)
    for row in [df.columns, *map(list, rows)]:
        page.append(row)
    page.freeze_panes = "A2"
    page.auto_filter.ref = page.dimensions
    for k, name in enumerate(df.columns):
        page.column_dimensions[page.cell(1, k + 1).column_letter].width = max(12, *(len(str(r[k])) + 2 for r in [*rows, [str(c) for c in df.columns]]))
    book.save(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def image_files(variants: DataFrame) -> DataFrame:
    """(image, method, content): each variant as a portable bitmap, to be written by any sink."""
    from ..operators.images import decoded
    from .bitmaps import encode

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"image": rows["image"], "method": rows["method"], "content": [encode(decoded(v if isinstance(v, dict) else v.asDict())) for v in rows["variant"]]})

    return variants.mapInPandas(run, "image string, method string, content binary")
