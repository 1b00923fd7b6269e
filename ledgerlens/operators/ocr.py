"""The border to an OCR program: anything that turns an image into boxed words.

An engine is a function from an image array to (text, left, top, width, height, conf) tuples. One call per variant
gives geometry and confidence; all readings of it are columns. A failing engine gives a row without words.
"""

from __future__ import annotations

import shutil
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import BLANKS, char_count, word_count
from ..schemas import OCR_BOXES
from .confidence import mean_confidence
from .images import decoded

Engine = Callable[[np.ndarray], list[tuple[str, int, int, int, int, float]]]
COMMAND_CONF = "spark.ledgerlens.ocr.command"


def engine_command(spark: SparkSession) -> str | None:
    """The OCR program: what the session says, else tesseract on the path, else None."""
    return spark.conf.get(COMMAND_CONF, None) or shutil.which("tesseract")


def ocr_boxes(variants: DataFrame, engine: Engine) -> DataFrame:
    """(image, method, boxes, error) of variants (image, method, variant)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for v in rows["variant"]:
                try:
                    words = engine(decoded(v if isinstance(v, dict) else v.asDict()))
                    out.append(([dict(zip(("text", "left", "top", "width", "height", "conf"), w, strict=True)) for w in words], None))
                except Exception as e:  # a row's failure is kept in the row, and the batch goes on
                    out.append(([], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"image": rows["image"], "method": rows["method"], "boxes": [b for b, _ in out], "error": [e for _, e in out]})

    return variants.select("image", "method", "variant").mapInPandas(run, f"image string, method string, boxes {OCR_BOXES}, error string")


def usable_words(boxes: Column) -> Column:
    """Boxes as (text, confidence): trimmed, without empty ones and those of negative or no confidence."""
    words = F.transform(boxes, lambda b: F.struct(F.btrim(b["text"], F.lit(BLANKS)).alias("text"), F.coalesce(b["conf"], F.lit(-1.0)).alias("confidence")))
    return F.filter(words, lambda w: (w["text"] != "") & (w["confidence"] >= 0))


def box_words(boxes: Column) -> Column:
    """Boxes with trimmed text, without empty ones; negative confidences stay."""
    return F.filter(F.transform(boxes, lambda b: b.withField("text", F.btrim(b["text"], F.lit(BLANKS)))), lambda b: b["text"] != "")


def joined_text(words: Column) -> Column:
    """The words with one space between them; so there is no line end in it."""
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def lined_text(boxes: Column) -> Column:
    """The words of boxes, in their order, with a line end where one begins more than half its height off the line's first."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("top"))

    def add(line: Column, b: Column) -> Column:
        same = F.abs(b["top"] - line["top"]) * 2 <= b["height"]
        text = F.when(line["top"].isNull(), b["text"]).otherwise(F.concat(line["text"], F.when(same, " ").otherwise("\n"), b["text"]))
        return F.struct(text.alias("text"), F.when(same, line["top"]).otherwise(b["top"]).alias("top"))

    return F.aggregate(box_words(boxes), start, add)["text"]


def primary_text(plain: Column, words: Column) -> Column:
    """The engine's plain text, or where that is blank the words it boxed."""
    return F.when(F.btrim(F.coalesce(plain, F.lit("")), F.lit(BLANKS)) != "", plain).otherwise(joined_text(words))


def plain_texts(variants: DataFrame, engine: Callable[[np.ndarray], str]) -> DataFrame:
    """(image, method, text): what an engine of plain text says, line ends and all; nothing where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for v in rows["variant"]:
                try:
                    out.append(engine(decoded(v if isinstance(v, dict) else v.asDict())))
                except Exception:  # a picture that cannot be read has no text, and the batch goes on
                    out.append("")
            yield pd.DataFrame({"image": rows["image"], "method": rows["method"], "text": out})

    return variants.select("image", "method", "variant").mapInPandas(run, "image string, method string, text string")


def ocr_table(recognised: DataFrame) -> DataFrame:
    """(image, method, text, words, n_words, n_chars) from ocr_boxes."""
    words = usable_words(F.col("boxes"))
    out = recognised.select("image", "method", words.alias("words")).withColumn("text", joined_text(F.col("words")))
    return out.withColumns({"n_words": word_count(F.col("text")), "n_chars": char_count(F.col("text"))})


def word_rows(table: DataFrame) -> DataFrame:
    """(image, method, pos, text, confidence): a row for each word."""
    return table.select("image", "method", F.posexplode("words").alias("pos", "w")).select("image", "method", "pos", "w.text", "w.confidence")


def run_report(table: DataFrame) -> DataFrame:
    """By method: words, characters, confidence, as a run over the variants reports them."""
    conf = mean_confidence(word_rows(table), "image", "method")
    return table.join(conf, ["image", "method"], "left").select("image", "method", "n_words", "n_chars", F.coalesce("raw_or_zero", F.lit(0.0)).alias("confidence"))
