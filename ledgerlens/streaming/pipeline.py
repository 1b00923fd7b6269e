"""The batch operators on streams: an extension, built of the same columns.

Routing is stateless; the running figures are windowed by a watermark, so state is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.extract import extract_fields
from ..operators.kpi import batch_kpis
from ..operators.review import review_status


def read_texts(spark: SparkSession, path: str, schema: str = "image string, text string, confidence double, at timestamp") -> DataFrame:
    """OCR texts that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def routed(texts: DataFrame) -> DataFrame:
    """texts (image, text, confidence, at) with their fields and where they go."""
    fields = extract_fields(F.col("text"))
    out = texts.withColumns(fields)
    r = review_status({k: F.col(f"`{k}`") for k in fields}, F.col("confidence"))
    return out.withColumns({"Validation Status": r["status"], "Review Reason": r["reason"]})


def running_kpis(routed_texts: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Figures by window of at; rows later than late are left out."""
    status = F.col("`Validation Status`")
    review = F.when(status == "MANUAL REVIEW", "YES").otherwise("NO")
    figures = batch_kpis(status, review, F.lit(0.0))[:-1]
    return routed_texts.withWatermark("at", late).groupBy(F.window("at", window)).agg(*figures)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there, writes Parquet, and ends; a restart goes on where it ended."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
