"""Shared pieces of the operators: inputs, written intermediates, whitespace rules."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace that separates words everywhere in this subpackage.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="ledgerlens-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all runs on this machine
    (tests) it is a temporary one; on a cluster its absence is an error, as executors would write to folders of their own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_dir()


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: nothing is left to clean up with
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(table: DataFrame) -> None:
    """Deletes the files of a table made by written() that nothing will read again."""
    folder = table.inputFiles()
    if folder:
        _forget(table.sparkSession, folder[0].rsplit("/", 1)[0])


def swept(spark: SparkSession) -> None:
    """Asks the driver's JVM for a garbage collection: its heap shrinks, and Spark deletes shuffle files and broadcasts that
    no plan refers to any more."""
    spark.sparkContext._jvm.System.gc()


def whole(text: Column) -> Column:
    """The text, null as the empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def unblanked(text: Column) -> Column:
    """The text without any whitespace; six plain replacements are faster than one pattern."""
    out = whole(text)
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def parts_for(n_rows: int, rows_each: int, least: int = 1) -> int:
    return max(least, -(-n_rows // rows_each))
