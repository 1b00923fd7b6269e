"""Exact dedup: a two-pass Bloom filter finds possibly repeated hashes; only those rows shuffle.

Pass one sets, for each row's hash, a few bits of a filter that counts to two. A bit that two rows set says
"possibly repeated"; a repeated text has all its bits so marked. Pass two tests every row against the filter:
rows with an unmarked bit are certainly alone and go straight through; the rest are grouped by their SHA-256.

The filter has a fixed largest size (max_filter_bits), so what is broadcast is bounded whatever the input's
size. A fuller filter only lets more lone rows take the shuffled way; it never changes the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unblanked, whole, written

BITS_PER_ROW = 16
PROBES = 4
CHUNK_BITS = 1 << 16
#: A task sets its bits for bits / ROWS_SHARE rows, and BRANCHES groups of tasks are merged first.
ROWS_SHARE, BRANCHES = 512, 64
PART = "chunk int, once binary, twice binary"


def _probes(digests: pa.Array, bits: int) -> np.ndarray:
    """PROBES bit positions for each 32-byte digest, as rows of an array."""
    raw = b"".join(digests.to_pylist())
    words = np.frombuffer(raw, dtype="<u8").reshape(-1, 4)
    return (words & np.uint64(bits - 1)).astype(np.int64)


def _fold(counts: np.ndarray, positions: np.ndarray) -> None:
    """Counts to two; a row that sets one bit twice counts twice, which only errs towards 'possibly repeated'."""
    at, n = np.unique(positions, return_counts=True)
    counts[at] = np.minimum(counts[at] + np.minimum(n, 2), 2)


def _filter_parts(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            if batch.num_rows:
                counts = np.zeros(bits, np.uint8) if counts is None else counts
                _fold(counts, _probes(batch.column("digest"), bits).ravel())
        if counts is None:
            return
        for k, part in enumerate(counts.reshape(-1, min(bits, CHUNK_BITS))):
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "once": [np.packbits(part >= 1).tobytes()], "twice": [np.packbits(part >= 2).tobytes()]})

    return run


def _merge_parts(table: pa.Table) -> pa.Table:
    once = twice = None
    for a, b in zip(table.column("once"), table.column("twice"), strict=True):
        a, b = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return pa.table({"chunk": table.column("chunk")[:1].combine_chunks(), "once": pa.array([once.tobytes()], pa.binary()), "twice": pa.array([twice.tobytes()], pa.binary())})


def _merge_branch(table: pa.Table) -> pa.Table:
    return _merge_parts(table.drop_columns("branch"))


def _marked(bits: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for batch in batches:
            at = _probes(batch.column("digest"), bits)
            hit = (((twice[at >> 3] >> (7 - (at & 7))) & 1) == 1).all(axis=1)
            yield batch.append_column("maybe", pa.array(hit))

    return run


def repeated_marks(narrow: DataFrame, n: int, max_filter_bits: int = 1 << 27) -> DataFrame:
    """narrow (with a 32-byte column digest) and a boolean column maybe, false only for digests that occur once."""
    spark = narrow.sparkSession
    bits = min(max_filter_bits, 1 << max(10, (BITS_PER_ROW * max(n, 1) - 1).bit_length()))
    # parts follow the rows, not the input's partitions, so that what is merged does; it is merged in two levels
    parts = narrow.select("digest").coalesce(max(1, n * ROWS_SHARE // bits)).mapInArrow(_filter_parts(bits), PART)
    branches = parts.withColumn("branch", F.spark_partition_id() % BRANCHES).groupBy("branch", "chunk").applyInArrow(_merge_branch, PART)
    merged = branches.groupBy("chunk").applyInArrow(_merge_parts, PART).select("chunk", "twice")
    twice = np.zeros(bits // 8, np.uint8)
    each = min(bits, CHUNK_BITS) // 8
    for row in merged.toLocalIterator():  # bits / 8 bytes at most
        twice[row.chunk * each : (row.chunk + 1) * each] = np.frombuffer(row.twice, np.uint8)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema) + ", maybe boolean"
    return narrow.mapInArrow(_marked(bits, spark.sparkContext.broadcast(twice)), schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = 1 << 27) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting whitespace. The row with the most code points in its original
    text stays, then the smallest doc_id (null last); of rows alike in both, one. Null text counts as empty; all
    empty texts are one group. An empty table gives an empty result. Other columns are not read.
    """
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(whole(F.col(text_col))).cast("long").alias("n_points"),
        F.unhex(F.sha2(unblanked(F.col(text_col)).cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    narrow = written(narrow, "exact-narrow")  # fixes row, and spares hashing the texts again
    marked = written(repeated_marks(narrow, narrow.count(), max_filter_bits), "exact-marked")
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    alone = marked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    maybe = marked.filter("maybe").select("doc_id", "n_points", "digest", "row")
    # the complement reverses the order of ids without overflow, and null is the least
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("c"), F.bitwise_not("row").alias("r")))
    groups = maybe.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = written(groups, "exact-groups")  # apart from the join, which can then split a hot group's rows
    grouped = maybe.join(groups, "digest").select(
        "doc_id", F.bitwise_not("best.c").alias("keep_id"), "group_size", (F.col("row") == F.bitwise_not("best.r")).alias("kept"), sha
    )
    return alone.unionByName(grouped)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return exact_dedup(documents(spark, sf_dir))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id ASC NULLS LAST)
"""
