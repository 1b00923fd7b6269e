"""Equal rows numbered in blocks, and Bloom filters merged in branches: the same as at once."""

from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import exact_dedup, mixing


def test_blocks_number_as_one_array_does(spark, monkeypatch):
    counted = spark.createDataFrame([(1, "a", 25), (None, None, 10), (2, "b", 1), (3, "c", 11)], "doc_id long, source string, count long")
    want = Counter((i, s, k) for i, s, n in [(1, "a", 25), (None, None, 10), (2, "b", 1), (3, "c", 11)] for k in range(1, n + 1))
    for block in (10, 11, 1 << 16):
        monkeypatch.setattr(mixing, "BLOCK", block)
        assert Counter((r.doc_id, r.source, r.rep) for r in mixing._numbered(counted).collect()) == want


def test_branches(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_SHARE", 1 << 20)
    monkeypatch.setattr(exact_dedup, "BRANCHES", 3)
    hashed = spark.range(3000).repartition(8).select(F.sha2((F.col("id") % 2900).cast("string").cast("binary"), 256).alias("h"))
    marked = exact_dedup.repeated_marks(hashed.select(F.unhex("h").alias("digest")), 3000)
    twice = {bytes(r.digest) for r in marked.filter("maybe").collect()}
    want = {bytes(r.digest) for r in marked.groupBy("digest").count().filter("count > 1").collect()}
    assert len(want) == 100 and want <= twice and len(twice) < 200
