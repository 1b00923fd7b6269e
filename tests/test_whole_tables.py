"""Queries handle every row of their tables."""

import numpy as np

from ledgerlens.operators import images
from ledgerlens.plans import queries


def test_all_parts_have_their_variants(spark, tmp_path):
    spark.range(195, 215).selectExpr("id as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = queries.QUERIES["image_variants"](spark, str(tmp_path)).collect()
    assert {r.image for r in got} == {f"part_{k}" for k in range(195, 215)} and len(got) == 20 * 7


def test_stacks_are_denoised_like_single_images():
    rng = np.random.default_rng(3)
    for shape in [(8, 8), (30, 17), (1, 5)]:
        stack = rng.integers(0, 256, (5, *shape), np.uint8)
        assert np.array_equal(images.denoised(stack), np.stack([images.denoise(g) for g in stack]))


def test_every_reading_has_a_ratio(spark, sf):
    got = queries.QUERIES["fuzzy_ratio"](spark, sf)
    every = queries.readings(spark, sf)
    assert got.count() == every.count()
    joined = got.join(every, ["image", "method", "field"])
    assert joined.filter("predicted = actual and ratio != 1").isEmpty() and not joined.filter("predicted != actual and ratio < 1").isEmpty()
