"""Kernels over stacks of images, and the query made of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import images
from ledgerlens.schemas import METHODS


def plain_denoise(gray, h=3.0, patch=7, search=21):
    """Patch by patch, without tables or running sums."""
    p, s = patch // 2, search // 2
    rows, cols = gray.shape
    wide = np.pad(gray.astype(np.float64), s + p, mode="reflect" if min(rows, cols) > s + p else "edge")
    out = np.zeros(gray.shape)
    for y in range(rows):
        for x in range(cols):
            own = wide[y + s : y + s + patch, x + s : x + s + patch]
            total = weights = 0.0
            for dy in range(search):
                for dx in range(search):
                    w = np.exp(-(((wide[y + dy : y + dy + patch, x + dx : x + dx + patch] - own) ** 2).sum() / patch**2) / h**2)
                    total, weights = total + w * wide[y + dy + p, x + dx + p], weights + w
            out[y, x] = total / weights
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("shape", [(3, 4), (15, 16)])
def test_denoised_against_the_plain_sums(shape):
    rng = np.random.default_rng(4)
    stack = np.stack([rng.integers(0, 256, shape), rng.integers(100, 112, shape)]).astype(np.uint8)
    assert np.array_equal(images.denoised(stack), np.stack([plain_denoise(g) for g in stack]))


@pytest.mark.parametrize("shape", [(8, 8, 3), (8, 8), (1, 9), (2, 5, 3), (30, 20)])
def test_stacks_are_worked_on_like_single_images(shape):
    stack = np.random.default_rng(5).integers(0, 256, (7, *shape)).astype(np.uint8)
    for method in METHODS:
        assert np.array_equal(images.STACKED[method](stack), np.stack([images.KERNELS[method](img) for img in stack]))


def test_variants_of_unlike_shapes(spark):
    rng = np.random.default_rng(6)
    made = {f"i{k}": rng.integers(0, 256, shape).astype(np.uint8) for k, shape in enumerate([(4, 5), (4, 5, 3), (4, 5), (1, 1), (20, 200, 3)] * 3)}
    df = spark.createDataFrame([(k, images.encoded(v)) for k, v in made.items()] + [("none", None)], f"image string, pixels {images.IMAGE}").coalesce(1)
    got = {(r.image, r.method): (r.method_id, r.variant.asDict()) for r in images.variants(df).collect()}
    assert len(got) == 7 * len(made) and all(got[k, m] == (i, images.encoded(images.KERNELS[m](v))) for k, v in made.items() for i, m in enumerate(METHODS))
    assert {r.method for r in images.variants(df, ["Gray", "Sharpen"]).select(F.col("method")).collect()} == {"Gray", "Sharpen"}
