"""Image kernels in numpy over decoded images, and the table of preprocessing methods.

An image is struct(height, width, channels, data): 8-bit, rows from the top, channels blue, green, red or one.
Kernels work on stacks of images of one shape; only the chosen methods' variants are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import IMAGE, METHODS

THRESHOLD, BLOCK, OFFSET = 150, 11, 2
#: Pixels of the images that are worked on at once.
STACK = 1 << 15


def to_gray(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 2 else grays(img[None])[0]


def grays(stack: np.ndarray) -> np.ndarray:
    if stack.ndim == 3:
        return stack
    b, g, r = (stack[..., k].astype(np.float64) for k in range(3))
    return np.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).astype(np.uint8)


def thresholds(stack: np.ndarray) -> np.ndarray:
    return np.where(grays(stack) > THRESHOLD, 255, 0).astype(np.uint8)


def _along(stack: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums along an axis; the border's value goes on outside."""
    half = len(kernel) // 2
    pad = [(0, 0)] * stack.ndim
    pad[axis] = (half, half)
    wide = np.pad(stack, pad, mode="edge")
    n = stack.shape[axis]
    return sum(w * _cut(wide, k, n, axis) for k, w in enumerate(kernel))


def _cut(stack: np.ndarray, at: int, n: int, axis: int) -> np.ndarray:
    return stack[(slice(None),) * axis + (slice(at, at + n),)]


def adaptive_thresholds(stack: np.ndarray) -> np.ndarray:
    """White where a pixel is above the Gaussian mean around it less OFFSET."""
    gray = grays(stack)
    sigma = 0.3 * ((BLOCK - 1) * 0.5 - 1) + 0.8
    x = np.arange(BLOCK) - BLOCK // 2
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    mean = np.floor(_along(_along(gray.astype(np.float64), kernel, 1), kernel, 2) + 0.5)
    return np.where(gray.astype(np.int64) > mean - OFFSET, 255, 0).astype(np.uint8)


def _weights(h: float, patch: int) -> np.ndarray:
    """The weight of each sum of squares over a patch, up to the first that is zero in a double."""
    most = min(255**2 * patch**2, int(746 * h**2 * patch**2) + 1)
    return np.exp(-(np.arange(most + 1) / patch**2) / h**2)


def _boxes(a: np.ndarray, size: int, axis: int) -> np.ndarray:
    """Sums of so many neighbours along an axis, put together from sums of 1, 2, 4, ..."""
    n, out, at, width = a.shape[axis] - size + 1, None, 0, 1
    while True:
        if size & width:
            out = _cut(a, at, n, axis) if out is None else out + _cut(a, at, n, axis)
            at += width
        if 2 * width > size:
            return out
        a = _cut(a, 0, a.shape[axis] - width, axis) + _cut(a, width, a.shape[axis] - width, axis)
        width *= 2


def denoised(stack: np.ndarray, h: float = 3.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means on gray: each pixel the mean of those around it, weighted by the likeness of their patches.

    Distances are whole numbers, so their weights are read off a table. Images are the last axis: even of small ones
    long rows lie together.
    """
    gray = grays(stack)
    p, s = patch // 2, search // 2
    _, rows, cols = gray.shape
    wide = np.pad(gray.transpose(1, 2, 0).astype(np.int32), ((s + p, s + p), (s + p, s + p), (0, 0)), mode="reflect" if min(rows, cols) > s + p else "edge")
    centre, values, table = wide[s : s + rows + 2 * p, s : s + cols + 2 * p], wide.astype(np.float64), _weights(h, patch)
    total, weights = np.zeros((rows, cols, len(gray))), np.zeros((rows, cols, len(gray)))
    for dy in range(search):
        for dx in range(search):
            apart = wide[dy : dy + rows + 2 * p, dx : dx + cols + 2 * p] - centre
            w = table.take(_boxes(_boxes(apart * apart, patch, 0), patch, 1), mode="clip")
            weights += w
            w *= values[dy + p : dy + p + rows, dx + p : dx + p + cols]
            total += w
    return np.ascontiguousarray(np.clip(np.floor(total / weights + 0.5), 0, 255).astype(np.uint8).transpose(2, 0, 1))


def resized(stack: np.ndarray) -> np.ndarray:
    """Twice as large both ways, bilinear."""

    def double(a: np.ndarray, axis: int) -> np.ndarray:
        n = a.shape[axis]
        at = np.clip((np.arange(2 * n) + 0.5) / 2 - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
        return np.take(a, low, axis) * (1 - part) + np.take(a, np.minimum(low + 1, n - 1), axis) * part

    return np.clip(np.floor(double(double(stack.astype(np.float64), 1), 2) + 0.5), 0, 255).astype(np.uint8)


def sharpened(stack: np.ndarray) -> np.ndarray:
    """Five times a pixel less its four neighbours; the border mirrors."""
    a = stack.astype(np.int64)
    pad = [(0, 0), (1, 1), (1, 1)] + [(0, 0)] * (a.ndim - 3)
    wide = np.pad(a, pad, mode="reflect" if min(a.shape[1:3]) > 1 else "edge")
    return np.clip(5 * a - wide[:, :-2, 1:-1] - wide[:, 2:, 1:-1] - wide[:, 1:-1, :-2] - wide[:, 1:-1, 2:], 0, 255).astype(np.uint8)


def _single(kernel: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
    return lambda img, *args, **kwargs: kernel(img[None], *args, **kwargs)[0]


#: Of each method the kernel over a stack of images of one shape, and that over one image.
STACKED = dict(zip(METHODS, [lambda stack: stack, grays, thresholds, adaptive_thresholds, denoised, resized, sharpened], strict=True))
KERNELS = {m: _single(k) for m, k in STACKED.items()}
threshold, adaptive_threshold, denoise, resize, sharpen = (KERNELS[m] for m in METHODS[2:])


def decoded(row: dict) -> np.ndarray:
    shape = (row["height"], row["width"], row["channels"]) if row["channels"] > 1 else (row["height"], row["width"])
    return np.frombuffer(row["data"], np.uint8).reshape(shape)


def encoded(img: np.ndarray) -> dict:
    return {"height": img.shape[0], "width": img.shape[1], "channels": img.shape[2] if img.ndim == 3 else 1, "data": np.ascontiguousarray(img).tobytes()}


def methods(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("method_id"), F.lit(m).alias("method")) for k, m in enumerate(METHODS)])))


def _shapes(pixels: pa.StructArray) -> list[tuple[int, int, int, np.ndarray]]:
    """(height, width, channels, numbers of the rows that have them)."""
    shape = np.stack([pixels.field(k).to_numpy(zero_copy_only=False) for k in ("height", "width", "channels")], axis=1)
    return [(*map(int, one), np.flatnonzero((shape == one).all(axis=1))) for one in np.unique(shape, axis=0)]


def _variants(chosen: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = batch.column("pixels")
            for height, width, channels, rows in _shapes(pixels):
                each = max(1, STACK // max(1, height * width))
                for at in range(0, len(rows), each):
                    now = pa.array(rows[at : at + each])
                    data = b"".join(pixels.field("data").take(now).to_pylist())
                    stack = np.frombuffer(data, np.uint8).reshape((len(now), height, width, channels) if channels > 1 else (len(now), height, width))
                    names = batch.column("image").take(now)
                    for method in chosen:
                        yield _made(names, method, STACKED[method](stack))

    return run


def _made(names: pa.Array, method: str, stack: np.ndarray) -> pa.RecordBatch:
    n, number = len(names), lambda x, kind=pa.int32(): pa.array(np.full(len(names), x), kind)
    flat, size = np.ascontiguousarray(stack).tobytes(), stack[0].size
    data = pa.array([flat[k : k + size] for k in range(0, n * size, size)] if size else [b""] * n, pa.binary())
    variant = pa.StructArray.from_arrays([number(stack.shape[1]), number(stack.shape[2]), number(stack.shape[3] if stack.ndim == 4 else 1), data], ["height", "width", "channels", "data"])
    return pa.RecordBatch.from_arrays([names, number(METHODS.index(method)), pa.array([method] * n), variant], ["image", "method_id", "method", "variant"])


def variants(images: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """(image, method_id, method, variant) of images (image, pixels); null pixels have no variants.

    Images of one shape are worked on in stacks of up to STACK pixels, a larger one alone.
    """
    todo = images.filter("pixels is not null").select("image", F.col("pixels").cast(IMAGE).alias("pixels"))
    return todo.mapInArrow(_variants([m for m in METHODS if chosen is None or m in chosen]), f"image string, method_id int, method string, variant {IMAGE}")
