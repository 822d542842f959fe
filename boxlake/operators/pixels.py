"""Pixel measures as Arrow-batched Pandas functions: hashes, sharpness, similarity, thumbnails.

A row is one decoded image; Spark partitions the work, NumPy does the arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.operators.recurrence import butterworth, lowpass_series, smooth_series  # noqa: F401  (their earlier place)


def gray(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luminance of a BGR or gray image."""
    a = np.frombuffer(pixels, np.uint8).reshape(height, width, channels).astype(np.float64)
    return a[..., 0] if channels == 1 else a[..., 2] * 0.299 + a[..., 1] * 0.587 + a[..., 0] * 0.114


@lru_cache(4096)
def lanczos(n: int, size: int, start: float, span: float) -> np.ndarray:
    """size x n weights that bring the stretch of span pixels from start on to size pixels: windowed sinc, three lobes, wider when it shrinks."""
    centre = start + (np.arange(size) + 0.5) * span / size
    t = (np.arange(n)[None] + 0.5 - centre[:, None]) / max(span / size, 1.0)
    w = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def levels(a: np.ndarray) -> np.ndarray:
    """Whole grey levels; halves go up, noise in the last places doesn't decide."""
    return np.clip(np.floor(np.round(a, 6) + 0.5), 0, 255)


def resized(a: np.ndarray, height: int, width: int, box: tuple[float, float, float, float] | None = None) -> np.ndarray:
    """The part (left, top, width, height) of an image or of a stack of images of one size, by default all, at another size: rows first, then columns, whole levels after each."""
    left, top, w, h = box or (0.0, 0.0, a.shape[-1], a.shape[-2])
    wide = levels(a @ lanczos(a.shape[-1], width, left, w).T)
    return levels(lanczos(a.shape[-2], height, top, h) @ wide)


def fitted(a: np.ndarray, size: int) -> np.ndarray:
    """The middle square of an image, or of each of a stack, at size x size."""
    h, w = a.shape[-2:]
    side = min(h, w)
    return resized(a, size, size, ((w - side) / 2, (h - side) / 2, side, side))


def region(a: np.ndarray, cx: float, cy: float, w: float, h: float, expand: float = 0.2) -> np.ndarray | None:
    """The part of an image under a box (shares of the image), a fifth wider on each side, inside the image; None if nothing is left."""
    height, width = a.shape
    w, h = w * (1 + 2 * expand), h * (1 + 2 * expand)
    left, right = max(0, round((cx - w / 2) * width)), min(width, round((cx + w / 2) * width))
    top, bottom = max(0, round((cy - h / 2) * height)), min(height, round((cy + h / 2) * height))
    return a[top:bottom, left:right] if right > left and bottom > top else None


@lru_cache(1)
def low_frequencies() -> np.ndarray:
    """The first eight rows of the orthonormal DCT-II of 32 values."""
    n = np.arange(32)
    basis = np.cos(np.pi * np.outer(n[:8], 2 * n + 1) / 64) * np.sqrt(2 / 32)
    basis[0] /= np.sqrt(2)
    return basis


def perceptual_hashes(stack: np.ndarray) -> np.ndarray:
    """64 bits for each image of a stack: low DCT-II frequencies of the 32 x 32 image against the median of all but the mean, as signed longs."""
    basis = low_frequencies()
    low = (basis @ resized(stack, 32, 32) @ basis.T).reshape(len(stack), 64)
    bits = np.packbits(low >= np.median(low[:, 1:], axis=1, keepdims=True), axis=1)
    return bits.view(">i8").astype(np.int64)[:, 0]


def perceptual_hash(a: np.ndarray) -> int:
    """The hash of one image."""
    return int(perceptual_hashes(a[None])[0])


def laplacian_variances(a: np.ndarray) -> np.ndarray:
    """Variance of the four-neighbour Laplacian inside each image of a stack; 0 below three pixels."""
    if min(a.shape[1:]) < 3:
        return np.zeros(len(a))
    return (a[:, :-2, 1:-1] + a[:, 2:, 1:-1] + a[:, 1:-1, :-2] + a[:, 1:-1, 2:] - 4 * a[:, 1:-1, 1:-1]).var(axis=(1, 2))


def laplacian_variance(a: np.ndarray) -> float:
    """The same of one image."""
    return float(laplacian_variances(a[None])[0])


def of_one_shape(shapes: list[tuple], images: list[np.ndarray], make: Callable[[tuple, np.ndarray], dict[str, np.ndarray]], pixels_at_once: int = 1 << 22) -> dict[str, list]:
    """Values for all images, in their order: make gets a shape, which says the size of its images, and a stack of these."""
    by: dict[tuple, list[int]] = {}
    for i, shape in enumerate(shapes):
        by.setdefault(shape, []).append(i)
    out: dict[str, list] = {}
    for shape, at in by.items():
        step = max(1, pixels_at_once // max(1, images[at[0]].size))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            for name, values in make(shape, np.stack([images[i] for i in some])).items():
                column = out.setdefault(name, [None] * len(images))
                for i, v in zip(some, values, strict=True):
                    column[i] = v
    return out


def exposure(stack: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, shares of bright and dark pixels and sharpness of each image of a stack."""
    axes = (1, 2)
    return {"brightness": stack.mean(axes), "overexposed": (stack >= 245).mean(axes), "underexposed": (stack <= 10).mean(axes), "sharpness": laplacian_variances(stack)}


def box_means(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the square around every pixel, borders mirrored: four corners of the summed area."""
    side = 2 * radius + 1
    total = np.pad(np.pad(a, radius, mode="reflect"), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (total[side:, side:] - total[:-side, side:] - total[side:, :-side] + total[:-side, :-side]) / side**2


def ssim(a: np.ndarray, b: np.ndarray, radius: int = 5) -> float:
    """Mean structural similarity with a uniform window and mirrored borders; sides must be longer than radius."""
    ma, mb, maa, mbb, mab = (box_means(x, radius) for x in (a, b, a * a, b * b, a * b))
    va, vb, cov = np.maximum(0, maa - ma * ma), np.maximum(0, mbb - mb * mb), mab - ma * mb
    k1, k2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float(((2 * ma * mb + k1) * (2 * cov + k2) / ((ma * ma + mb * mb + k1) * (va + vb + k2))).mean())


@lru_cache(64)
def mirrored_window(n: int, radius: int) -> np.ndarray:
    """n x n: how often the window around each place, borders mirrored, takes each value."""
    taken = np.pad(np.arange(n), radius, mode="reflect")
    return np.stack([np.bincount(taken[i : i + 2 * radius + 1], minlength=n) for i in range(n)]).astype(float)


def ssims(a: np.ndarray, b: np.ndarray, radius: int = 5) -> np.ndarray:
    """ssim of each pair of two stacks of bytes: the sums of all windows are two products of matrices, of whole numbers and so exact."""
    many, height, width = a.shape
    side = 2 * radius + 1
    exact = np.float32 if (255 * side) ** 2 < 1 << 24 else np.float64  # all sums are whole numbers below 2 ** 24
    rows, columns = mirrored_window(height, radius).astype(exact), mirrored_window(width, radius).astype(exact)
    a, b = a.astype(exact), b.astype(exact)

    def means(x: np.ndarray) -> np.ndarray:
        across = (x.reshape(many * height, width) @ columns.T).reshape(many, height, width)
        down = np.ascontiguousarray(across.transpose(0, 2, 1)).reshape(many * width, height) @ rows.T
        return down.reshape(many, width * height).astype(np.float64) / side**2

    ma, mb, maa, mbb, mab = (means(x) for x in (a, b, a * a, b * b, a * b))
    k1, k2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    square, product = ma * ma + mb * mb, ma * mb
    spread = np.maximum(0, maa - ma * ma) + np.maximum(0, mbb - mb * mb)
    return ((2 * product + k1) * (2 * (mab - product) + k2) / ((square + k1) * (spread + k2))).mean(1)


def run_lengths(mask: np.ndarray) -> list[int]:
    """Column-major run lengths of a mask, beginning with the zeros."""
    flat = np.concatenate(([0], mask.astype(bool).ravel(order="F"), [0 if not mask.size else 1 - int(mask.ravel(order="F")[-1])]))
    edge = np.flatnonzero(np.diff(flat))
    ends = np.append(edge[edge < mask.size], mask.size)
    return np.diff(np.concatenate(([0], ends))).tolist()


def rasterise(points: list[tuple[float, float]], height: int, width: int) -> np.ndarray:
    """Mask of the pixels whose centres a polygon holds (even-odd rule)."""
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    inside = np.zeros((height, width), bool)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def image_measures(images: DataFrame) -> DataFrame:
    """path with mean, std, shares of bright and dark pixels, sharpness and hash of images(path, height, width, channels, pixels)."""

    def all_of(_: tuple, stack: np.ndarray) -> dict[str, np.ndarray]:
        return exposure(stack) | {"contrast": stack.std((1, 2)), "phash": perceptual_hashes(stack)}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            grays = [gray(*r) for r in zip(b["pixels"], b["height"], b["width"], b["channels"], strict=True)]
            out = of_one_shape([g.shape for g in grays], grays, all_of)
            yield pd.DataFrame({"path": b["path"]} | {c: out.get(c, []) for c in ("brightness", "contrast", "overexposed", "underexposed", "sharpness", "phash")})

    return images.select("path", "height", "width", "channels", "pixels").mapInPandas(measure, "path string, brightness double, contrast double, overexposed double, underexposed double, sharpness double, phash long")


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """item_id, box_id, height, width, pixels: the part of images(item_id, height, width, channels, pixels) under boxes(item_id, box_id, x1, y1, x2, y2), whole pixels from x1, y1 up to but without x2, y2.

    Corners outside the image are drawn in; a box without pixels gives no row.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                a = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, r.channels)[max(0, r.y1) : max(0, r.y2), max(0, r.x1) : max(0, r.x2)]
                if a.size:
                    rows.append((r.item_id, r.box_id, a.shape[0], a.shape[1], a.tobytes()))
            yield pd.DataFrame(rows, columns=["item_id", "box_id", "height", "width", "pixels"])

    both = images.select("item_id", "height", "width", "channels", "pixels").join(boxes.select("item_id", "box_id", *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2"))), "item_id")
    return both.mapInPandas(cut, "item_id long, box_id long, height int, width int, pixels binary")


def ssim_column(size: int):
    """A column function over two binary columns that hold size x size grey bytes; null if one is null."""
    step = max(1, (1 << 18) // size**2)  # pixels of a stack at once

    def stack(x: pa.Array) -> np.ndarray:
        values = b"".join(x.to_pylist())
        if len(values) != len(x) * size * size:
            raise ValueError(f"a thumbnail is not {size} x {size}")
        return np.frombuffer(values, np.uint8).reshape(-1, size, size)

    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        both = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
        out, at = np.zeros(len(a)), np.flatnonzero(both)
        for k in range(0, len(at), step):
            some = at[k : k + step]
            out[some] = ssims(stack(a.take(pa.array(some))), stack(b.take(pa.array(some))))
        return pa.array(out, mask=~both)

    return score


def thumbnails(images: DataFrame, size: int = 16, expand: float = 0.2) -> DataFrame:
    """item_id, phash, whole, part, brightness, overexposed, underexposed, sharpness of images(item_id, height, width, channels, pixels, cx, cy, w, h).

    whole and part are size x size grey bytes, of the image and of the region
    under its box (null if that is empty); the measures are those of whole.
    Images of one size are made at once, and so are regions.
    """

    def as_bytes(stack: np.ndarray) -> list[bytes]:
        return [x.tobytes() for x in stack.astype(np.uint8)]

    def of_whole(_: tuple, stack: np.ndarray) -> dict[str, np.ndarray]:
        whole = fitted(stack, size)
        return exposure(whole) | {"whole": as_bytes(whole), "phash": perceptual_hashes(stack)}

    def of_part(_: tuple, stack: np.ndarray) -> dict[str, np.ndarray]:
        return {"part": as_bytes(fitted(stack, size))}

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            grays = [gray(*r) for r in zip(b["pixels"], b["height"], b["width"], b["channels"], strict=True)]
            regions = [region(*r, expand) for r in zip(grays, b["cx"], b["cy"], b["w"], b["h"], strict=True)]
            cuts = [(i, c) for i, c in enumerate(regions) if c is not None]
            out = of_one_shape([g.shape for g in grays], grays, of_whole)
            made = of_one_shape([c.shape for _, c in cuts], [c for _, c in cuts], of_part).get("part", [])
            parts = dict(zip((i for i, _ in cuts), made, strict=True))
            yield pd.DataFrame({"item_id": b["item_id"], "part": [parts.get(i) for i in range(len(b))]} | {c: out.get(c, []) for c in ("phash", "whole", "brightness", "overexposed", "underexposed", "sharpness")})

    columns = "item_id", "height", "width", "channels", "pixels", "cx", "cy", "w", "h"
    return images.select(*columns).mapInPandas(make, "item_id long, phash long, whole binary, part binary, brightness double, overexposed double, underexposed double, sharpness double")


def channel_histogram(images: DataFrame) -> DataFrame:
    """channel, value, n over all pixels: each batch sends 256 counts per channel."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total: dict[int, np.ndarray] = {}
            for r in b.itertuples():
                a = np.frombuffer(r.pixels, np.uint8).reshape(-1, r.channels)
                for c in range(r.channels):
                    total[c] = total.get(c, np.zeros(256, np.int64)) + np.bincount(a[:, c], minlength=256)
            for c, n in total.items():
                yield pd.DataFrame({"channel": c, "value": np.arange(256), "n": n})

    return images.select("channels", "pixels").mapInPandas(count, "channel int, value int, n long").groupBy("channel", "value").agg(F.sum("n").alias("n"))


def predicted(images: DataFrame, predict, schema: str) -> DataFrame:
    """The seam for a model: predict takes a pandas batch and gives rows of schema; it is built once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield predict(b)

    return images.mapInPandas(run, schema)
