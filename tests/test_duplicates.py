"""Thumbnails, hashes and confirmed duplicates against plain versions."""

import math
import time

import numpy as np
import pytest
from boxlake.operators import dedup, pixels
from pyspark.sql import functions as F


def plain_resize(a, height, width):
    """Windowed sinc, one pixel after the other."""

    def line(v, size):
        n, out = len(v), []
        scale = n / size
        wide = max(scale, 1.0)
        for j in range(size):
            centre = (j + 0.5) * scale
            total = weight = 0.0
            for i in range(n):
                t = (i + 0.5 - centre) / wide
                if abs(t) < 3:
                    w = 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t / 3)
                    total, weight = total + w * v[i], weight + w
            out.append(min(255.0, max(0.0, math.floor(round(total / weight, 6) + 0.5))))
        return out

    rows = np.array([line(r, width) for r in a])
    return np.array([line(c, height) for c in rows.T]).T


@pytest.mark.parametrize(("height", "width"), [(48, 64), (20, 90), (32, 32), (7, 5), (100, 33)])
def test_hash_of_unlike_sizes(height, width):
    a = np.random.default_rng(height).integers(0, 256, (height, width)).astype(float)
    small = plain_resize(a, 32, 32)
    assert (pixels.resized(a, 32, 32) == small).all()
    n = np.arange(32)
    basis = np.cos(np.pi * np.outer(n, 2 * n + 1) / 64) * np.sqrt(2 / 32)
    basis[0] /= np.sqrt(2)
    low = [sum(basis[u, i] * basis[v, j] * small[i, j] for i in range(32) for j in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    bits = "".join("1" if x >= middle - 1e-9 else "0" for x in low)
    assert f"{pixels.perceptual_hash(a) % 2**64:064b}" == bits


def test_ssim_matches_windows():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 256, (14, 17)).astype(float), r.integers(0, 256, (14, 17)).astype(float)

    def mean(x):
        return np.lib.stride_tricks.sliding_window_view(np.pad(x, 5, mode="reflect"), (11, 11)).mean((-2, -1))

    va, vb, cov = mean(a * a) - mean(a) ** 2, mean(b * b) - mean(b) ** 2, mean(a * b) - mean(a) * mean(b)
    c1, c2 = 6.5025, 58.5225
    want = ((2 * mean(a) * mean(b) + c1) * (2 * cov + c2) / ((mean(a) ** 2 + mean(b) ** 2 + c1) * (va + vb + c2))).mean()
    assert pixels.ssim(a, b) == pytest.approx(want) and pixels.ssim(a, a) == pytest.approx(1.0)


def test_regions():
    a = np.arange(200.0).reshape(10, 20)
    assert pixels.region(a, 0.5, 0.5, 0.5, 0.5).shape == (6, 14)  # 0.7 of each side; 1.5 and 8.5 round to even
    assert pixels.region(a, 0.0, 0.0, 0.5, 0.5).shape == (4, 7)
    assert pixels.region(a, 2.0, 0.5, 0.2, 0.2) is None


COLUMNS = "item_id long, class_id int, height int, width int, channels int, pixels binary, cx double, cy double, w double, h double"


def test_confirmed_duplicates(spark):
    r = np.random.default_rng(5)
    smooth = lambda: plain_resize(r.integers(30, 220, (6, 8)).astype(float), 24, 30)
    one, two, three = smooth(), smooth(), smooth()
    sharp = np.clip(one + r.integers(-2, 3, one.shape), 0, 255)
    rows = [(1, 0, one), (2, 0, one), (3, 0, one), (4, 0, sharp), (5, 1, one), (6, 0, two), (7, 0, three), (8, 0, three), (9, 0, 255 - two)]
    df = spark.createDataFrame([(i, c, 24, 30, 1, a.astype(np.uint8).tobytes(), 0.5, 0.5, 0.4, 0.4) for i, c, a in rows], COLUMNS)
    t = pixels.thumbnails(df, 16).join(df.select("item_id", "class_id"), "item_id").withColumns({"x1": F.lit(0.3), "y1": F.lit(0.3), "x2": F.lit(0.7), "y2": F.lit(0.7), "quality": dedup.quality(F.col("sharpness"), F.col("brightness"), F.col("overexposed"), F.col("underexposed"))})
    got = {x.item_id: x for x in dedup.confirmed_duplicates(t, 9, 16).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7, 8}  # 6 and 9 resemble nothing
    assert {i: x.cluster_id for i, x in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7}
    assert [i for i, x in sorted(got.items()) if x.kept] == [4, 5, 7]
    assert {i: x.represented_by for i, x in got.items()} == {1: 4, 2: 4, 3: 4, 4: 4, 5: 5, 7: 7, 8: 7}


def test_copies_give_no_pairs(spark):
    """5,000 equal images: one class, no pair, one stays."""
    t = spark.range(5000).select(F.col("id").alias("item_id"), F.lit(0).cast("long").alias("phash"), F.lit(bytes(256)).alias("whole"), F.lit(bytes(256)).alias("part"), F.lit(0).alias("class_id"), *(F.lit(float(v)).alias(c) for c, v in (("x1", 0), ("y1", 0), ("x2", 1), ("y2", 1))), F.lit(1.0).alias("quality"))
    out = dedup.confirmed_duplicates(t, 9, 16)
    assert out.count() == 5000 and [r.item_id for r in out.where("kept").collect()] == [0]
    classes = dedup.content_classes(t, ["whole", "part", "class_id"]).where("item_id = first_id")
    assert dedup.scored_pairs(classes, 9, 16).count() == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bands_are_not_broadcast(spark):
    """Exploded bands are dozens of times the size that Spark takes them for: they stay off the driver."""
    items = spark.range(500).select(F.col("id").alias("item_id"), F.xxhash64("id").alias("hash"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"))
    made = dedup.written(items)
    for df in (dedup.hamming_pairs(made, 9), dedup.linking_edges(made, 9), dedup.pair_counts(made, 9)):
        assert "BroadcastExchange" not in _plan(df)


def test_clusters_do_not_broadcast_members(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    labels = dedup.written(dedup.components(edges))
    assert sorted(map(tuple, labels.collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    of_members = dedup.clusters(dedup.written(labels.withColumn("split", F.when(F.col("node") % 2 == 0, "val").otherwise("train"))))
    assert "SortMergeJoin [label" in _plan(of_members)


def test_stacks_give_what_single_images_give():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (300, 16, 16)).astype(np.uint8)
    b = np.clip(a + rng.integers(-30, 30, a.shape), 0, 255).astype(np.uint8)
    b[0], a[1], b[1] = a[0], 0, 255
    one_by_one = lambda: [pixels.ssim(p.astype(float), q.astype(float)) for p, q in zip(a, b, strict=True)]
    began = time.perf_counter()
    want = one_by_one()
    middle = time.perf_counter()
    got = pixels.ssims(a, b)
    assert time.perf_counter() - middle < (middle - began) / 3
    assert got == pytest.approx(want, abs=1e-12)
    stack = rng.integers(0, 256, (20, 12, 18)).astype(float)
    assert pixels.perceptual_hashes(stack).tolist() == [pixels.perceptual_hash(x) for x in stack]
    assert pixels.laplacian_variances(stack) == pytest.approx([pixels.laplacian_variance(x) for x in stack])


def test_thumbnails_of_unlike_sizes_keep_their_order(spark):
    rng = np.random.default_rng(6)
    sizes = [(12, 16), (9, 7), (12, 16), (2, 2), (9, 7)]
    raw = [rng.integers(0, 256, s).astype(np.uint8) for s in sizes]
    rows = [(i, h, w, 1, 2.0 if i == 2 else 0.5, 0.5, 0.5, 0.5, bytearray(a.tobytes())) for i, ((h, w), a) in enumerate(zip(sizes, raw, strict=True))]
    images = spark.createDataFrame(rows, "item_id long, height int, width int, channels int, cx double, cy double, w double, h double, pixels binary").coalesce(1)
    got = {r.item_id: r for r in pixels.thumbnails(images, 16).collect()}
    for i, a in enumerate(raw):
        assert bytes(got[i].whole) == pixels.fitted(a.astype(float), 16).astype(np.uint8).tobytes() and got[i].phash == pixels.perceptual_hash(a.astype(float))
        assert (got[i].part is None) == (i == 2)
        assert i == 2 or bytes(got[i].part) == pixels.fitted(pixels.region(a.astype(float), 0.5, 0.5, 0.5, 0.5), 16).astype(np.uint8).tobytes()
