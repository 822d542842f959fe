"""Packed masks against plain pixel arrays."""

import numpy as np
import pytest
from boxlake.operators import evaluate, masks
from pyspark.sql import functions as F


def plain_fill(points, height, width):
    x, y = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    inside = np.zeros((height, width), bool)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        if y1 != y2:
            inside ^= ((y1 > y) != (y2 > y)) & (x >= (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


@pytest.mark.parametrize("width", [5, 63, 64, 65, 130, 200])
@pytest.mark.parametrize("seed", range(4))
def test_filling_matches_pixels(width, seed):
    r = np.random.default_rng(seed)
    points = [(float(x), float(y)) for x, y in zip(r.uniform(-40, width + 40, 9), r.uniform(-9, 49, 9), strict=True)]
    xs, ys = map(np.array, zip(*points, strict=True))
    words = masks.polygon_words(xs, ys, 40, width)
    assert (masks.unpacked(words, 40, width) == plain_fill(points, 40, width)).all()
    assert (masks.packed(plain_fill(points, 40, width)) == words).all()


@pytest.mark.parametrize("seed", range(6))
def test_run_lengths_round_trip(seed):
    r = np.random.default_rng(seed)
    height, width = [(7, 3), (48, 64), (1, 1), (30, 129), (300, 70), (5, 65)][seed]
    for share in (0.0, 0.02, 0.5, 0.98, 1.0):
        mask = r.random((height, width)) < share
        counts = masks.counts_of(masks.packed(mask), height, width)
        assert sum(counts) == height * width and all(c > 0 for c in counts[1:])
        assert masks.decompressed(masks.compressed(counts)) == counts
        assert (masks.unpacked(masks.words_of(counts, height, width), height, width) == mask).all()


def test_known_string():
    """Counts and string worked out by hand: 6, 1, then 40 as it is, then 4 - 1 and 30 - 40."""
    assert masks.compressed([6, 1, 40, 4, 30]) == "61X13" + chr(48 + (-10 & 31))


MASKS = "image_id long, label_id long, class_id long, x1 double, y1 double, x2 double, y2 double, points array<struct<x: double, y: double>>"


def square(a, b, c, d):
    return [(float(x), float(y)) for x, y in ((a, b), (c, b), (c, d), (a, d))]


def test_overlap_order_and_pairs(spark):
    rows = [(1, 1, 0, square(0, 0, 80, 10)), (1, 2, 0, square(10, 2, 20, 8)), (1, 3, 0, square(15, 0, 25, 6)), (1, 4, 1, square(66, 0, 76, 6)), (2, 1, 0, None), (2, 2, 0, [(1.0, 1.0)]), (3, 1, 0, square(200, 200, 300, 300))]
    df = spark.createDataFrame([(i, k, c, 0.0, 0.0, 1.0, 1.0, p) for i, k, c, p in rows], MASKS).withColumn("mask", masks.filled(F.col("points"), 12, 90))
    got = {(r.image_id, r.label_id): (r["rank"], r.area, r.n) for r in masks.painted(df, 24).withColumn("n", masks.area("visible")).collect()}
    hidden = len(union(rows[1:4]))
    assert got == {(1, 1): (1, 800, 800 - hidden), (1, 2): (2, 60, 40), (1, 3): (3, 60, 60), (1, 4): (4, 60, 60), (2, 1): (1, 0, 0), (2, 2): (2, 0, 0), (3, 1): (1, 0, 0)}
    det = df.withColumnRenamed("label_id", "det_id").withColumn("conf", F.lit(0.5))
    pairs = {(r.image_id, r.det_id, r.label_id): r.iou for r in masks.mask_overlaps(df, det, 0.0).collect()}
    assert pairs[1, 2, 3] == pytest.approx(20 / 100) and pairs[1, 1, 2] == pytest.approx(60 / 800) and (1, 4, 1) not in pairs and not any(i != 1 for i, *_ in pairs)
    assert {(r.det_id, r.thr) for r in evaluate.true_positives(df, det, masks.mask_overlaps(df, det)).collect()} == {(k, t) for k in (1, 2, 3, 4) for t in range(10)}


def union(rows):
    return {(x, y) for _, _, _, p in rows for x in range(int(p[0][0]), int(p[1][0])) for y in range(int(p[0][1]), int(p[2][1]))}


def test_records(spark, tmp_path):
    df = spark.createDataFrame([(7, 1, 3, 1.23456, 2.0, 9.98765, 8.0, square(1, 2, 9, 8)), (8, 1, 4, 0.0, 0.0, 0.0, 0.0, [])], MASKS).withColumns({"conf": F.lit(0.123456), "mask": masks.filled(F.col("points"), 12, 70)})
    masks.write_records(df, f"{tmp_path}/r", 12, 70)
    back = {r.image_id: r for r in masks.read_records(spark, f"{tmp_path}/r", 12, 70).collect()}
    mine = {r.image_id: r for r in df.collect()}
    assert all(back[i].mask == mine[i].mask and back[i].class_id == mine[i].class_id and back[i].conf == 0.12346 for i in (7, 8))
    assert back[7].bbox == [1.235, 2.0, 8.753, 6.0] and masks.decompressed(back[8].counts) == [840]
    with pytest.raises(Exception, match="12 x 71"):
        masks.read_records(spark, f"{tmp_path}/r", 12, 71).collect()


@pytest.mark.parametrize("seed", range(4))
def test_batches_match_single_masks(seed):
    """All masks of a batch at once give what they give one by one, the empty and the full one too."""
    from boxlake.operators.pixels import run_lengths

    r = np.random.default_rng(seed)
    height, width = [(7, 3), (48, 64), (30, 129), (1, 1)][seed]
    many = [r.random((height, width)) < share for share in (0.0, 1.0, 0.3, 0.02, 0.97, 0.0, 0.5)]
    words = np.stack([masks.packed(m) for m in many])
    counts, sizes = masks.counts_of_all(words, height, width)
    assert [c.tolist() for c in np.split(counts, np.cumsum(sizes)[:-1])] == [run_lengths(m) for m in many]
    texts = masks.compressed_all(counts, sizes)
    back, again = masks.decompressed_all(texts)
    assert back.tolist() == counts.tolist() and again.tolist() == sizes.tolist()
    assert (masks.words_of_all(back, again, height, width) == words).all()
    assert texts.to_pylist() == [masks.compressed(run_lengths(m)) for m in many]


def test_null_and_broken_strings(spark):
    df = spark.createDataFrame([(1, None), (2, masks.compressed([840]))], "k int, t string")
    got = {r.k: r.n for r in df.select("k", masks.area(masks.decoded(F.col("t"), 12, 70)).alias("n")).collect()}
    assert got == {1: None, 2: 0}
    with pytest.raises(ValueError, match="add up"):
        masks.words_of([839], 12, 70)
    with pytest.raises(ValueError, match="breaks off"):
        masks.decompressed("P")


def test_masks_are_filled_after_the_join(spark):
    """Boxes are dealt out for the join of masks, not the masks."""
    from boxlake.plans import masks as plans

    box = "image_id long, {} long, class_id long, {} x1 double, y1 double, x2 double, y2 double"
    lab = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 200.0, 200.0), (2, 1, 0, 0.0, 0.0, 50.0, 50.0)], box.format("label_id", ""))
    det = spark.createDataFrame([(1, 3, 0, 0.5, 0.0, 0.0, 200.0, 200.0), (2, 3, 0, 0.5, 300.0, 0.0, 350.0, 50.0)], box.format("det_id", "conf double,"))
    pairs = plans.mask_pairs(lab, det)
    lines = pairs._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert any("ArrowEvalPython" in x for x in lines[:join]) and not any("ArrowEvalPython" in x for x in lines[join:])
    assert [(r.image_id, r.label_id, r.det_id) for r in pairs.collect()] == [(1, 1, 3)]


def test_tiles_are_not_shuffled(spark):
    """Boxes are dealt out by image; their tiles, masks and pairs stay where they are."""
    from boxlake.plans import evaluation

    lines = evaluation.mask_iou(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    tiles = max(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert not any("Exchange hashpartitioning" in x and "mask_id" in x for x in lines[: tiles + 1])
    left = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 2, 9), (2, 1, 5)], "image_id long, mask_id long, pixel long")
    right = spark.createDataFrame([(1, 7, 6), (1, 7, 8), (1, 8, 5), (3, 1, 5)], "image_id long, mask_id long, pixel long")
    got = {(r.image_id, r.left_id, r.right_id): round(r.iou, 6) for r in evaluate.mask_iou(left, right).collect()}
    assert got == {(1, 1, 7): 0.333333, (1, 1, 8): 0.5}


def test_painting_goes_on_from_batch_to_batch(spark):
    rng = np.random.default_rng(9)
    sizes = {1: 23, 2: 1, 3: 2, 4: 9, None: 3}
    words = {(i, k): None if (i, k) == (4, 5) else rng.integers(-(1 << 62), 1 << 62, 2).tolist() for i, n in sizes.items() for k in range(n)}
    df = spark.createDataFrame([(i, k, w) for (i, k), w in words.items()], "image_id long, label_id long, mask array<long>")
    ones = lambda w: sum((x % 2**64).bit_count() for x in w)
    want = {}
    for i, n in sizes.items():
        order = sorted(range(n), key=lambda k: (words[i, k] is None, -ones(words[i, k] or []), k))
        for r, k in enumerate(order, 1):
            later = [0, 0]
            for o in order[r:]:
                later = [x | y for x, y in zip(later, words[i, o] or [0, 0], strict=True)]
            w = words[i, k]
            want[i, k] = (r, None, None) if w is None else (r, ones(w), ones([x & ~y for x, y in zip(w, later, strict=True)]))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for many in (4, 1000):
            spark.conf.set(name, many)
            assert {(r.image_id, r.label_id): (r["rank"], r.area, r.visible) for r in masks.painted(df, 2, count=True).collect()} == want
            assert {(r.image_id, r.label_id): r.visible and ones(r.visible) for r in masks.painted(df, 2).collect()} == {k: v[2] for k, v in want.items()}
    finally:
        spark.conf.set(name, before)


def test_counts_of_polygons_without_their_masks(spark):
    rows = [(1, 1, 0, square(0, 0, 80, 10)), (1, 2, 0, square(10, 2, 20, 8)), (2, 1, 0, None), (2, 2, 0, [(1.0, 1.0)]), (3, 1, 0, square(60, 3, 70, 5))]
    df = spark.createDataFrame([(i, k, c, 0.0, 0.0, 1.0, 1.0, p) for i, k, c, p in rows], MASKS)
    got = {(r.image_id, r.label_id): tuple(r.m) for r in df.withColumn("m", masks.filled_counts(F.col("points"), 12, 90)).collect()}
    assert got == {(1, 1): (800, 80, 10), (1, 2): (60, 10, 6), (2, 1): (0, 0, 0), (2, 2): (0, 0, 0), (3, 1): (20, 10, 2)}
    both = df.withColumns({"m": masks.filled_with_area(F.col("points"), 12, 90), "mask": masks.filled(F.col("points"), 12, 90)}).collect()
    assert all(r.m.mask == r["mask"] and r.m.area == got[r.image_id, r.label_id][0] for r in both)


def test_matching_of_masks_shuffles_pairs_once(spark):
    lab = spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "image_id long, label_id long, class_id long")
    det = spark.createDataFrame([(1, 1, 0, 0.9), (1, 2, 0, 0.8)], "image_id long, det_id long, class_id long, conf double")
    pairs = spark.createDataFrame([(1, 1, 0, 0.9, 1, 0, 0.8), (1, 2, 0, 0.8, 1, 0, 0.7), (1, 2, 0, 0.8, 2, 0, 0.6)], "image_id long, det_id long, class_id long, conf double, label_id long, label_class long, iou double")
    out = evaluate.true_positives(lab, det, pairs)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.det_id, r.thr) for r in out.collect()) == [(1, t) for t in range(7)]
