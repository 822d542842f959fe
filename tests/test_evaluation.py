"""Matching, curves and suppression against plain loops."""

import random

import numpy as np
import pytest
from boxlake.operators import evaluate, suppress
from pyspark.sql import functions as F

LAB = "image_id long, label_id long, class_id long, x1 double, y1 double, x2 double, y2 double"
DET = "image_id long, det_id long, class_id long, conf double, x1 double, y1 double, x2 double, y2 double"


def iou(a, b, eps=1e-7):
    inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter + eps)


def scene(seed, images=25):
    rng = random.Random(seed)
    lab, det = [], []
    for im in range(images):
        for k in range(rng.randint(0, 5)):
            x, y, w, h = rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(20, 90), rng.uniform(20, 90)
            lab.append((im, k, rng.randint(0, 2), x, y, x + w, y + h))
            for _ in range(rng.randint(0, 2)):
                j = [rng.uniform(-8, 8) for _ in range(4)]
                det.append([im, len(det), lab[-1][2], 0, x + j[0], y + j[1], x + w + j[2], y + h + j[3]])
        for _ in range(rng.randint(0, 2)):
            x, y = rng.uniform(0, 300), rng.uniform(0, 300)
            det.append([im, len(det), rng.randint(0, 3), 0, x, y, x + 40, y + 40])
    conf = list(range(1, len(det) + 1))
    rng.shuffle(conf)
    for d, c in zip(det, conf, strict=True):
        d[3] = c / (len(det) + 1)
    return lab, [tuple(d) for d in det]


def matched(lab, det, thr):
    """True positives: each detection its best label of the class, each label its most confident detection."""
    best = {}
    for d in det:
        fits = [(iou(x[3:], d[4:]), -x[1], x) for x in lab if x[0] == d[0] and x[2] == d[2]]
        if fits and max(fits)[0] >= thr:
            best.setdefault(max(fits)[2][:2], []).append(d)
    return {max(ds, key=lambda d: d[3])[:2] for ds in best.values()}


def loop_ap(lab, det, cls, thr):
    rows = sorted((d for d in det if d[2] == cls), key=lambda d: -d[3])
    n = sum(x[2] == cls for x in lab)
    if not rows or not n:
        return 0.0
    tp = matched(lab, det, thr)
    hits = np.cumsum([d[:2] in tp for d in rows])
    recall, precision = hits / (n + 1e-16), hits / np.arange(1, len(rows) + 1)
    r, p = np.concatenate(([0.0], recall, [1.0])), np.concatenate(([1.0], precision, [0.0]))
    p = np.flip(np.maximum.accumulate(np.flip(p)))
    x = np.linspace(0, 1, 101)
    y = np.interp(x, r, p)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_and_ap(spark, seed):
    lab, det = scene(seed)
    a, b = spark.createDataFrame(lab, LAB), spark.createDataFrame(det, DET)
    tp = evaluate.true_positives(a, b).collect()
    for k in (0, 5, 9):
        assert {(r.image_id, r.det_id) for r in tp if r.thr == k} == matched(lab, det, (10 + k) / 20)
    for r in evaluate.average_precision(a, b).collect():
        if sum(x[2] == r.class_id for x in lab) and any(d[2] == r.class_id for d in det):
            assert abs(r.ap - loop_ap(lab, det, r.class_id, (10 + r.thr) / 20)) < 0.011  # at recall 1 the grid takes the closing zero


def test_matrix_columns_count_labels(spark):
    lab, det = scene(3)
    m = evaluate.confusion(spark.createDataFrame(lab, LAB), spark.createDataFrame(det, DET), 4).collect()
    for c in range(3):
        assert sum(r.n for r in m if r.true_class == c) == sum(x[2] == c for x in lab)


def test_no_detections_and_no_labels(spark):
    lab, det = scene(4)
    none_d, none_l = spark.createDataFrame([], DET), spark.createDataFrame([], LAB)
    assert all(r.ap == 0 for r in evaluate.average_precision(spark.createDataFrame(lab, LAB), none_d).collect())
    assert evaluate.average_precision(none_l, spark.createDataFrame(det, DET)).count() == 0
    assert evaluate.confusion(none_l, spark.createDataFrame(det, DET), 4).count() == 0


@pytest.mark.parametrize("seed", [5, 6])
def test_nms(spark, seed):
    _, det = scene(seed)
    kept = []
    for d in sorted((d for d in det if d[3] > 0.25), key=lambda d: (-d[3], d[1])):
        if all(k[0] != d[0] or k[2] != d[2] or iou(k[4:], d[4:], 0.0) <= 0.45 for k in kept):
            kept.append(d)
    assert {(r.image_id, r.det_id) for r in suppress.nms(spark.createDataFrame(det, DET)).collect()} == {k[:2] for k in kept}


def test_second_step_of_matching_differs(spark):
    """A label keeps its most confident detection for AP, its closest one in the matrix."""
    lab = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 100.0, 100.0)], LAB)
    det = spark.createDataFrame([(1, 0, 0, 0.9, 0.0, 0.0, 100.0, 70.0), (1, 1, 0, 0.8, 0.0, 0.0, 100.0, 100.0)], DET)
    assert [r.det_id for r in evaluate.true_positives(lab, det).where("thr = 0").collect()] == [0]
    cells = {(r.pred_class, r.true_class): r.n for r in evaluate.confusion(lab, det, 1).collect()}
    assert cells == {(0, 0): 1, (0, 1): 1}


def test_larger_cuts(spark):
    """Blocks of cuts count as all cuts do, with few comparisons."""
    values = [0.0, 0.5, 1.0, 2.0, 7.5, 8.0, 8.1, 254.0, 255.0, 300.0, -3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in (0, 1, 15, 16, 17, 32, 255):
        cuts = [float(x) for x in range(n, 0, -1)]
        got = {r.v: r.k for r in df.select("v", evaluate.larger_cuts(cuts, F.col("v")).alias("k")).collect()}
        assert got == {v: sum(c > v for c in cuts) for v in values}


def test_one_table_of_cells_gives_grid_and_ap(spark):
    lab, det = scene(7)
    a, b = spark.createDataFrame(lab, LAB), spark.createDataFrame(det, DET)
    cells = evaluate.curve_cells(a, b)
    assert cells.where("thr < 0").count() <= len(det) and cells.where("thr >= 0").count() <= 3 * 10 * 101
    plain = {(r.class_id, r.k): (r.recall, r.precision) for r in evaluate.operating_grid(a, b, curves=evaluate.curve(a, b)).collect()}
    got = {(r.class_id, r.k): (r.recall, r.precision) for r in evaluate.operating_grid(a, b, cells=cells).collect()}
    assert got.keys() == plain.keys() and all(got[x] == pytest.approx(plain[x], abs=1e-12) for x in got)
    assert {tuple(r) for r in evaluate.average_precision(a, b, cells=cells).collect()} == {tuple(r) for r in evaluate.average_precision(a, b).collect()}


def test_hits_keep_every_detection_and_deal_them_out_once(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    lab, det = scene(8)
    det += [(0, None, lab[0][2], 0.5, 0.0, 0.0, 9.0, 9.0)] * 2 + [(None, 5, lab[0][2], 0.5, 0.0, 0.0, 9.0, 9.0)]
    spark.conf.set(name, -1)
    try:
        rows = evaluate.with_hits(spark.createDataFrame(lab, LAB), spark.createDataFrame(det, DET))
        assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(image_id") == 1
        got = rows.collect()
    finally:
        spark.conf.set(name, before)
    known = {x[2] for x in lab}
    assert sorted((str(r.image_id), str(r.det_id), r.class_id) for r in got) == sorted((str(d[0]), str(d[1]), d[2]) for d in det if d[2] in known)
    for k in (0, 4, 9):
        assert {(r.image_id, r.det_id) for r in got if r.hits >> k & 1} == matched(lab, [d for d in det if None not in d], (10 + k) / 20)
