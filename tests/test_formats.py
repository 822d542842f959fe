"""Boxes without extent, skewed confidences, mosaics, filters and helpers of the formats."""

import numpy as np
import pytest
from boxlake.functions import boxes as B
from boxlake.functions import text as T
from boxlake.operators import anchors, evaluate, pixels, profile
from boxlake.sources import sinks
from pyspark.sql import functions as F


def test_boxes_without_extent(spark):
    rows = [(10.0, 10.0, 0.0, 5.0, 10.0, 10.0, 0.0, 5.0), (10.0, 10.0, 4.0, 0.0, 12.0, 10.0, 0.0, 0.0), (1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0), (5.0, 5.0, 2.0, 2.0, 5.0, 5.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double, h double")
    out = df.select(*(v.alias(k) for k, v in B.iou_family(B.box("a", "b", "c", "d"), B.box("e", "f", "g", "h")).items())).collect()
    assert all(np.isfinite(v) for r in out for v in r) and out[3].iou == pytest.approx(1.0, abs=1e-6)


def test_anchors_and_histogram_of_boxes_without_extent(spark):
    df = spark.createDataFrame([(1, 1, 0, 50.0, 50.0, 0.0, 20.0), (1, 2, 0, 50.0, 50.0, 16.0, 30.0)], "image_id long, label_id long, class_id long, x double, y double, w double, h double")
    assert anchors.best_possible_recall(df).first().bpr == 0.5
    assert {r.label_id for r in anchors.assign_targets(df).collect()} == {2}
    assert [(r.bin, r.percent) for r in profile.shared_histogram(df.withColumn("v", F.lit(3.0)), "v", "class_id").collect()] == [(20, 100.0)]


def test_curves_of_crowded_confidences(spark):
    """95 of 100 confidences lie below 0.01, many are equal."""
    rng = np.random.default_rng(3)
    n = 600
    conf = np.where(rng.random(n) < 0.95, rng.integers(1, 40, n) / 5000, rng.random(n))
    hit = rng.random(n) < 0.5
    lab = spark.createDataFrame([(i, 0, 0, 0.0, 0.0, 10.0, 10.0) for i in range(n)], "image_id long, label_id long, class_id long, x1 double, y1 double, x2 double, y2 double")
    det = spark.createDataFrame([(i, 0, 0, float(conf[i]), 0.0 if hit[i] else 50.0, 0.0, 10.0 if hit[i] else 60.0, 10.0) for i in range(n)], "image_id long, det_id long, class_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    got = {r.image_id: r for r in evaluate.curve(lab, det).where("thr = 0").collect()}
    order = sorted(range(n), key=lambda i: (-conf[i], i))
    tp = np.cumsum(hit[order])
    precision = tp / np.arange(1, n + 1)
    envelope = np.maximum.accumulate(precision[::-1])[::-1]
    for k, i in enumerate(order):
        assert (got[i].n, got[i].tpc) == (k + 1, tp[k]) and got[i].envelope == pytest.approx(envelope[k], abs=1e-12)


def test_butterworth():
    b, a = pixels.butterworth(5, 0.06)
    at = lambda share: abs(np.polyval(b, np.exp(1j * np.pi * share)) / np.polyval(a, np.exp(1j * np.pi * share)))
    assert at(0.0) == pytest.approx(1.0, abs=1e-6) and at(0.06) == pytest.approx(2**-0.5, rel=1e-6) and at(0.5) < 1e-4
    one, two = pixels.butterworth(1, 0.5)
    assert one == pytest.approx([0.5, 0.5]) and two == pytest.approx([1.0, 0.0], abs=1e-12)


def test_lowpass_series(spark):
    import pandas as pd

    x = [float(i) + (3.0 if i % 2 else -3.0) for i in range(200)]
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "t": range(200), "v": x}))
    got = [r.smooth for r in pixels.lowpass_series(df, "k", "t", "v", "k long, t long, smooth double", cutoff=0.3).orderBy("t").collect()]
    assert max(abs(g - i) for i, g in enumerate(got[30:170], 30)) < 0.05
    flat = spark.createDataFrame(pd.DataFrame({"k": 1, "t": range(5), "v": 7.0}))
    assert [r.smooth for r in pixels.lowpass_series(flat, "k", "t", "v", "k long, t long, smooth double").collect()] == pytest.approx([7.0] * 5)


def test_names_and_dates(spark):
    df = spark.createDataFrame([("http://a.b/c",), ("0",), ("/x/y",), ("https:///x",), (None,)], "u string").select(T.is_url(F.col("u")).alias("r"))
    assert [r.r for r in df.collect()] == [True, False, False, False, False]
    one = spark.range(1).select(T.age_in_days(F.lit("2023-12-30 23:59:59"), F.lit("2024-01-02 00:00:00")).alias("d"), T.plain_date(F.lit("2021-03-06").cast("date")).alias("p")).first()
    assert (one.d, one.p) == (2, "2021-3-6")


def test_metrics_log_has_one_header_for_readers(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in range(3):
        sinks.append_metrics_csv(spark.createDataFrame([(i, i / 2)], "epoch long, loss double"), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["epoch", "loss"] and sorted(r.epoch for r in back.collect()) == ["0", "1", "2"]
