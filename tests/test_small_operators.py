"""Small operators on rows that can be checked by eye."""

import numpy as np
import pytest
from boxlake.functions import boxes as B
from boxlake.operators import anchors, dedup, evaluate, profile, suppress, validate
from boxlake.sources import dataset, sinks
from pyspark.sql import functions as F


def test_filters(spark):
    df = spark.createDataFrame([(1, 0, 3, 2.0, 2.0), (1, 1, 3, 1.0, 1.0), (1, 2, 3, 9.0, 9.0), (2, 0, 4, 1.0, 1.0)], "image_id long, label_id long, class_id long, w double, h double")
    assert profile.with_min_items(df, 2).count() == 3
    assert {r.class_id for r in profile.single_class(df).collect()} == {0}
    assert {(r.image_id, r.label_id) for r in profile.smallest_half(df).collect()} == {(1, 1), (1, 0)}


def test_gates(spark):
    lines = spark.createDataFrame([(1, 1, "0 0.5 0.5 0.2 0.2")], "image_id long, line_no long, line string")
    assert validate.require_valid(lines, 3).count() == 1
    with pytest.raises(ValueError):
        validate.require_valid(lines, 0)
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(1, 9)], "k long, n long")
    assert validate.assert_references(a.where("k = 1"), b, "k").count() == 1
    with pytest.raises(ValueError):
        validate.assert_references(a, b, "k")


def test_class_maps_and_report(spark):
    ap = spark.createDataFrame([(0, 0, 0.8), (0, 1, 0.4), (2, 0, 0.2), (2, 1, 0.0)], "class_id long, thr int, ap double")
    got = {r.class_id: round(r.map, 6) for r in evaluate.class_maps(ap, 4).collect()}
    assert got == {0: 0.6, 1: 0.35, 2: 0.1, 3: 0.35}
    point = spark.createDataFrame([(0, 5, 0.5, 0.5, 0.5, 2.0, 2.0)], "class_id long, n_labels long, precision double, recall double, f1 double, tp double, fp double")
    names = spark.createDataFrame([(1, "x")], "class_id long, class_name string")
    (r,) = evaluate.class_report(ap, point, names).collect()
    assert (r.class_name, r.ap50, round(r.ap, 6)) == ("unknown", 0.8, 0.6)


def test_redundancy_and_edges(spark):
    s = spark.createDataFrame([(1, 2, 0.99, 0.99, 0.95, 0, 0), (1, 3, 0.99, 0.99, 0.95, 0, 1), (2, 3, 0.9, 0.99, 0.95, 0, 0)], "a long, b long, whole_ssim double, region_ssim double, iou double, class_a int, class_b int")
    assert [tuple(r) for r in dedup.redundant_pairs(s).collect()] == [(1, 2)]
    assert [tuple(r) for r in dedup.inner_edges(s.select("a", "b"), spark.createDataFrame([(1,), (3,)], "node long")).collect()] == [(1, 3)]


def test_representatives_keep_the_best(spark):
    m = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7), (1, 4, 0.6), (2, 9, 0.1)], "cluster_id long, item_id long, quality double")
    got = {r.item_id: (r.kept, r.represented_by) for r in dedup.representatives(m, spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")).collect()}
    assert got == {1: (True, 1), 2: (False, 1), 3: (True, 3), 4: (False, 3), 9: (True, 9)}


def test_points(spark):
    df = spark.createDataFrame([(1,)], "i int").select(F.array(F.struct(F.lit(0.5).alias("x"), F.lit(2.0).alias("y"))).alias("p"))
    r = df.select(B.points_to_pixels(F.col("p"), 100.0, 50.0)[0].alias("a"), B.unletterbox_points(B.points_to_pixels(F.col("p"), 640.0, 640.0), 640.0, 640.0, F.lit(100.0), F.lit(100.0), True)[0].alias("b")).first()
    assert (r.a.x, r.a.y, r.b.x, r.b.y) == (50.0, 100.0, 0.5, 1.0)


def test_anchor_search(spark):
    rows = [(10.0 + i % 3, 12.0) for i in range(40)] + [(100.0 + i % 5, 90.0) for i in range(40)]
    df = spark.createDataFrame(rows, "w double, h double")
    c = anchors.whitened_kmeans(df, 2)
    assert abs(c[0][0] - 11) < 1 and abs(c[1][0] - 102) < 1
    start = [(20.0, 20.0), (80.0, 80.0)]
    assert anchors.fitness(df, anchors.evolved(df, start, 3, 8)) >= anchors.fitness(df, start)


def test_descriptor_and_cache(spark, tmp_path):
    d = dataset.Dataset.of({"path": "/d", "train": ["a", "/b"], "val": "c", "names": ["x", "y"], "nc": 2})
    assert d.splits == {"train": ["/d/a", "/b"], "val": ["/d/c"]} and d.names == {0: "x", 1: "y"} and d.classes(spark).count() == 2
    with pytest.raises(ValueError):
        dataset.Dataset.of({"train": "a"})
    files = spark.createDataFrame([("p", b"1"), ("q", b"2")], "path string, content binary")
    key = dataset.content_key(files)
    assert key == dataset.content_key(files.repartition(3)) != dataset.content_key(files.where("path = 'p'"))
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert dataset.cached(spark, key, str(tmp_path), build).count() == dataset.cached(spark, key, str(tmp_path), build).count() == 3 and calls == [1]


def test_table_forms(spark):
    det = spark.createDataFrame([(1, 0, 5, 0.5, 10.0, 20.0, 30.0, 60.0)], "image_id long, det_id long, class_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    (r,) = sinks.four_forms(det, 100.0, 200.0, spark.createDataFrame([(1, "x")], "class_id long, class_name string")).collect()
    assert (r.class_name, r.x, r.y, r.w, r.h, r.xn, r.hn) == ("unknown", 20.0, 40.0, 20.0, 40.0, 0.2, 0.2)
    assert sinks.nested_summary(spark.createDataFrame([("a", 1, 2)], "split string, class_id long, n long")).first()[0] == '{"a":"{\\"1\\":2}"}'
    (c,) = sinks.crop_boxes(det, 100.0, 200.0, 1.2, 3.0).collect()
    assert (c.x1, c.y1, c.x2, c.y2) == (6, 14, 33, 65)


def test_a_summary_is_exact(spark):
    rows = [(k, float(v)) for k, n in (("a", 101), ("b", 4), ("c", 1)) for v in range(n)] + [("a", 7.0)] * 500 + [("b", None), ("d", None), (None, 2.5)]
    got = {r.k: r for r in profile.summary(spark.createDataFrame(rows, "k string, v double").repartition(5), "v", "k").collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for k, r in got.items():
        values = [v for key, v in rows if key == k and v is not None]
        if values:
            want = [min(values), *np.percentile(values, [5, 25, 50, 75, 95]), np.mean(values), max(values)]
            assert [r.min, r.p05, r.p25, r.median, r.p75, r.p95, r.mean, r.max] == pytest.approx(want, abs=1e-6)
        else:
            assert r.median is None and r["max"] is None
    assert profile.summary(spark.createDataFrame([(1.0,), (2.0,)], "v double"), "v").first().median == 1.5
    assert profile.summary(spark.createDataFrame([], "k string, v double"), "v", "k").count() == 0


def test_many_equal_hashes(spark):
    items = [(i, 5) for i in range(4000)] + [(5000 + i, 7) for i in range(3)] + [(6000, -1)]
    df = spark.createDataFrame(items, "item_id long, hash long").withColumn("split", F.when(F.col("item_id") % 2 == 0, "train").otherwise("val"))
    labels = dedup.components(dedup.linking_edges(df, 6)).collect()
    assert {r.node for r in labels} == {i for i, _ in items[:-1]} and {r.label for r in labels} == {0}
    got = {r.pair: r.n for r in dedup.pair_counts(df, 6).collect()}
    train, val = 2000 + 2, 2000 + 1
    assert got == {"train-train": train * (train - 1) // 2, "train-val": train * val, "val-val": val * (val - 1) // 2}


def test_suppression_stops_at_the_limit(spark):
    boxes = [(1, i, i % 2, 0.9 - i / 1000, 20.0 * i, 0.0, 20.0 * i + 10, 10.0) for i in range(40)]
    det = spark.createDataFrame(boxes, "image_id long, det_id long, class_id long, conf double, x1 double, y1 double, x2 double, y2 double")
    assert [r.det_id for r in suppress.nms(det, max_det=7).orderBy("det_id").collect()] == list(range(7))


def test_descriptor_file(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "images").mkdir()
    (tmp_path / "d.yaml").write_text(f"path: {tmp_path}\ntrain: ../images\nval: images\nnames:\n  0: x\n  1: y\n")
    d = dataset.Dataset.read(spark, str(tmp_path / "d.yaml"))
    assert d.splits == {"train": [f"{tmp_path}/images"], "val": [f"{tmp_path}/images"]} and d.names == {0: "x", 1: "y"}


def test_resampled_polygons_are_compiled(spark):
    """The query takes one point a row in compiled code; it gives what resample gives."""
    from boxlake.functions import boxes
    from boxlake.plans import geometry

    plan = geometry.resampled_polygons(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan
    rows = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)]), (2, [(1.0, 1.0)]), (3, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.5, 0.5)])]
    df = spark.createDataFrame(rows, "k int, points array<struct<x: double, y: double>>")
    whole = {r.k: [tuple(p) for p in r.p] for r in df.select("k", boxes.resample(F.col("points"), 7).alias("p")).collect()}
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i")).select("k", "i", boxes.resampled_point(F.col("points"), F.col("i"), 7).alias("p")).collect()
    assert {(r.k, r.i): tuple(r.p) for r in each} == {(k, i): p for k, ps in whole.items() for i, p in enumerate(ps)}
    assert whole[1][0] == whole[1][-1] == (0.0, 0.0) and whole[1][2] == (4.0, 0.0) and whole[2] == [(1.0, 1.0)] * 7


def test_anchor_rounds_read_their_boxes_once(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    wh = [(float(w), float(h)) for w, h in rng.integers(5, 60, (400, 2))]
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame(wh, "w double, h double").mapInPandas(passed, "w double, h double")
    start = [(10.0, 10.0), (30.0, 20.0), (50.0, 50.0)]
    got = anchors.whitened_rounds(df, start, 8)
    a, now = pd.DataFrame(wh, columns=["w", "h"]), np.array(start)
    x, sd = a.to_numpy(), a.to_numpy().std(0)
    for _ in range(8):
        near = (((x[:, None] - now[None]) / sd) ** 2).sum(2).argmin(1)
        now = np.array([x[near == k].mean(0) for k in range(3)])
    assert np.array(got) == pytest.approx(now[np.argsort(now.prod(1))])
    assert seen.value == 400
    medians = {r.center: r for r in anchors.kmeans(df, start, 1).collect()}
    assert seen.value == 800 and sum(r.n for r in medians.values()) == 400
    anchors.evolved(df, start, 2, 3)
    assert seen.value == 1200


def test_strict_lines_are_parsed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    kind = "image_id long, line_no long, line string"
    good = [(1, 2, "0 0.5 0.5 0.2 0.2"), (1, 1, "1 0.5 0.5 0.2 0.2"), (2, 1, "0 0.5 0.5 0.2 0.2"), (1, 5, "0 0.4 0.5 0.2 0.2")]
    out = validate.require_valid(spark.createDataFrame(good, kind).mapInPandas(passed, kind), 3)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1, 0.5, 0.5, 0.2, 0.2), (1, 2, 0, 0.5, 0.5, 0.2, 0.2), (1, 3, 0, 0.4, 0.5, 0.2, 0.2), (2, 1, 0, 0.5, 0.5, 0.2, 0.2)]
    assert seen.value == len(good)
    for line, issue in (("0 0.5 0.5 0.2 0.2", "duplicate_box"), ("0 0.5 0.5", "invalid_column_count"), ("7 0.5 0.5 0.2 0.2", "class_out_of_range"), ("x 0.5 0.5 0.2 0.2", "non_numeric_label"), ("0 0.95 0.5 0.2 0.2", "box_crosses_boundary")):
        with pytest.raises(ValueError, match=issue):
            validate.require_valid(spark.createDataFrame([*good, (1, 9, line)], kind), 3)
