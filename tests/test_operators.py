"""Scans, graphs, hashes, readers, pixels and streams on small inputs."""

import json
import random

import numpy as np
import pytest
from boxlake.operators import anchors, dedup, pixels, profile, runlog, scan, split, validate, version
from boxlake.sources import annotations, sinks
from boxlake.streaming import frames
from pyspark.sql import functions as F


def test_running_sums_and_maxima(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(-5, 9)) for k in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    out = scan.running_sums(df, ["k"], F.floor(F.col("i") / 17), [F.asc("i")], {"s": "v"})
    got = scan.maxima_from_here(out, ["k"], [F.asc("i")], {"m": "v"}).collect()
    for r in got:
        mine = [v for k, i, v in rows if k == r.k]
        assert r.s == sum(mine[: r.i + 1])
        assert r.m == max(mine[r.i :])


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.label for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hamming_bands_miss_nothing(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = base + [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(1, 9))) for b in base for _ in range(4)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    want = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= 6}
    got = dedup.hamming_pairs(spark.createDataFrame(list(enumerate(signed)), "item_id long, hash long"), 6).collect()
    assert len(got) == len(want) and {(r.a, r.b, r.hamming) for r in got} == want
    assert (dedup.hamming_limit(0.85), dedup.hamming_limit(0.9)) == (9, 6)


def test_label_issues(spark):
    rows = [(1, 1, "0 0.5 0.5 0.2 0.2"), (1, 2, "0 0.5 0.5 0.2 0.2"), (1, 3, "0 0.5 0.5 0.2"), (2, 1, "x 0.5 0.5 0.2 0.2"), (2, 2, "1.5 0.5 0.5 0.2 0.2"), (3, 1, "0 1.5 0.5 0.2 0.2"), (3, 2, "0 0.95 0.5 0.2 0.2"), (3, 3, "99 0.5 0.5 0.2 0.2")]
    got = {(r.image_id, r.line_no, r.issue) for r in validate.label_issues(spark.createDataFrame(rows, "image_id long, line_no long, line string"), 80).collect()}
    assert got == {(1, 2, "duplicate_box"), (1, 3, "invalid_column_count"), (2, 1, "non_numeric_label"), (2, 2, "non_integer_class"), (3, 1, "coordinate_out_of_range"), (3, 2, "box_crosses_boundary"), (3, 3, "class_out_of_range")}
    with pytest.raises(ValueError):
        validate.assert_empty(spark.range(1), "a gate")


def test_yolo_round_trip(spark, tmp_path):
    d = tmp_path / "labels"
    d.mkdir()
    (d / "a.txt").write_text("0 0.5 0.5 0.25 0.5\n\n1 0.25 0.25 0.125 0.125\n")
    (d / "b.txt").write_text("2 0.1 0.1 0.9 0.1 0.9 0.8 0.1 0.8\n")
    lines = annotations.yolo_lines(spark, str(d))
    assert sorted((r.path[-5:], r.line_no) for r in lines.collect()) == [("a.txt", 1), ("a.txt", 3), ("b.txt", 1)]
    (p,) = annotations.polygons(lines).collect()
    assert (p.class_id, round(p.x, 6), round(p.y, 6), round(p.w, 6), round(p.h, 6), len(p.points)) == (2, 0.5, 0.45, 0.8, 0.7, 4)


def test_voc(spark, tmp_path):
    one = "<object><name>{}</name><difficult>{}</difficult><bndbox><xmin>11</xmin><xmax>31</xmax><ymin>21</ymin><ymax>61</ymax></bndbox></object>"
    f = tmp_path / "a.xml"
    f.write_text("<annotation><filename>a.jpg</filename><size><width>100</width><height>100</height></size>" + one.format("cat", 0) + one.format("cat", 1) + one.format("yak", 0) + "</annotation>")
    (r,) = annotations.voc(spark, str(f), ["dog", "cat"]).collect()
    assert (r.class_id, r.x, r.y, r.w, r.h) == (1, 0.2, 0.4, 0.2, 0.4)


def test_csv_and_json_formats(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/im1.txt").write_text("10,20,40,20,1,4,0,0\n0,0,5,5,0,0,0,0\n")
    (v,) = annotations.visdrone(spark, str(tmp_path / "v"), spark.createDataFrame([("im1", 100.0, 200.0)], "stem string, width double, height double")).collect()
    assert (v.class_id, v.x, v.y, v.w, v.h) == (3, 0.3, 0.15, 0.4, 0.1)
    (tmp_path / "s.csv").write_text("a.jpg,10,20,30,60,object,100,200\n")
    (s,) = annotations.sku(spark, str(tmp_path / "s.csv")).collect()
    assert (s.x, s.y, s.w, s.h) == (0.2, 0.2, 0.2, 0.2)
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 7, "file_name": "a.jpg", "width": 100, "height": 50}], "categories": [{"id": 3, "name": "x"}, {"id": 9, "name": "y"}], "annotations": [{"id": 1, "image_id": 7, "category_id": 9, "bbox": [90, 10, 20, 10], "iscrowd": 0}]}))
    (c,) = annotations.coco(spark, str(tmp_path / "c.json")).collect()
    assert (c.class_id, c.class_name, c.x, c.w, c.h) == (1, "y", 0.95, 0.1, 0.2)
    (tmp_path / "g.json").write_text(json.dumps({"seq_dirs": ["d0", "d1"], "images": [{"id": 5, "name": "p.jpg", "sid": 1}], "annotations": [{"image_id": 0, "category_id": 2, "bbox": [192, 120, 192, 240]}]}))
    (a,) = annotations.argoverse(spark, str(tmp_path / "g.json")).collect()
    assert (a.label_path, a.class_id, a.x, a.y, a.w, a.h) == ("d1/p.txt", 2, 0.15, 0.2, 0.1, 0.2)
    (tmp_path / "x.json").write_text(json.dumps({"features": [{"properties": {"bounds_imcoords": "10,20,30,40", "image_id": "i", "type_id": 1}}, {"properties": {"bounds_imcoords": "1,2,3,4", "image_id": "i", "type_id": 0}}]}))
    (x,) = annotations.xview(spark, str(tmp_path / "x.json"), [-1, 4], spark.createDataFrame([("i", 100.0, 100.0)], "image_id string, width double, height double")).collect()
    assert (x.class_id, x.x, x.y) == (4, 0.2, 0.3)
    (tmp_path / "b.csv").write_bytes(b"\xef\xbb\xbfepoch , loss\n1, 0.5\n")
    assert annotations.csv_without_bom(spark, str(tmp_path / "b.csv")).columns == ["epoch", "loss"]


def test_lists_and_folders(spark, tmp_path):
    (tmp_path / "l.txt").write_text("./images/a.jpg\n\n/abs/b.jpg\n")
    assert [r.path for r in annotations.listed_paths(spark, str(tmp_path / "l.txt")).collect()] == [f"{tmp_path}/images/a.jpg", "/abs/b.jpg"]
    got = annotations.class_folders(spark.createDataFrame([("/d/dog/1.jpg",), ("/d/cat/2.jpg",)], "path string")).collect()
    assert {(r.class_name, r.class_id) for r in got} == {("cat", 0), ("dog", 1)}


def test_pixels():
    rng = np.random.default_rng(0)
    a = rng.uniform(0, 255, (64, 64))
    assert pixels.ssim(a, a) == pytest.approx(1.0) and pixels.ssim(a, 255 - a) < 0.5
    assert pixels.perceptual_hash(a) == pixels.perceptual_hash(np.repeat(np.repeat(a, 2, 0), 2, 1))
    assert pixels.laplacian_variance(np.zeros((2, 9))) == 0.0 and pixels.laplacian_variance(np.ones((9, 9))) == 0.0
    m = rng.random((13, 7)) > 0.5
    runs = pixels.run_lengths(m)
    assert np.array_equal(np.repeat(np.arange(len(runs)) % 2 == 1, runs), m.ravel(order="F"))
    assert pixels.run_lengths(np.ones((2, 2))) == [0, 4] and pixels.run_lengths(np.zeros((2, 2))) == [4]
    assert pixels.rasterise([(1, 1), (5, 1), (5, 4), (1, 4)], 8, 8).sum() == 12


def test_image_measures(spark):
    rng = np.random.default_rng(1)
    rows = [(f"p{i}", 16, 16, 3, rng.integers(0, 256, 768, dtype=np.uint8).tobytes()) for i in range(5)]
    df = spark.createDataFrame(rows, "path string, height int, width int, channels int, pixels binary")
    for r in pixels.image_measures(df).collect():
        g = pixels.gray(dict((x[0], x[4]) for x in rows)[r.path], 16, 16, 3)
        assert r.brightness == pytest.approx(g.mean()) and r.phash == pixels.perceptual_hash(g)
    assert pixels.channel_histogram(df).agg(F.sum("n")).first()[0] == 5 * 768


def test_split_and_balance(spark):
    c = spark.createDataFrame([(i, i % 2, 1 + i % 5) for i in range(40)], "cluster_id long, class_id long, amount long")
    out = split.balance_clusters(c, spark.createDataFrame([], "split string, class_id long, n long"), {"train": 0.7, "val": 0.15, "test": 0.15})
    total = {r.target_split: r.s for r in out.groupBy("target_split").agg(F.sum("amount").alias("s")).collect()}
    assert abs(total["train"] / 120 - 0.7) < 0.05 and sum(total.values()) == 120


def test_versions(spark):
    files = spark.createDataFrame([(f"p{i}", bytes([i])) for i in range(50)], "path string, content binary")
    m = version.manifest(files)
    version.verify(m, version.manifest(files.repartition(7)))
    with pytest.raises(ValueError):
        version.verify(m, version.manifest(files.where("path <> 'p3'")))


def test_runlog(spark):
    log = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 3.0, 3.0, 2.0, 1.0])], "epoch long, fitness double")
    out = {r.epoch: (r.best_epoch, r.stop) for r in runlog.early_stopping(log, 2).collect()}
    assert out == {0: (0, False), 1: (1, False), 2: (2, False), 3: (2, False), 4: (2, True)}
    assert runlog.best_row(log).first().epoch == 1


def test_anchor_order():
    assert anchors.order_agrees(anchors.ANCHORS, anchors.STRIDES) and not anchors.order_agrees(anchors.ANCHORS[::-1], anchors.STRIDES)


def test_even_sample(spark):
    df = spark.range(11).select(F.lit("g").alias("g"), F.col("id"))
    assert sorted(r.id for r in profile.even_sample(df, "g", "id", 3).collect()) == [0, 5, 10]


def test_even_sample_of_a_large_group(spark):
    df = spark.range(10_001).select(F.lit(None).cast("long").alias("g"), (F.col("id") * 3).alias("id"))  # several chunks, a null group
    assert sorted(r.id for r in profile.even_sample(df, "g", "id", 5).collect()) == [0, 7500, 15000, 22500, 30000]


def test_aspect_batches_of_one_ratio(spark):
    rows = [(i, 480.0, 640.0) if i % 10 else (i, 640.0, 480.0) for i in range(9000)]
    out = runlog.aspect_batches(spark.createDataFrame(rows, "image_id long, height double, width double"), 900).orderBy("batch").collect()
    assert [(r.batch, r.n) for r in out] == [(b, 900) for b in range(10)]
    assert [r.shape_h < r.shape_w for r in out] == [True] * 9 + [False]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "0 0.5"), (2, "1 0.5")], "image_id long, line string")
    sinks.write_labels(rows, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_labels(rows, str(tmp_path / "o"))
    ids = spark.createDataFrame([(0,), (11,), (79,)], "c long").select(sinks.coco80_to_91(F.col("c")).alias("n")).collect()
    assert [r.n for r in ids] == [1, 13, 90]


def test_streaming_latest(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([(k, i, i * 1.0) for k in "ab" for i in range(5)], "stream string, frame long, v double")
    rows.write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    q = frames.latest_per_stream(stream, "stream", "frame", "v").writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.stream, r.frame, r.v) for r in spark.table("latest").collect()} == {("a", 4, 4.0), ("b", 4, 4.0)}
    q = frames.stateful_mean(stream, "stream", "v").writeStream.format("memory").queryName("mean").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.stream, r.n, r["mean"]) for r in spark.table("mean").collect()} == {("a", 5, 2.0), ("b", 5, 2.0)}
