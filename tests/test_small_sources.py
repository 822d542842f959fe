"""Running sums over chunks of chunks, crops, and small readers and writers."""

import json

import numpy as np
import pytest
from boxlake.operators import dedup, pixels
from boxlake.operators.scan import running_sums
from boxlake.sources import annotations, sinks
from pyspark.sql import functions as F


def test_sums_over_many_chunks(spark):
    r = np.random.default_rng(1)
    rows = [(k, int(i), int(v)) for k in ("a", "b", None) for i, v in zip(r.permutation(9000)[:3000], r.integers(-9, 9, 3000), strict=True)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {(x.k, x.i): x.s for x in running_sums(df, ["k"], F.floor(F.col("i") / 3), [F.asc("i")], {"s": "v"}, many_chunks=True).collect()}
    want, total = {}, {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        total[k] = total.get(k, 0) + v
        want[k, i] = total[k]
    assert got == want


def test_groups_are_numbered(spark):
    ids = [5, 70_000, 6, 3_000_000, 999, 1000]
    g = spark.createDataFrame([(i,) for i in ids], "first_id long")
    assert {r.first_id: r.group_no for r in dedup.numbered(g).collect()} == {i: n for n, i in enumerate(sorted(ids), 1)}


def test_crops(spark):
    a = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    images = spark.createDataFrame([(1, 4, 5, 3, a.tobytes())], "item_id long, height int, width int, channels int, pixels binary")
    boxes = [(1, 1, 1, 1, 3, 4), (1, 2, -5, -5, 2, 1), (1, 3, 4, 3, 99, 99), (1, 4, 3, 3, 3, 4), (1, 5, -9, 0, -2, 4), (2, 6, 0, 0, 4, 4)]
    got = {r.box_id: (r.height, r.width, bytes(r.pixels)) for r in pixels.crops(images, spark.createDataFrame(boxes, "item_id long, box_id long, x1 long, y1 long, x2 long, y2 long")).collect()}
    assert got == {1: (3, 2, a[1:4, 1:3].tobytes()), 2: (1, 2, a[0:1, 0:2].tobytes()), 3: (1, 1, a[3:4, 4:5].tobytes())}


def test_matrix(spark, tmp_path):
    (tmp_path / "m.txt").write_text("  1   2.5\t3 \n\n4 x 6\n7 8\n")
    rows = annotations.matrix(spark, str(tmp_path / "m.txt"), ["a", "b", "c"]).collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.5, 3.0), (4.0, None, 6.0), (7.0, 8.0, None)]


def test_best_generation(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "generation long, fitness double, lr0 double")
    folder = str(tmp_path / "e")
    best = lambda: [r.value for r in spark.read.text(f"{folder}/best").collect()]
    sinks.append_generation(rows((0, 0.5, 0.01)), folder, "fitness", "generation")
    sinks.append_generation(rows((1, 0.7, 0.02), (2, 0.7, None)), folder, "fitness", "generation")
    assert best() == ["# generations: 3", "generation: 1", "fitness: 0.7", "lr0: 0.02"]
    sinks.append_generation(rows((3, 0.8, None)), folder, "fitness", "generation")
    assert best() == ["# generations: 4", "generation: 3", "fitness: 0.8", "lr0: null"]


def test_json_texts(spark):
    counts = spark.createDataFrame([("b", 10, 1), ("a", 2, 5), ("a", 10, 3)], "split string, class_id long, n long")
    assert json.loads(sinks.split_summary(counts).first()[0]) == {"a": {"10": 3, "2": 5}, "b": {"10": 1}}
    images = spark.createDataFrame([(1, "t"), (2, "t"), (3, "v")], "image_id long, split string")
    labels = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (9, 1)], "image_id long, class_id long")
    got = {r.split: json.loads(r.stats) for r in sinks.stats_json(images, labels, 3).collect()}
    assert got["t"] == {"instance_stats": {"total": 3, "per_class": [2, 0, 1]}, "image_stats": {"total": 2, "unlabelled": 1, "per_class": [1, 0, 1]}}
    assert got["v"]["image_stats"] == {"total": 1, "unlabelled": 1, "per_class": [0, 0, 0]}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a/x.jpg", b"12"), ("a/b/y.PNG", b"\x00"), ("a/b/none.png", b""), ("z.txt", b"3")], "path string, content binary")
    assert sinks.write_files(df, str(tmp_path / "f")) == 4
    assert (tmp_path / "f/a/x.jpg").read_bytes() == b"12" and not [p for p in (tmp_path / "f").rglob(".*") if not p.name.endswith(".crc")]
    assert sorted((r.path.rsplit("/", 1)[1], r.size) for r in annotations.image_paths(spark, str(tmp_path / "f")).collect()) == [("x.jpg", 2), ("y.PNG", 1)]


@pytest.mark.parametrize("rows", [[], [(None, 1)]])
def test_sums_of_little(spark, rows):
    df = spark.createDataFrame(rows, "k string, v long")
    assert [r.s for r in running_sums(df, ["k"], F.lit(0), [F.asc("v")], {"s": "v"}, many_chunks=True).collect()] == [v for _, v in rows]
