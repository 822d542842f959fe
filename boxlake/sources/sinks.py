"""Writers: label text, COCO rows, lists, tables, crops."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions.boxes import Box, clip, to_centre, to_corners, to_normalised


# Category numbers of the 80 classes among the 91 of the paper.
COCO_CATEGORIES = (
    1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16, 17, 18, 19, 20, 21,
    22, 23, 24, 25, 27, 28, 31, 32, 33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44,
    46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65,
    67, 70, 72, 73, 74, 75, 76, 77, 78, 79, 80, 81, 82, 84, 85, 86, 87, 88, 89, 90,
)


def coco80_to_91(class_id: Column) -> Column:
    """Category number of a class id; null for an id beyond the 80."""
    return F.get(F.array(*(F.lit(n).cast("long") for n in COCO_CATEGORIES)), class_id.cast("int"))


def yolo_rows(det: DataFrame, width: float, height: float, with_conf: bool = True) -> DataFrame:
    """image_id and a line "class x y w h [conf]" with six decimals, half to even."""
    b = to_normalised(Box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), width, height)
    numbers = [*b, F.col("conf")] if with_conf else [*b]
    return det.select("image_id", "det_id", F.concat_ws(" ", F.col("class_id").cast("string"), *(F.format_string("%.6f", F.rint(c * 1e6) / 1e6) for c in numbers)).alias("line"))


def coco_rows(det: DataFrame) -> DataFrame:
    """image_id, category_id, bbox from the top left (three decimals, half to even) and score (five)."""
    b = to_centre(Box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))))
    r = lambda c, n: F.rint(c * 10**n) / 10**n
    return det.select("image_id", "det_id", coco80_to_91(F.col("class_id")).alias("category_id"), r(b.a - b.c / 2, 3).alias("bx"), r(b.b - b.d / 2, 3).alias("by"), r(b.c, 3).alias("bw"), r(b.d, 3).alias("bh"), r(F.col("conf"), 5).alias("score"))


def coco_json(det: DataFrame) -> DataFrame:
    """One JSON object per detection; write with df.write.text."""
    return coco_rows(det).select(F.to_json(F.struct("image_id", "category_id", F.array("bx", "by", "bw", "bh").alias("bbox"), "score")).alias("value"))


def crop_boxes(det: DataFrame, width: float, height: float, gain: float = 1.02, pad: float = 10.0, square: bool = False) -> DataFrame:
    """Whole-pixel corners of crops around detections."""
    c = to_centre(Box(*(F.col(x) for x in ("x1", "y1", "x2", "y2"))))
    w, h = (F.greatest(c.c, c.d), F.greatest(c.c, c.d)) if square else (c.c, c.d)
    b = clip(to_corners(Box(c.a, c.b, w * gain + pad, h * gain + pad)), width, height)
    return det.select("image_id", "det_id", *(F.floor(x).cast("long").alias(n) for x, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)))


def four_forms(det: DataFrame, width: float, height: float, names: DataFrame) -> DataFrame:
    """Detections as corners and as centre and size, in pixels and normalised, with class names."""
    p = Box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    c, n = to_centre(p), to_normalised(p, width, height)
    return det.join(F.broadcast(names), "class_id", "left").select("image_id", "det_id", F.coalesce("class_name", F.lit("unknown")).alias("class_name"), "x1", "y1", "x2", "y2", *c.named("x", "y", "w", "h"), *n.named("xn", "yn", "wn", "hn"))  # names: one row per class


def write_labels(rows: DataFrame, path: str) -> None:
    """Lines of rows(image_id, line) as text under one folder per image; an existing path is an error."""
    rows.select("image_id", "line").repartition("image_id").write.partitionBy("image_id").mode("errorifexists").text(path)


def write_files(files: DataFrame, root: str) -> int:
    """Files of files(path, content), path being below root, and how many; a file appears when it is whole."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                folder, _, name = f"{base}/{path}".rpartition("/")
                store.create_dir(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(bytes(content))
                store.move(part, f"{folder}/{name}")
            yield pd.DataFrame({"n": [len(b)]})

    return files.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_split_lists(paths: DataFrame, path: str) -> None:
    """Lines of paths(split, path) as text under one folder per split."""
    paths.select("split", F.col("path").alias("value")).write.partitionBy("split").mode("errorifexists").text(path)


def append_metrics(row: DataFrame, path: str) -> None:
    """Append a row of metrics to a Parquet log."""
    row.write.mode("append").parquet(path)


def append_metrics_csv(rows: DataFrame, path: str) -> None:
    """Append rows of metrics to a CSV log: each file has one header, so a reader with headers sees every row once and no header."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def nested_summary(counts: DataFrame) -> DataFrame:
    """One JSON text {split: {class: n}} of counts(split, class_id, n); splits x classes values."""
    per = counts.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("class_id").cast("string"), "n")))).alias("classes"))
    return per.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", F.to_json("classes")))))).alias("summary"))


def split_summary(counts: DataFrame) -> DataFrame:
    """As nested_summary, with objects inside the object instead of texts."""
    per = counts.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("class_id").cast("string"), "n")))).alias("classes"))
    in_order = F.array_sort(F.collect_list(F.struct("split", "classes")), lambda a, b: F.when(a["split"] < b["split"], -1).when(a["split"] > b["split"], 1).otherwise(0))
    return per.agg(F.to_json(F.map_from_entries(in_order)).alias("summary"))


def renamed_csv(df: DataFrame, names: dict[str, str], path: str) -> None:
    """CSV with localised column names."""
    df.withColumnsRenamed(names).write.option("header", True).mode("errorifexists").csv(path)


def append_generation(rows: DataFrame, folder: str, fitness: str, number: str) -> None:
    """Rows go to the log below folder; the fittest of all (of equals the first) is written beside it as lines of a mapping, after their number."""
    rows.write.mode("append").parquet(f"{folder}/log")
    log = rows.sparkSession.read.parquet(f"{folder}/log")
    best = log.agg(F.min_by(F.struct(*log.columns), F.struct((-F.col(fitness)).alias("f"), number)).alias("b"), F.count("*").alias("n"))
    lines = F.array(F.concat(F.lit("# generations: "), F.col("n").cast("string")), *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"b.{c}").cast("string"), F.lit("null"))) for c in log.columns))
    best.select(F.explode(lines).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/best")  # a few lines


def stats_json(images: DataFrame, labels: DataFrame, classes: int) -> DataFrame:
    """split and a JSON text of its instances (total, per class) and images (total, without labels, per class)."""
    per_image = labels.groupBy("image_id", "class_id").agg(F.count("*").alias("n"))
    found = images.select("image_id", "split").join(per_image, "image_id", "left")
    ids = range(classes)
    by_image = found.groupBy("split", "image_id").agg(*(F.coalesce(F.sum(F.when(F.col("class_id") == c, F.col("n"))), F.lit(0)).alias(f"n{c}") for c in ids), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    total = by_image.groupBy("split").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in ids), *(F.count_if(F.col(f"n{c}") > 0).alias(f"m{c}") for c in ids), F.count("*").alias("images"), F.count_if(F.col("n") == 0).alias("bare"))
    each = lambda k: F.array(*(F.col(f"{k}{c}") for c in ids))
    instances = F.struct(F.aggregate(each("n"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), each("n").alias("per_class"))
    pictures = F.struct(F.col("images").alias("total"), F.col("bare").alias("unlabelled"), each("m").alias("per_class"))
    return total.select("split", F.to_json(F.struct(instances.alias("instance_stats"), pictures.alias("image_stats"))).alias("stats"))
