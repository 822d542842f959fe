"""Non-maximum suppression and what leads up to it.

A group (image, class) is bounded by max_candidates before it is folded: the
fold keeps a box unless a kept one overlaps it too much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions.boxes import Box, iou


def _of(x: Column) -> Box:
    return Box(x["x1"], x["y1"], x["x2"], x["y2"])


def top_candidates(det: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most confident rows of each group; ties go to the smaller det_id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("conf"), "det_id")
    return det.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k).drop("__rank")


def nms(det: DataFrame, conf: float = 0.25, threshold: float = 0.45, agnostic: bool = False, classes: list[int] | None = None, max_candidates: int = 30_000, max_det: int = 300) -> DataFrame:
    """image_id, det_id, class_id, conf of the rows of det(image_id, det_id, class_id, conf, x1..y2) that stay."""
    rows = det.where(F.col("conf") > conf)
    if classes is not None:
        rows = rows.where(F.col("class_id").isin(classes))
    rows = top_candidates(rows, ["image_id"], max_candidates)
    keys = ["image_id"] if agnostic else ["image_id", "class_id"]
    fields = F.struct((-F.col("conf")).alias("order"), "det_id", "class_id", "conf", "x1", "y1", "x2", "y2")
    groups = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(fields)).alias("boxes"))
    done = lambda acc: F.size(acc) >= max_det  # noqa: E731  later boxes of a group are past the limit of its image, too
    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda acc, b: F.when(done(acc) | F.exists(acc, lambda a: iou(_of(a), _of(b), 0.0) > threshold), acc).otherwise(F.array_append(acc, b)))
    out = groups.select("image_id", F.explode(kept).alias("b")).select("image_id", "b.det_id", "b.class_id", "b.conf")
    return top_candidates(out, ["image_id"], max_det)


def padded_nms(det: DataFrame, top_k: int = 8, **settings) -> DataFrame:
    """Class-agnostic suppression with exactly top_k slots per image; empty slots have class -1 and confidence 0."""
    kept = nms(det, agnostic=True, max_det=top_k, **settings)
    boxes = kept.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("order"), "det_id", "class_id", "conf"))).alias("b"))
    images = det.select("image_id").distinct().join(boxes, "image_id", "left")
    slots = images.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(top_k - 1))))
    at = F.get("b", F.col("slot"))
    return slots.select("image_id", "slot", F.coalesce(at["class_id"], F.lit(-1).cast("long")).alias("class_id"), F.coalesce(at["conf"], F.lit(0.0)).alias("conf"))


def merged(det: DataFrame, kept: DataFrame, threshold: float = 0.45, redundant: bool = True) -> DataFrame:
    """Kept boxes replaced by the mean of all boxes of their class that overlap them, weighted by confidence; lone ones go if redundant."""
    k = kept.select("image_id", F.col("det_id").alias("kept_id"), "class_id").join(det.select("image_id", F.col("det_id").alias("kept_id"), *(F.col(c).alias(f"k{c}") for c in ("x1", "y1", "x2", "y2"))), ["image_id", "kept_id"])
    pairs = k.join(det, ["image_id", "class_id"]).where(iou(Box(F.col("kx1"), F.col("ky1"), F.col("kx2"), F.col("ky2")), Box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))) > threshold)
    mean = lambda c: (F.sum(F.col("conf") * F.col(c)) / F.sum("conf")).alias(c)
    out = pairs.groupBy("image_id", "kept_id").agg(F.count("*").alias("n"), *(mean(c) for c in ("x1", "y1", "x2", "y2")))
    return out.where("n > 1") if redundant else out


def expand_classes(raw: DataFrame, conf: float, multi_label: bool = True) -> DataFrame:
    """One row per class whose obj * score exceeds conf, or the best class only; raw has (cand_id, obj, scores array)."""
    live = raw.where(F.col("obj") > conf).withColumn("scores", F.transform("scores", lambda s: s * F.col("obj")))
    if multi_label:
        out = live.select("image_id", "cand_id", F.posexplode("scores").alias("class_id", "conf"))
    else:
        out = live.select("image_id", "cand_id", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("class_id"), F.array_max("scores").alias("conf"))
    return out.where(F.col("conf") > conf)


def agreed(det: DataFrame, second: DataFrame) -> DataFrame:
    """Detections whose class a second classifier(image_id, det_id, class_id) confirms."""
    return det.join(second.select("image_id", "det_id", "class_id"), ["image_id", "det_id", "class_id"], "left_semi")
