"""Label text to boxes, with every problem as a row instead of an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.operators.scan import written


def parsed(lines: DataFrame) -> DataFrame:
    """lines(image_id, line_no, line) with tokens and, where they are numbers, class_value and x, y, w, h."""
    tokens = F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t != "")
    out = lines.withColumn("tokens", tokens)
    value = lambda i: F.expr(f"try_cast(get(tokens, {i}) AS DOUBLE)")
    return out.withColumns({"n_tokens": F.size("tokens"), "class_value": value(0), "x": value(1), "y": value(2), "w": value(3), "h": value(4)})


def line_tests(classes: int) -> tuple[Column, Column]:
    """Of a parsed line: the issues that it has by itself, and whether it is a box of a whole class."""
    five = F.col("n_tokens") == 5
    number = five & F.col("class_value").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("w").isNotNull() & F.col("h").isNotNull()
    whole = number & (F.col("class_value") == F.floor("class_value"))
    x, y, w, h = (F.col(c) for c in "xywh")
    inside = (x >= 0) & (x <= 1) & (y >= 0) & (y <= 1) & (w > 0) & (w <= 1) & (h > 0) & (h <= 1)
    crosses = (x - w / 2 < 0) | (x + w / 2 > 1) | (y - h / 2 < 0) | (y + h / 2 > 1)
    tests = {
        "invalid_column_count": ~five, "non_numeric_label": five & ~number, "non_integer_class": number & ~whole,
        "coordinate_out_of_range": whole & ~inside, "box_crosses_boundary": whole & inside & crosses, "class_out_of_range": whole & ((F.col("class_value") < 0) | (F.col("class_value") >= classes)),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items()))), whole


def label_issues(lines: DataFrame, classes: int) -> DataFrame:
    """image_id, line_no, issue; a line may have several."""
    rows = parsed(lines)
    found, whole = line_tests(classes)
    issues = rows.select("image_id", "line_no", F.explode(found).alias("issue"))
    again = rows.where(whole).withColumn("nth", F.row_number().over(Window.partitionBy("image_id", "class_value", "x", "y", "w", "h").orderBy("line_no"))).where("nth > 1")
    return issues.unionByName(again.select("image_id", "line_no", F.lit("duplicate_box").alias("issue")))


def kept_boxes(lines: DataFrame) -> DataFrame:
    """Boxes of lines that parse; line_number counts the kept lines of an image, out-of-range boxes stay."""
    ok = parsed(lines).where("n_tokens = 5 AND class_value = floor(class_value) AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL")
    return ok.select("image_id", F.row_number().over(Window.partitionBy("image_id").orderBy("line_no")).alias("line_number"), F.col("class_value").cast("long").alias("class_id"), "x", "y", "w", "h")


def strict_report(images: DataFrame, lines: DataFrame, least_side: int = 10) -> DataFrame:
    """Per image a status - missing, empty, corrupt or found - and the number of distinct boxes."""
    rows = parsed(lines)
    bad = (F.col("n_tokens") != 5) | F.col("class_value").isNull() | F.least("class_value", "x", "y", "w", "h").isNull() | (F.least("class_value", "x", "y", "w", "h") < 0) | (F.greatest("x", "y", "w", "h") > 1) | (F.col("class_value") != F.floor("class_value"))
    per = rows.groupBy("image_id").agg(F.max(bad.cast("int")).alias("bad"), F.count_distinct("class_value", "x", "y", "w", "h").alias("boxes"))
    out = images.select("image_id", "width", "height").join(per, "image_id", "left")
    status = F.when((F.col("width") < least_side) | (F.col("height") < least_side) | (F.col("bad") == 1), "corrupt").when(F.col("boxes").isNull(), "missing").when(F.col("boxes") == 0, "empty").otherwise("found")
    return out.select("image_id", status.alias("status"), F.coalesce("boxes", F.lit(0)).alias("boxes"))


def pairing(images: DataFrame, labels: DataFrame) -> DataFrame:
    """path and kind of the images without a label file and of the label files without an image; both tables hold key and path."""
    both = images.select("key", F.col("path").alias("image_path")).join(labels.select("key", F.col("path").alias("label_path")), "key", "full_outer")
    return both.where("image_path IS NULL OR label_path IS NULL").select(F.coalesce("image_path", "label_path").alias("path"), F.when(F.col("label_path").isNull(), "missing_label").otherwise("orphan_label").alias("issue"))


def assert_empty(problems: DataFrame, what: str) -> None:
    """A gate: raises if a post-condition query has rows."""
    first = problems.limit(3).collect()
    if first:
        raise ValueError(f"{what}: {[r.asDict() for r in first]}")


def require_valid(lines: DataFrame, classes: int) -> DataFrame:
    """Boxes of lines; raises if any line has an issue.

    Lines are parsed once: issues and boxes are found in one pass over the lines
    of each image and written down, then the issues are looked at.
    """
    found, whole = line_tests(classes)
    values = "class_value", "x", "y", "w", "h"
    rows = parsed(lines).select("image_id", "line_no", *values, found.alias("found"), whole.alias("whole"))
    rows = rows.withColumn("line_number", F.row_number().over(Window.partitionBy("image_id").orderBy("line_no")))
    nth = F.row_number().over(Window.partitionBy("image_id", *values, "whole").orderBy("line_no"))
    again = F.when(F.col("whole") & (nth > 1), F.array(F.lit("duplicate_box"))).otherwise(F.array().cast("array<string>"))
    rows = written(rows.select("image_id", "line_no", "line_number", F.col("class_value").cast("long").alias("class_id"), *values[1:], F.concat("found", again).alias("issues")))
    assert_empty(rows.where(F.size("issues") > 0).select("image_id", "line_no", F.explode("issues").alias("issue")), "label issues")
    return rows.select("image_id", "line_number", "class_id", *values[1:])


def assert_references(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """rows joined with other; raises if a key of rows is missing there."""
    assert_empty(rows.join(other, key, "left_anti").select(key), f"{key} without a match")
    return rows.join(other, key)
