"""Readers of annotation formats: each gives boxes as normalised centre and size.

All read through Spark, so any store that Spark reaches will do, and a file is
split, pushed down and pruned as its format allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlake.functions.boxes import Box, clip, to_normalised
from boxlake.functions.text import class_folder, extension, stem

#: fixed values: image suffixes that are read
IMAGE_FORMATS = ["bmp", "dng", "jpeg", "jpg", "mpo", "png", "tif", "tiff", "webp", "pfm"]


def image_paths(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified of the image files below root, without their contents; Spark's scan passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.where(extension(F.col("path")).isin(IMAGE_FORMATS))


def listed_paths(spark: SparkSession, list_file: str) -> DataFrame:
    """path of the lines of a list file; ./ is the folder of the list."""
    parent = list_file.rsplit("/", 1)[0] + "/"
    return spark.read.text(list_file).where(F.length(F.trim("value")) > 0).select(F.regexp_replace(F.trim("value"), r"^\./", parent).alias("path"))


def yolo_lines(spark: SparkSession, root: str) -> DataFrame:
    """path, line_no, line of the label files below root; empty lines go.  Files are small: one row each, then exploded."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", F.input_file_name().alias("path"))
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("i", "line"))
    return lines.where(F.length(F.trim("line")) > 0).select("path", (F.col("i") + 1).cast("long").alias("line_no"), F.trim("line").alias("line"))


def polygons(lines: DataFrame) -> DataFrame:
    """Lines with more than six tokens as polygons, with the box around them; a file with one such line is all polygons."""
    t = lines.withColumn("t", F.split("line", r"\s+"))
    t = t.withColumn("is_segment", F.max((F.size("t") > 6).cast("int")).over(Window.partitionBy("path")) == 1).where("is_segment")
    xy = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 2).cast("int") - 1), lambda i: F.struct(F.get("t", i * 2 + 1).cast("double").alias("x"), F.get("t", i * 2 + 2).cast("double").alias("y")))
    p = t.select("path", "line_no", F.get("t", F.lit(0)).cast("double").cast("long").alias("class_id"), xy.alias("points"))
    x, y = F.transform("points", lambda q: q["x"]), F.transform("points", lambda q: q["y"])
    lo_x, hi_x, lo_y, hi_y = F.array_min(x), F.array_max(x), F.array_min(y), F.array_max(y)
    return p.select("*", ((lo_x + hi_x) / 2).alias("x"), ((lo_y + hi_y) / 2).alias("y"), (hi_x - lo_x).alias("w"), (hi_y - lo_y).alias("h"))


def voc(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """VOC XML: objects that are not difficult and of a known class; centres carry the format's one-pixel shift."""
    schema = "filename string, size struct<width: double, height: double>, object array<struct<name: string, difficult: int, bndbox: struct<xmin: double, xmax: double, ymin: double, ymax: double>>>"
    docs = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    o = docs.select("filename", "size", F.explode("object").alias("o")).where(F.coalesce(F.col("o.difficult"), F.lit(0)) != 1)
    cls = F.array_position(F.array(*map(F.lit, names)), F.col("o.name")) - 1
    b = F.col("o.bndbox")
    return o.withColumn("class_id", cls).where("class_id >= 0").select(
        "filename", "class_id", (((b["xmin"] + b["xmax"]) / 2 - 1) / F.col("size.width")).alias("x"), (((b["ymin"] + b["ymax"]) / 2 - 1) / F.col("size.height")).alias("y"),
        ((b["xmax"] - b["xmin"]) / F.col("size.width")).alias("w"), ((b["ymax"] - b["ymin"]) / F.col("size.height")).alias("h"),
    )


def visdrone(spark: SparkSession, path: str, sizes: DataFrame) -> DataFrame:
    """Rows left,top,width,height,score,category,...: ignored regions (score 0) go, categories count from 0; sizes(stem, width, height)."""
    rows = spark.read.schema("bx double, by double, bw double, bh double, score int, category int, truncation int, occlusion int").csv(path)
    if "stem" not in rows.columns:  # a folder stem=... says it, too
        rows = rows.withColumn("stem", stem(F.input_file_name()))
    j = rows.where("score <> 0").join(sizes, "stem")
    return j.select("stem", (F.col("category") - 1).alias("class_id"), ((F.col("bx") + F.col("bw") / 2) / F.col("width")).alias("x"), ((F.col("by") + F.col("bh") / 2) / F.col("height")).alias("y"), (F.col("bw") / F.col("width")).alias("w"), (F.col("bh") / F.col("height")).alias("h"))


def sku(spark: SparkSession, path: str) -> DataFrame:
    """Shelf CSV without header: one class, corners in pixels with the image size in each row."""
    rows = spark.read.schema("image string, x1 double, y1 double, x2 double, y2 double, category string, width double, height double").csv(path)
    b = to_normalised(Box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), F.col("width"), F.col("height"))
    return rows.select("image", F.lit(0).alias("class_id"), *b.named("x", "y", "w", "h"))


def coco(spark: SparkSession, path: str, do_clip: bool = True, multi_line: bool = True) -> DataFrame:
    """COCO JSON: images, annotations and categories joined; class is the place of the category in its list.

    One document per file, or one per line; documents share image ids and the list of categories.
    """
    schema = "images array<struct<id: long, file_name: string, width: double, height: double>>, annotations array<struct<id: long, image_id: long, category_id: long, bbox: array<double>, iscrowd: int>>, categories array<struct<id: long, name: string>>"
    doc = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.*").withColumnRenamed("id", "img")
    cats = doc.select(F.posexplode("categories").alias("class_id", "c")).select("class_id", F.col("c.id").alias("cat"), F.col("c.name").alias("class_name")).distinct()
    anns = doc.select(F.explode("annotations").alias("a")).select("a.*").where(F.coalesce("iscrowd", F.lit(0)) == 0)
    j = anns.join(images, F.col("image_id") == F.col("img")).join(F.broadcast(cats), F.col("category_id") == F.col("cat"))  # one row per category
    corners = Box(F.col("bbox")[0], F.col("bbox")[1], F.col("bbox")[0] + F.col("bbox")[2], F.col("bbox")[1] + F.col("bbox")[3])
    b = to_normalised(clip(corners, F.col("width"), F.col("height")) if do_clip else corners, F.col("width"), F.col("height"))
    return j.select("file_name", "class_id", "class_name", *b.named("x", "y", "w", "h")).where("w > 0 AND h > 0")


def argoverse(spark: SparkSession, path: str, width: float = 1920.0, height: float = 1200.0, multi_line: bool = True) -> DataFrame:
    """Driving JSON: annotations refer to images, images to folders, both by place in their document."""
    schema = "seq_dirs array<string>, images array<struct<id: long, name: string, sid: int>>, annotations array<struct<image_id: int, category_id: int, bbox: array<double>>>"
    doc = spark.read.schema(schema).option("multiLine", multi_line).json(path)

    def placed(a: Column) -> Column:
        image = F.get("images", a["image_id"])
        return F.struct(a["category_id"].alias("class_id"), a["bbox"].alias("bbox"), image["name"].alias("name"), F.get("seq_dirs", image["sid"]).alias("dir"))

    a = doc.select(F.explode(F.transform("annotations", placed)).alias("a")).select("a.*").where("name IS NOT NULL AND dir IS NOT NULL")
    x, y, w, h = (F.col("bbox")[i] for i in range(4))
    return a.select(F.concat_ws("/", "dir", F.concat(stem(F.col("name")), F.lit(".txt"))).alias("label_path"), "class_id", ((x + w / 2) / width).alias("x"), ((y + h / 2) / height).alias("y"), (w / width).alias("w"), (h / height).alias("h"))


def xview(spark: SparkSession, path: str, lookup: list[int], sizes: DataFrame, multi_line: bool = True) -> DataFrame:
    """Overhead GeoJSON: corners in a text property, types looked up (-1 is rejected), clipped to the image."""
    schema = "features array<struct<properties: struct<bounds_imcoords: string, image_id: string, type_id: int>>>"
    doc = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    p = doc.select(F.explode("features").alias("f")).select("f.properties.*").where("length(bounds_imcoords) > 0")
    c = F.transform(F.split("bounds_imcoords", ","), lambda v: v.cast("double"))
    p = p.withColumns({"c": c, "class_id": F.element_at(F.array(*map(F.lit, lookup)), F.col("type_id") + 1)}).where("class_id BETWEEN 0 AND 59").join(sizes, "image_id")
    b = to_normalised(clip(Box(*(F.col("c")[i] for i in range(4))), F.col("width"), F.col("height")), F.col("width"), F.col("height"))
    return p.select("image_id", "class_id", *b.named("x", "y", "w", "h"))


def class_folders(paths: DataFrame) -> DataFrame:
    """path, class_name, class_id of paths(path) laid out as one folder per class; ids follow the order of names."""
    named = paths.withColumn("class_name", class_folder(F.col("path")))
    names = named.select("class_name").distinct().withColumn("class_id", F.row_number().over(Window.orderBy("class_name")) - 1)  # one row per class
    return named.join(F.broadcast(names), "class_name").select("path", "class_name", "class_id")


def csv_without_bom(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV with a header; a byte order mark before the first name and spaces around names go."""
    df = spark.read.options(header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options).csv(path)
    return df.toDF(*(c.replace("\ufeff", "").strip() for c in df.columns))


def matrix(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Numbers between spaces or tabs, a row for each line that isn't blank; null where a line has no number."""
    line = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("t")).where("t[0] <> ''")
    return line.select(*(F.get("t", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)))


def upright_images(spark: SparkSession, root: str) -> DataFrame:
    """path, width, height, channels, pixels of images that the JVM decodes (blue, green, red order)."""
    img = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    return img.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))
