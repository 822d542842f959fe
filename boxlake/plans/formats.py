"""Queries that write annotation formats from the fixtures and read them back, with SQL twins over the fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlake.fixtures import fixture, table, with_sql
from boxlake.functions import boxes as B
from boxlake.functions import text as T
from boxlake.operators import profile
from boxlake.operators.scan import shared_path
from boxlake.sources import annotations, sinks

Q: dict = {}
SQL: dict[str, str] = {}
#: images of one JSON document
PER_DOCUMENT = 500


def query(f):
    Q[f.__name__] = f
    return f


def as_text(df: DataFrame, name: str, *by: str) -> str:
    """The path under which df(value) now stands as text."""
    path = shared_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).text(path)
    return path


def said(*parts) -> Column:
    """A text of literals and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def nine(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("x", "y", "w", "h")})


def corners(gt: DataFrame) -> DataFrame:
    return gt.select("image_id", "label_id", "class_id", "w", "h", *B.to_corners(B.box("cx", "cy", "w", "h")).named("x1", "y1", "x2", "y2"))


def documents(gt: DataFrame) -> DataFrame:
    """gt with the number of its document."""
    return gt.withColumn("part", F.floor(F.col("image_id") / PER_DOCUMENT))


C = "c AS (SELECT image_id, label_id, class_id, w, h, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM gt)"
CLIPPED = "k AS (SELECT *, least(greatest(x1, 0), 640) AS a, least(greatest(y1, 0), 480) AS b, least(greatest(x2, 0), 640) AS c, least(greatest(y2, 0), 480) AS d FROM c)"
SHARES = "round((a + c) / 2 / 640, 9) AS x, round((b + d) / 2 / 480, 9) AS y, round((c - a) / 640, 9) AS w, round((d - b) / 480, 9) AS h"


@query
def read_voc(spark: SparkSession, d: str) -> DataFrame:
    """VOC XML with an annotation per image, PER_DOCUMENT of them in a file."""
    c = F.col
    one = said("<object><name>c", c("class_id"), "</name><difficult>", (c("label_id") % 5 == 0).cast("int"), "</difficult><bndbox><xmin>", c("x1"), "</xmin><ymin>", c("y1"), "</ymin><xmax>", c("x2"), "</xmax><ymax>", c("y2"), "</ymax></bndbox></object>")
    images = corners(fixture(spark, d, "gt")).groupBy("image_id").agg(F.array_join(F.collect_list(one), "").alias("objects"))  # the boxes of one image
    each = said("<annotation><filename>f", c("image_id"), "</filename><size><width>640</width><height>480</height></size>", c("objects"), "</annotation>")
    docs = documents(images).groupBy("part").agg(said("<set>", F.array_join(F.collect_list(each), ""), "</set>").alias("value"))
    return nine(annotations.voc(spark, as_text(docs, "voc", "part"), [f"c{i}" for i in range(5)]))


SQL["read_voc"] = f"""{with_sql('gt')}, {C} SELECT 'f' || image_id AS filename, class_id, round(((x1 + x2) / 2 - 1) / 640, 9) AS x, round(((y1 + y2) / 2 - 1) / 480, 9) AS y, round((x2 - x1) / 640, 9) AS w, round((y2 - y1) / 480, 9) AS h
FROM c WHERE label_id % 5 <> 0 AND class_id < 5"""


@query
def read_visdrone(spark: SparkSession, d: str) -> DataFrame:
    """Rows of left, top, width, height, score, category in a folder per stem."""
    c = F.col
    lines = corners(fixture(spark, d, "gt")).select(said("v", c("image_id") % 16).alias("stem"), said(c("x1"), ",", c("y1"), ",", c("w"), ",", c("h"), ",", c("label_id") % 4, ",", c("class_id") + 1, ",0,0").alias("value"))
    sizes = lines.select("stem").distinct().select("stem", F.lit(640.0).alias("width"), F.lit(480.0).alias("height"))
    return nine(annotations.visdrone(spark, as_text(lines, "visdrone", "stem"), sizes))


SQL["read_visdrone"] = f"{with_sql('gt')}, {C} SELECT 'v' || image_id % 16 AS stem, class_id, round((x1 + w / 2) / 640, 9) AS x, round((y1 + h / 2) / 480, 9) AS y, round(w / 640, 9) AS w, round(h / 480, 9) AS h FROM c WHERE label_id % 4 <> 0"


@query
def read_shelf_csv(spark: SparkSession, d: str) -> DataFrame:
    """CSV of corners with the image size in each row."""
    c = F.col
    lines = corners(fixture(spark, d, "gt")).select(said("i", c("image_id"), ".jpg,", c("x1"), ",", c("y1"), ",", c("x2"), ",", c("y2"), ",object,640,480").alias("value"))
    return nine(annotations.sku(spark, as_text(lines, "shelf")))


SQL["read_shelf_csv"] = f"{with_sql('gt')}, {C} SELECT 'i' || image_id || '.jpg' AS image, 0 AS class_id, round((x1 + x2) / 2 / 640, 9) AS x, round((y1 + y2) / 2 / 480, 9) AS y, round((x2 - x1) / 640, 9) AS w, round((y2 - y1) / 480, 9) AS h FROM c"


@query
def read_coco(spark: SparkSession, d: str) -> DataFrame:
    """COCO JSON, a document per line: images, annotations without crowds, categories; boxes clipped."""
    c = F.col
    gt = documents(corners(fixture(spark, d, "gt")))
    image = F.struct(c("image_id").alias("id"), said("im_", c("image_id"), ".jpg").alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    one = F.struct((c("image_id") * 10 + c("label_id")).alias("id"), "image_id", (100 + c("class_id") * 3).alias("category_id"), F.array("x1", "y1", "w", "h").alias("bbox"), (c("label_id") % 6 == 0).cast("int").alias("iscrowd"))
    kinds = F.array(*(F.struct(F.lit(100 + 3 * i).alias("id"), F.lit(f"kind {i}").alias("name")) for i in range(6)))
    docs = gt.groupBy("part").agg(F.to_json(F.struct(F.collect_set(image).alias("images"), F.collect_list(one).alias("annotations"), F.first(kinds).alias("categories"))).alias("value"))  # PER_DOCUMENT images
    return nine(annotations.coco(spark, as_text(docs.select("value"), "coco"), multi_line=False))


SQL["read_coco"] = f"{with_sql('gt')}, {C}, {CLIPPED} SELECT 'im_' || image_id || '.jpg' AS file_name, class_id::INTEGER AS class_id, 'kind ' || class_id AS class_name, {SHARES} FROM k WHERE label_id % 6 <> 0 AND c > a AND d > b"


@query
def read_argoverse(spark: SparkSession, d: str) -> DataFrame:
    """Driving JSON, a document per line: annotations refer to images and images to folders by place."""
    c = F.col
    gt = documents(corners(fixture(spark, d, "gt")))
    place = F.row_number().over(Window.partitionBy("part").orderBy("image_id")) - 1  # PER_DOCUMENT images
    images = gt.select("part", "image_id").distinct().withColumn("place", place)
    image = F.struct("place", c("image_id").alias("id"), said("im_", c("image_id"), ".jpg").alias("name"), (c("image_id") % 3).cast("int").alias("sid"))
    listed = images.groupBy("part").agg(F.array_sort(F.collect_list(image)).alias("images"))
    one = F.struct(c("place").alias("image_id"), c("class_id").alias("category_id"), F.array("x1", "y1", "w", "h").alias("bbox"))
    anns = gt.join(images, ["part", "image_id"]).groupBy("part").agg(F.collect_list(one).alias("annotations"))
    docs = listed.join(anns, "part").select(F.to_json(F.struct(F.array(F.lit("d0"), F.lit("d1"), F.lit("d2")).alias("seq_dirs"), "images", "annotations")).alias("value"))
    return nine(annotations.argoverse(spark, as_text(docs, "argoverse"), 640.0, 480.0, multi_line=False))


SQL["read_argoverse"] = f"{with_sql('gt')}, {C} SELECT 'd' || image_id % 3 || '/im_' || image_id || '.txt' AS label_path, class_id::INTEGER AS class_id, round((x1 + w / 2) / 640, 9) AS x, round((y1 + h / 2) / 480, 9) AS y, round(w / 640, 9) AS w, round(h / 480, 9) AS h FROM c"


@query
def read_xview(spark: SparkSession, d: str) -> DataFrame:
    """Overhead GeoJSON, a document per line: corners in a text, types looked up, one type rejected."""
    c = F.col
    gt = documents(corners(fixture(spark, d, "gt")))
    name = said("x", c("image_id"), ".tif")
    one = F.struct(F.struct(said(c("x1"), ",", c("y1"), ",", c("x2"), ",", c("y2")).alias("bounds_imcoords"), name.alias("image_id"), (c("class_id") + 10).alias("type_id")).alias("properties"))
    docs = gt.groupBy("part").agg(F.to_json(F.struct(F.collect_list(one).alias("features"))).alias("value"))
    sizes = gt.select(name.alias("image_id")).distinct().select("image_id", F.lit(640.0).alias("width"), F.lit(480.0).alias("height"))
    return nine(annotations.xview(spark, as_text(docs.select("value"), "xview"), [-1] * 10 + [0, 1, 2, -1, 4, 5], sizes, multi_line=False))


SQL["read_xview"] = f"{with_sql('gt')}, {C}, {CLIPPED} SELECT 'x' || image_id || '.tif' AS image_id, class_id::INTEGER AS class_id, {SHARES} FROM k WHERE class_id <> 3"


@query
def read_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Label files of polygons among label files of boxes: polygons with the box around them."""
    c = F.col
    gt = fixture(spark, d, "gt").withColumn("part", c("image_id") % 8)
    xs, ys = (c("cx") - c("w"), c("cx"), c("cx") + c("w"), c("cx")), (c("cy"), c("cy") - c("h"), c("cy"), c("cy") + c("h"))
    points = F.concat_ws(" ", *(F.concat_ws(" ", (x / 640).cast("string"), (y / 480).cast("string")) for x, y in zip(xs, ys, strict=True)))
    line = F.when(c("part") < 4, said(c("class_id"), " ", points)).otherwise(said(c("class_id"), " 0.5 0.5 0.25 0.25"))
    lines = annotations.yolo_lines(spark, as_text(gt.select("part", line.alias("value")), "polygons", "part"))
    return nine(annotations.polygons(lines)).select("class_id", F.size("points").alias("points"), "x", "y", "w", "h")


SQL["read_polygons"] = f"{with_sql('gt')} SELECT class_id, 4 AS points, round(cx / 640, 9) AS x, round(cy / 480, 9) AS y, round(2 * w / 640, 9) AS w, round(2 * h / 480, 9) AS h FROM gt WHERE image_id % 8 < 4"


@query
def class_folder_ids(spark: SparkSession, d: str) -> DataFrame:
    """Classes of files that lie in a folder per class."""
    o = table(spark, d, "orders").select(said("/data/train/", F.lower("o_orderstatus"), "_", F.col("o_custkey") % 40, "/", F.col("o_orderkey"), ".jpg").alias("path"))
    return annotations.class_folders(o)


SQL["class_folder_ids"] = """WITH p AS (SELECT lower(o_orderstatus) || '_' || o_custkey % 40 AS class_name, o_orderkey FROM orders)
SELECT '/data/train/' || class_name || '/' || o_orderkey || '.jpg' AS path, class_name, dense_rank() OVER (ORDER BY class_name) - 1 AS class_id FROM p"""


@query
def read_csv_with_mark(spark: SparkSession, d: str) -> DataFrame:
    """CSV with a byte order mark and padded names."""
    path = shared_path(spark, "marked")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("\ufefforder"), F.concat(F.lit("  "), F.col("o_orderstatus")).alias(" status "), F.col("o_custkey").alias("customer "))
    o.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return annotations.csv_without_bom(spark, path).select(F.col("order").cast("long").alias("order_id"), "status", F.col("customer").cast("long").alias("customer"))


SQL["read_csv_with_mark"] = "SELECT o_orderkey AS order_id, o_orderstatus AS status, o_custkey AS customer FROM orders"


@query
def split_lists(spark: SparkSession, d: str) -> DataFrame:
    """List files per split, written and read back with ./ as the folder of the list."""
    path = shared_path(spark, "lists")
    images = fixture(spark, d, "images")
    sinks.write_split_lists(images.select("split", F.concat(F.lit("./"), F.col("stem"), F.lit(".jpg")).alias("path")), path)
    per = [annotations.listed_paths(spark, f"{path}/split={s}").select(F.lit(s).alias("split"), F.substring_index("path", "/", -2).alias("path")) for s in ("train", "val", "test")]
    return per[0].unionByName(per[1]).unionByName(per[2]).withColumn("path", F.regexp_replace("path", "^lists-[0-9a-f]+/", ""))


SQL["split_lists"] = f"{with_sql('images')} SELECT split, stem || '.jpg' AS path FROM images"


@query
def label_text_files(spark: SparkSession, d: str) -> DataFrame:
    """Files per class of label lines, with image suffixes told apart and sizes of folders."""
    c = F.col
    gt = fixture(spark, d, "gt")
    root = as_text(gt.select("class_id", said(c("image_id"), " ", c("label_id"), " ", c("cx"), " ", c("cy")).alias("value")), "labels", "class_id")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root).select("path", F.col("length").alias("size"))
    return files.groupBy(F.regexp_extract("path", r"class_id=(\d+)", 1).cast("long").alias("class_id")).agg(F.sum("size").alias("bytes"))


SQL["label_text_files"] = f"{with_sql('gt')} SELECT class_id, sum(strlen(image_id || ' ' || label_id || ' ' || cx || ' ' || cy) + 1)::BIGINT AS bytes FROM gt GROUP BY class_id"


@query
def mean_and_std(spark: SparkSession, d: str) -> DataFrame:
    out = profile.mean_and_std(fixture(spark, d, "gt"), "cx", "cy", "w", "h")
    return out.select("name", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


SQL["mean_and_std"] = f"{with_sql('gt')} " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM gt" for c in ("cx", "cy", "w", "h"))


@query
def shared_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of one table of weights whose name and shape another one has."""
    p = table(spark, d, "part").select(F.col("p_name").alias("key"), F.array((F.col("p_partkey") % 4).cast("int"), F.col("p_size").cast("int")).alias("shape"), F.col("p_partkey").alias("value"))
    other = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_name").alias("key"), F.array((F.col("p_partkey") % 4).cast("int"), (F.col("p_size") + (F.col("p_partkey") % 5 == 0).cast("int")).cast("int")).alias("shape"))
    return profile.shared_entries(p, other, ("9",)).select("key", "value")


SQL["shared_entries"] = """SELECT p_name AS key, p_partkey AS value FROM part p WHERE NOT contains(p_name, '9') AND EXISTS
(SELECT 1 FROM part q WHERE q.p_partkey % 3 <> 0 AND q.p_name = p.p_name AND q.p_partkey % 4 = p.p_partkey % 4 AND q.p_size + (q.p_partkey % 5 = 0)::INT = p.p_size)"""


@query
def names_and_dates(spark: SparkSession, d: str) -> DataFrame:
    """Output names per frame, ages and dates of files, addresses told from other texts."""
    e = table(spark, d, "orders")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    when = F.col("o_orderdate").cast("timestamp")
    address = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("rtsp://cam"), F.col("o_custkey").cast("string"), F.lit("/live"))).when(F.col("o_orderkey") % 3 == 1, F.lit("https:///nowhere")).otherwise(F.lit("0"))
    return e.select("o_orderkey", T.frame_name(F.concat(F.lit("clip"), F.col("o_custkey").cast("string")), F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("name"), T.age_in_days(when, now).alias("days"), T.plain_date(when).alias("day"), T.is_url(address).alias("is_url"))


SQL["names_and_dates"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'clip' || o_custkey ELSE 'clip' || o_custkey || '_' || o_orderkey END AS name,
floor((epoch(TIMESTAMP '2024-01-01') - epoch(o_orderdate::TIMESTAMP)) / 86400)::BIGINT AS days, year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) AS day, o_orderkey % 3 = 0 AS is_url FROM orders"""


@query
def mosaic9_labels(spark: SparkSession, d: str) -> DataFrame:
    """Nine images around the first on a canvas of three times the size, cut to twice the size, boxes moved and clipped."""
    c, s = F.col, 640.0
    gt = fixture(spark, d, "gt")
    tiles = gt.select("image_id").distinct().select("image_id", F.floor(c("image_id") / 9).alias("mosaic"), (c("image_id") * 37 % 320 + 320).cast("double").alias("tw"), (c("image_id") * 53 % 240 + 240).cast("double").alias("th"))
    w = Window.partitionBy("mosaic").orderBy("image_id")  # nine at most
    tiles = tiles.withColumns({"place": (F.row_number().over(w) - 1).cast("int"), "w0": F.first("tw").over(w), "h0": F.first("th").over(w), "wp": F.coalesce(F.lag("tw").over(w), F.lit(-1.0)), "hp": F.coalesce(F.lag("th").over(w), F.lit(-1.0))})
    x, y = B.mosaic9_pad(c("place"), c("tw"), c("th"), c("w0"), c("h0"), c("wp"), c("hp"), s)
    j = gt.join(tiles.withColumns({"px": x - 200.0, "py": y - 300.0}), "image_id")
    p = B.to_corners(B.Box(c("cx") / 640 * c("tw"), c("cy") / 480 * c("th"), c("w") / 640 * c("tw"), c("h") / 480 * c("th")))
    moved = B.clip(B.Box(p.a + c("px"), p.b + c("py"), p.c + c("px"), p.d + c("py")), 2 * s, 2 * s)
    return j.select("mosaic", "image_id", "label_id", *(F.round(v, 9).alias(n) for v, n in zip(moved, ("x1", "y1", "x2", "y2"), strict=True)))


SQL["mosaic9_labels"] = f"""{with_sql('gt')}, t AS (SELECT DISTINCT image_id, image_id // 9 AS mosaic, (image_id * 37 % 320 + 320)::DOUBLE AS tw, (image_id * 53 % 240 + 240)::DOUBLE AS th FROM gt),
u AS (SELECT *, row_number() OVER m AS p, first_value(tw) OVER m AS w0, first_value(th) OVER m AS h0, coalesce(lag(tw) OVER m, -1) AS wp, coalesce(lag(th) OVER m, -1) AS hp FROM t WINDOW m AS (PARTITION BY mosaic ORDER BY image_id)),
o AS (SELECT *, [640, 640, 640 + wp, 640 + w0, 640 + w0, 640 + w0 - tw, 640 + w0 - wp - tw, 640 - tw, 640 - tw][p] - 200 AS px, [640, 640 - th, 640 - th, 640, 640 + hp, 640 + h0, 640 + h0, 640 + h0 - th, 640 + h0 - hp - th][p] - 300 AS py FROM u)
SELECT mosaic, image_id, label_id, round(least(greatest(cx / 640 * tw - w / 640 * tw / 2 + px, 0), 1280), 9) AS x1, round(least(greatest(cy / 480 * th - h / 480 * th / 2 + py, 0), 1280), 9) AS y1,
round(least(greatest(cx / 640 * tw + w / 640 * tw / 2 + px, 0), 1280), 9) AS x2, round(least(greatest(cy / 480 * th + h / 480 * th / 2 + py, 0), 1280), 9) AS y2 FROM gt JOIN o USING (image_id)"""


@query
def metrics_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of metrics to which rows are appended twice, with one header for the reader, and the nested class counts as JSON."""
    path = shared_path(spark, "metrics")
    runs = fixture(spark, d, "runlog")
    for part in (runs.where("epoch < 100"), runs.where("epoch >= 100")):
        sinks.append_metrics_csv(part.select("epoch", F.round("loss", 6).alias("loss"), "map50"), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("epoch").cast("long"), F.col("loss").cast("double"), F.col("map50").cast("double"))


SQL["metrics_log"] = f"{with_sql('runlog')} SELECT epoch, round(loss, 6) AS loss, map50 FROM runlog"
