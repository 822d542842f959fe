"""Queries of small operators, readers and writers, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.fixtures import fixture, table, with_sql
from boxlake.functions import boxes as B
from boxlake.functions import text as T
from boxlake.operators import dedup, evaluate, profile, runlog, validate
from boxlake.operators.scan import shared_path
from boxlake.plans.curation import NAMES
from boxlake.plans.evaluation import AP, CLASSES, GRID, CURVE, labels, rounded, scene
from boxlake.sources import annotations, sinks

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(NAMES[:-1])), "class_id long, class_name string")  # the last class has no name


_NAMES = "nm AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES[:-1])) + ") v(class_id, class_name))"


@query
def polygon_points(spark: SparkSession, d: str) -> DataFrame:
    """Corners of labels as shares of the image, in pixels of a padded canvas, and back on the image from there."""
    gt = fixture(spark, d, "gt")
    corners = F.array(*(F.struct(((F.col("cx") + a * F.col("w")) / 640).alias("x"), ((F.col("cy") + b * F.col("h")) / 480).alias("y")) for a, b in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5))))
    canvas = B.points_to_pixels(corners, 640.0, 480.0, 0.0, 80.0)
    both = gt.select("image_id", "label_id", canvas.alias("canvas")).withColumn("back", B.unletterbox_points(F.col("canvas"), 640.0, 640.0, F.lit(1280.0), F.lit(960.0), True))
    points = both.select("image_id", "label_id", F.posexplode(F.arrays_zip("canvas", "back")).alias("i", "p"))
    return points.select("image_id", "label_id", "i", *(F.round(F.col("p")[k][c], 9).alias(f"{k}_{c}") for k in ("canvas", "back") for c in ("x", "y")))


SQL["polygon_points"] = f"""{with_sql('gt')}, p AS (SELECT image_id, label_id, i, (cx + a * w) / 640 * 640e0 AS x, (cy + b * h) / 480 * 480e0 + 80e0 AS y FROM gt, (VALUES (0, -5e-1, -5e-1), (1, 5e-1, -5e-1), (2, 5e-1, 5e-1)) v(i, a, b))
SELECT image_id, label_id, i::INTEGER AS i, round(x, 9) AS canvas_x, round(y, 9) AS canvas_y, round(least(greatest(x / 5e-1, 0e0), 1280e0) / 1280, 9) AS back_x, round(least(greatest((y - 80) / 5e-1, 0e0), 960e0) / 960, 9) AS back_y FROM p"""


@query
def one_class_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of images with at least four, all in one class."""
    return profile.single_class(profile.with_min_items(fixture(spark, d, "gt"), 4)).select("image_id", "label_id", "class_id", "w", "h")


SQL["one_class_labels"] = f"{with_sql('gt')} SELECT image_id, label_id, 0::BIGINT AS class_id, w, h FROM gt QUALIFY count(*) OVER (PARTITION BY image_id) >= 4"


@query
def smallest_half(spark: SparkSession, d: str) -> DataFrame:
    """The smaller half of the labels of each image."""
    return profile.smallest_half(fixture(spark, d, "gt")).select("image_id", "label_id")


SQL["smallest_half"] = f"{with_sql('gt')} SELECT image_id, label_id FROM gt QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY w * h, label_id) <= round_even(count(*) OVER (PARTITION BY image_id) / 2e0, 0)"


@query
def class_maps(spark: SparkSession, d: str) -> DataFrame:
    """AP of each class over all thresholds; the mean for a class without labels (one more than there are)."""
    return rounded(evaluate.class_maps(evaluate.average_precision(*scene(spark, d)), CLASSES + 1), "map")


SQL["class_maps"] = f"{with_sql('det')}, {AP}, m AS (SELECT class_id, avg(ap) AS map FROM ap GROUP BY class_id) SELECT k AS class_id, round(coalesce(map, (SELECT avg(map) FROM m)), 9) AS map FROM range({CLASSES + 1}) r(k) LEFT JOIN m ON class_id = k"


@query
def class_report(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation of each class with its name."""
    lab, det = scene(spark, d)
    cells = evaluate.curve_cells(lab, det)
    return rounded(evaluate.class_report(evaluate.average_precision(lab, det, cells=cells), evaluate.operating_point(lab, det, cells=cells), _names(spark)), "precision", "recall", "f1", "ap50", "ap")


SQL["class_report"] = f"""{with_sql('det')}, {_NAMES}, {AP}, {GRID[len(CURVE) + 2:]}, a AS (SELECT class_id, max(ap) FILTER (WHERE thr = 0) AS ap50, avg(ap) AS ap FROM ap GROUP BY class_id)
SELECT op.class_id, coalesce(class_name, 'unknown') AS class_name, n_labels, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, tp, round_even(tp / (precision + 1e-16) - tp, 0) AS fp, round(ap50, 9) AS ap50, round(ap, 9) AS ap
FROM op JOIN a ON a.class_id = op.class_id LEFT JOIN nm ON nm.class_id = op.class_id"""


@query
def four_forms(spark: SparkSession, d: str) -> DataFrame:
    """Detections in four forms with class names."""
    out = sinks.four_forms(fixture(spark, d, "det"), 640.0, 480.0, _names(spark))
    return rounded(out, *(c for c in out.columns if c not in ("image_id", "det_id", "class_name")))


_ROUND9 = lambda **e: ", ".join(f"round({v}, 9) AS {k}" for k, v in e.items())
SQL["four_forms"] = f"""{with_sql('det')}, {_NAMES} SELECT image_id, det_id, coalesce(class_name, 'unknown') AS class_name,
{_ROUND9(x1='x1', y1='y1', x2='x2', y2='y2', x='(x1 + x2) / 2', y='(y1 + y2) / 2', w='x2 - x1', h='y2 - y1', xn='(x1 + x2) / 2 / 640', yn='(y1 + y2) / 2 / 480', wn='(x2 - x1) / 640', hn='(y2 - y1) / 480')} FROM det LEFT JOIN nm ON nm.class_id = det.class_id"""


@query
def localised_csv(spark: SparkSession, d: str) -> DataFrame:
    """Class counts as CSV with a byte order mark and other column names, read back under those."""
    counts = fixture(spark, d, "gt").groupBy("split", "class_id").agg(F.count("*").alias("n"))
    path = shared_path(spark, "csv")
    sinks.renamed_csv(counts, {"split": "划分", "class_id": "类别", "n": "数量"}, path)
    back = annotations.csv_without_bom(spark, path)
    return back.select(F.col("划分").alias("split"), F.col("类别").cast("long").alias("class_id"), F.col("数量").cast("long").alias("n"))


SQL["localised_csv"] = f"{with_sql('gt')} SELECT split, class_id, count(*) AS n FROM gt GROUP BY ALL"


@query
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    """Labels by split and class as one JSON text."""
    return sinks.split_summary(fixture(spark, d, "gt").groupBy("split", "class_id").agg(F.count("*").alias("n")))


SQL["split_summary"] = f"""{with_sql('gt')}, c AS (SELECT split, class_id, count(*) AS n FROM gt GROUP BY ALL), s AS (SELECT split, '{{' || string_agg('"' || class_id || '":' || n, ',' ORDER BY class_id::VARCHAR) || '}}' AS j FROM c GROUP BY split)
SELECT '{{' || string_agg('"' || split || '":' || j, ',' ORDER BY split) || '}}' AS summary FROM s"""


@query
def stats_json(spark: SparkSession, d: str) -> DataFrame:
    """Instances and images of each split as JSON: totals, unlabelled, per class."""
    return sinks.stats_json(fixture(spark, d, "images"), fixture(spark, d, "gt"), CLASSES)


SQL["stats_json"] = f"""{with_sql('images', 'gt')}, s AS (SELECT split, count(*) AS total, count(*) FILTER (WHERE image_id NOT IN (SELECT image_id FROM gt)) AS bare FROM images GROUP BY split),
c AS (SELECT s.split, k, count(label_id) AS n, count(DISTINCT gt.image_id) AS m FROM s CROSS JOIN range({CLASSES}) r(k) LEFT JOIN (gt JOIN images i ON i.image_id = gt.image_id) ON i.split = s.split AND class_id = k GROUP BY ALL),
l AS (SELECT split, sum(n)::BIGINT AS total, string_agg(n, ',' ORDER BY k) AS per, string_agg(m, ',' ORDER BY k) AS imgs FROM c GROUP BY split)
SELECT s.split, '{{"instance_stats":{{"total":' || l.total || ',"per_class":[' || per || ']}},"image_stats":{{"total":' || s.total || ',"unlabelled":' || bare || ',"per_class":[' || imgs || ']}}}}' AS stats FROM s JOIN l USING (split)"""


@query
def checked_references(spark: SparkSession, d: str) -> DataFrame:
    """Labels joined with their images, after the check that each has one."""
    images = fixture(spark, d, "images").select("image_id", "stem")
    return validate.assert_references(fixture(spark, d, "gt"), images, "image_id").groupBy("stem").agg(F.count("*").alias("n"))


SQL["checked_references"] = f"{with_sql('images', 'gt')} SELECT stem, count(*) AS n FROM gt JOIN images USING (image_id) GROUP BY stem"


@query
def inner_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between suppliers of a part, inside the suppliers of one nation in two."""
    pairs = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("a")).distinct()
    edges = pairs.join(pairs.withColumnRenamed("a", "b"), "l_partkey").where("a < b").select("a", "b").distinct()
    return dedup.inner_edges(edges, table(spark, d, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("node")))


SQL["inner_edges"] = "SELECT DISTINCT x.l_suppkey AS a, y.l_suppkey AS b FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey JOIN supplier s ON s.s_suppkey = x.l_suppkey AND s.s_nationkey % 2 = 0 JOIN supplier t ON t.s_suppkey = y.l_suppkey AND t.s_nationkey % 2 = 0"


@query
def version_check(spark: SparkSession, d: str) -> DataFrame:
    """Version texts made of three columns against a least version."""
    i = fixture(spark, d, "images").withColumn("version", F.concat_ws(".", F.col("image_id") % 3, F.col("width") % 12, F.col("height") % 30))
    return i.select("image_id", "version", T.version_at_least(F.col("version"), "1.9.10").alias("enough"))


SQL["version_check"] = f"{with_sql('images')} SELECT image_id, concat_ws('.', image_id % 3, width % 12, height % 30) AS version, [image_id % 3, width % 12, height % 30] >= [1, 9, 10] AS enough FROM images"


@query
def read_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of labels as a matrix of padded numbers, read back; broken lines are rows without numbers."""
    gt = fixture(spark, d, "gt")
    path = shared_path(spark, "matrix")
    gt.select(F.format_string("%12d   %6d %10.3f\t%10.3f  ", "image_id", "label_id", "w", "h").alias("value")).write.text(path)
    m = annotations.matrix(spark, path, ["image_id", "label_id", "w", "h"])
    return m.select(F.col("image_id").cast("long").alias("image_id"), F.col("label_id").cast("long").alias("label_id"), "w", "h")


SQL["read_matrix"] = f"{with_sql('gt')} SELECT image_id, label_id, w, h FROM gt"


@query
def evolve_log(spark: SparkSession, d: str) -> DataFrame:
    """Generations are appended in two turns; the best one is written beside the log, as lines of a mapping."""
    log = fixture(spark, d, "runlog").withColumn("fitness", F.round(runlog.fitness(F.col("precision_"), F.col("recall"), F.col("map50"), F.col("map")), 9)).select("epoch", "fitness", F.round("loss", 6).alias("loss"))
    folder = shared_path(spark, "evolve")
    for half in (log.where("epoch % 2 = 0"), log.where("epoch % 2 = 1")):
        sinks.append_generation(half, folder, "fitness", "epoch")
    return spark.read.text(f"{folder}/best").withColumnRenamed("value", "line")


SQL["evolve_log"] = f"""{with_sql('runlog')}, l AS (SELECT epoch, round(map50 * 1e-1 + map * 9e-1, 9) AS fitness, round(loss, 6) AS loss, count(*) OVER () AS n FROM runlog), b AS (SELECT * FROM l ORDER BY fitness DESC, epoch LIMIT 1)
SELECT unnest(['# generations: ' || n, 'epoch: ' || epoch, 'fitness: ' || fitness, 'loss: ' || loss]) AS line FROM b"""


@query
def image_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents are written as files of several kinds in folders by language; the image files among them are listed with their sizes."""
    kind = F.element_at(F.array(*map(F.lit, ("jpg", "PNG", "txt", "webp", "csv"))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL")
    files = docs.select(F.concat_ws("", F.coalesce("lang", F.lit("none")), F.lit("/"), "doc_id", F.lit("."), kind).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("content"))
    root = shared_path(spark, "images")
    sinks.write_files(files, root)
    found = annotations.image_paths(spark, root)
    return found.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("path"), "size")


SQL["image_scan"] = """SELECT coalesce(lang, 'none') || '/' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'PNG' ELSE 'webp' END AS path, strlen(coalesce(text, '')) + 1 AS size FROM documents WHERE doc_id % 5 IN (0, 1, 3)"""


@query
def strict_labels(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of labels written as lines and read strictly: the first bad line would stop it."""
    gt = fixture(spark, d, "gt")
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", F.col("cx") / 1000 + 0.1, F.col("cy") / 1000 + 0.1, F.col("w") / 1000, F.col("h") / 1000)
    return validate.require_valid(gt.select("image_id", F.col("label_id").alias("line_no"), line.alias("line")), CLASSES)


SQL["strict_labels"] = f"""{with_sql('gt')} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY label_id)::INTEGER AS line_number, class_id, round(cx / 1000 + 1e-1, 6) AS x, round(cy / 1000 + 1e-1, 6) AS y, round(w / 1000, 6) AS w, round(h / 1000, 6) AS h FROM gt"""
