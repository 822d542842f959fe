"""Deterministic annotation tables derived from the driver's TPC-H-like tables.

The SQL below runs unchanged in Spark and in DuckDB, so that a query and its
SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: labelled boxes on 640 x 480 images: centre and size in pixels
GT = """
SELECT image_id, label_id, pk % 6 AS class_id, CASE WHEN image_id % 10 = 0 THEN 'val' WHEN image_id % 10 = 1 THEN 'test' ELSE 'train' END AS split,
       CAST(60 + (image_id * 7919 + label_id * 104729) % 520 AS DOUBLE) AS cx, CAST(50 + (image_id * 6007 + label_id * 3571) % 380 AS DOUBLE) AS cy,
       CAST(12 + (pk * 31 + label_id * 17) % 180 AS DOUBLE) AS w, CAST(10 + (sk * 29 + label_id * 13) % 150 AS DOUBLE) AS h
FROM (SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS label_id, max(l_partkey) AS pk, max(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey, l_linenumber) g
"""

#: detections: jittered labels, doubles of some, and some false alarms
DET = """
SELECT image_id, det_id, class_id, conf, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM (
  SELECT image_id, label_id * 3 AS det_id, CASE WHEN k % 17 = 0 THEN (class_id + 1) % 6 ELSE class_id END AS class_id, CAST((k * 37) % 997 + 1 AS DOUBLE) / 1000 AS conf,
         cx + (k * 3) % 15 - 7 AS cx, cy + (k * 5) % 13 - 6 AS cy, w * (9e-1 + (k % 5) * 5e-2) AS w, h * (92e-2 + (k % 7) * 3e-2) AS h
  FROM (SELECT *, image_id * 131 + label_id * 71 AS k FROM gt) a WHERE k % 13 <> 0
  UNION ALL
  SELECT image_id, label_id * 3 + 1, class_id, CAST((k * 53) % 499 + 1 AS DOUBLE) / 1000, cx + (k * 7) % 9 - 4, cy + (k * 11) % 9 - 4, w, h * (k % 3 + 9) / 10
  FROM (SELECT *, image_id * 131 + label_id * 71 AS k FROM gt) b WHERE k % 5 = 0
  UNION ALL
  SELECT image_id, label_id * 3 + 2, (class_id + 2) % 6, CAST((k * 29) % 701 + 1 AS DOUBLE) / 1000, CAST(40 + (k * 17) % 560 AS DOUBLE), CAST(40 + (k * 19) % 400 AS DOUBLE), CAST(20 + k % 90 AS DOUBLE), CAST(20 + k % 70 AS DOUBLE)
  FROM (SELECT *, image_id * 131 + label_id * 71 AS k FROM gt) c WHERE k % 9 = 0) d
"""

#: images with sizes, quality figures and paths
IMAGES = """
SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 10 = 0 THEN 'val' WHEN o_orderkey % 10 = 1 THEN 'test' ELSE 'train' END AS split,
       320 + (o_orderkey * 37) % 1600 AS width, 240 + (o_orderkey * 53) % 1000 AS height, 1 + o_orderkey % 8 AS orientation,
       concat('/data/', CASE WHEN o_orderkey % 10 = 0 THEN 'val' WHEN o_orderkey % 10 = 1 THEN 'test' ELSE 'train' END, '/images/', lower(o_orderstatus), '_', CAST(o_custkey % 40 AS VARCHAR(20)), '_', CAST(o_orderkey AS VARCHAR(20)), '.JPG') AS path,
       concat(lower(o_orderstatus), '_', CAST(o_custkey % 40 AS VARCHAR(20)), '_', CAST(o_orderkey AS VARCHAR(20))) AS stem,
       CAST((o_orderkey * 91) % 2560 AS DOUBLE) / 10 AS brightness, CAST((o_orderkey * 17) % 100 AS DOUBLE) / 1000 AS overexposed, CAST((o_orderkey * 13) % 100 AS DOUBLE) / 1000 AS underexposed,
       o_totalprice AS sharpness
FROM orders
"""

#: raw label lines of text, one in some dozens broken in one way or another
LINES = """
SELECT image_id, label_id AS line_no, CASE
  WHEN k % 41 = 0 THEN concat(CAST(class_id AS VARCHAR(20)), ' 0.5 0.5 0.1')
  WHEN k % 43 = 0 THEN concat('x', CAST(class_id AS VARCHAR(20)), ' 0.5 0.5 0.1 0.1')
  WHEN k % 47 = 0 THEN concat(CAST(class_id AS VARCHAR(20)), '.5 0.5 0.5 0.1 0.1')
  WHEN k % 37 = 0 THEN concat(CAST(class_id AS VARCHAR(20)), ' 1.25 0.5 0.1 0.1')
  WHEN k % 31 = 0 THEN concat(CAST(class_id AS VARCHAR(20)), ' 0.95 0.5 0.25 0.125')
  WHEN k % 29 = 0 THEN '0 0.5 0.5 0.25 0.25'
  WHEN k % 23 = 0 THEN concat(CAST(class_id + 90 AS VARCHAR(20)), ' 0.5 0.5 0.125 0.125')
  ELSE concat(CAST(class_id AS VARCHAR(20)), ' 0.', CAST(250 + k % 500 AS VARCHAR(20)), ' 0.', CAST(250 + (k * 7) % 500 AS VARCHAR(20)), ' 0.125 0.25') END AS line
FROM (SELECT image_id, label_id, class_id, (image_id * 131 + label_id * 71) % 100003 AS k FROM gt) g
"""

#: epochs of a training run: one row per epoch with metrics
RUNLOG = """
SELECT epoch, avg_value AS loss, CAST((epoch * 7919) % 1000 AS DOUBLE) / 1000 AS precision_, CAST((epoch * 104729) % 1000 AS DOUBLE) / 1000 AS recall,
       CAST((epoch * 6007) % 100 AS DOUBLE) / 100 AS map50, CAST((epoch * 3571) % 100 AS DOUBLE) / 100 AS map
FROM (SELECT event_id % 200 AS epoch, avg(value) AS avg_value FROM events GROUP BY event_id % 200) e
"""

#: outlines of masks, as shares of a box around its centre: a diamond, an L and a U; fixed values
SHAPES = [
    [(0.0, -0.5), (0.5, 0.0), (0.0, 0.5), (-0.5, 0.0)],
    [(-0.5, -0.5), (0.0, -0.5), (0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (-0.5, 0.5)],
    [(-0.5, -0.5), (-0.25, -0.5), (-0.25, 0.25), (0.25, 0.25), (0.25, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)],
]

_PARTS = {"gt": GT, "det": DET, "images": IMAGES, "lines": LINES, "runlog": RUNLOG}
_NEEDS = {"gt": ("lineitem", ()), "det": (None, ("gt",)), "images": ("orders", ()), "lines": (None, ("gt",)), "runlog": ("events", ())}


def with_sql(*names: str) -> str:
    """WITH clause for the SQL twins, with what the names need."""
    order: list[str] = []
    for n in names:
        for x in (*_NEEDS[n][1], n):
            if x not in order:
                order.append(x)
    return "WITH " + ", ".join(f"{n} AS ({_PARTS[n]})" for n in order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str, **made: DataFrame) -> DataFrame:
    """gt, det, images, lines or runlog as a DataFrame, from parts that are made already or from the tables."""
    source, parts = _NEEDS[name]
    frames = {p: made[p] if p in made else fixture(spark, sf_dir, p) for p in parts} | ({source: table(spark, sf_dir, source)} if source else {})
    text = _PARTS[name]
    for n in frames:
        text = text.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"FROM {n})", f"FROM {{{n}}})").replace(f"FROM {n}\n", f"FROM {{{n}}}\n")
    return spark.sql(text, **frames)
