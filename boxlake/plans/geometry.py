"""Queries of box geometry, anchors, run logs, sinks and streams, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.fixtures import fixture, table, with_sql
from boxlake.functions import boxes as B
from boxlake.functions import text as T
from boxlake.operators import anchors, recurrence, runlog
from boxlake.plans.evaluation import LAB, labels
from boxlake.sources import sinks
from boxlake.streaming import frames

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def r(c, n: int = 6):
    return F.round(c, n)


def rounded_box(b: B.Box, *names: str, places: int = 6) -> list:
    return [r(c, places).alias(n) for c, n in zip(b, names, strict=True)]


@query
def box_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Corners, clipped corners, normalised forms, flips, the way back from a letterbox, and the size class."""
    gt = fixture(spark, d, "gt")
    p = B.to_corners(B.box("cx", "cy", "w", "h"))
    n = B.to_normalised(p, 640.0, 480.0, clip_eps=1e-3)
    back = B.from_normalised(n, 640.0, 480.0, 8.0, 4.0)
    un = B.unletterbox(p, 640.0, 640.0, F.lit(800.0), F.lit(600.0))
    return gt.select(
        "image_id", "label_id", *rounded_box(p, "x1", "y1", "x2", "y2"), *rounded_box(B.clip(p, 640.0, 480.0), "cx1", "cy1", "cx2", "cy2"), *rounded_box(n, "nx", "ny", "nw", "nh", places=9),
        *rounded_box(back, "bx1", "by1", "bx2", "by2"), *rounded_box(un, "ux1", "uy1", "ux2", "uy2"), r(1 - n.a, 9).alias("flip_x"), r(1 - n.b, 9).alias("flip_y"), B.size_bin(F.col("w"), F.col("h"), F.lit(640.0), F.lit(480.0)).alias("bin"),
    )


SQL["box_geometry"] = f"""{with_sql('gt')}, p AS (SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM gt),
c AS (SELECT *, least(greatest(x1, 0), 640 - 1e-3) AS a, least(greatest(y1, 0), 480 - 1e-3) AS b, least(greatest(x2, 0), 640 - 1e-3) AS c, least(greatest(y2, 0), 480 - 1e-3) AS e FROM p),
n AS (SELECT *, (a + c) / 2 / 640 AS nx, (b + e) / 2 / 480 AS ny, (c - a) / 640 AS nw, (e - b) / 480 AS nh, 8e-1 AS g FROM c)
SELECT image_id, label_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(least(greatest(x1, 0), 640), 6) AS cx1, round(least(greatest(y1, 0), 480), 6) AS cy1, round(least(greatest(x2, 0), 640), 6) AS cx2, round(least(greatest(y2, 0), 480), 6) AS cy2,
round(nx, 9) AS nx, round(ny, 9) AS ny, round(nw, 9) AS nw, round(nh, 9) AS nh, round(640 * (nx - nw / 2) + 8, 6) AS bx1, round(480 * (ny - nh / 2) + 4, 6) AS by1, round(640 * (nx + nw / 2) + 8, 6) AS bx2, round(480 * (ny + nh / 2) + 4, 6) AS by2,
round(least(greatest(x1 / g, 0), 800), 6) AS ux1, round(least(greatest((y1 - 80) / g, 0), 600), 6) AS uy1, round(least(greatest(x2 / g, 0), 800), 6) AS ux2, round(least(greatest((y2 - 80) / g, 0), 600), 6) AS uy2, round(1 - nx, 9) AS flip_x, round(1 - ny, 9) AS flip_y,
CASE WHEN sqrt(w * h) < 5 THEN '<5' WHEN sqrt(w * h) < 16 THEN '5-16' WHEN sqrt(w * h) < 32 THEN '16-32' WHEN sqrt(w * h) < 64 THEN '32-64' WHEN sqrt(w * h) < 128 THEN '64-128' ELSE '>=128' END AS bin FROM n"""


@query
def letterbox_geometry(spark: SparkSession, d: str) -> DataFrame:
    i = fixture(spark, d, "images")
    w, h = T.upright_size(F.col("width"), F.col("height"), F.col("orientation"))
    i = i.select("image_id", w.cast("double").alias("w"), h.cast("double").alias("h"))
    g = B.letterbox(F.col("w"), F.col("h"))
    return i.select("image_id", *(r(c, 9).alias(k) for k, c in g.items()), B.make_divisible(F.col("w"), 32).cast("long").alias("w32"))


SQL["letterbox_geometry"] = f"""{with_sql('images')}, s AS (SELECT image_id, (CASE WHEN orientation IN (6, 8) THEN height ELSE width END)::DOUBLE AS w, (CASE WHEN orientation IN (6, 8) THEN width ELSE height END)::DOUBLE AS h FROM images),
a AS (SELECT *, least(640 / h, 640 / w) AS ratio FROM s), b AS (SELECT *, round_even(w * ratio, 0) AS new_w, round_even(h * ratio, 0) AS new_h FROM a), c AS (SELECT *, ((640 - new_w) % 32) / 2 AS dw, ((640 - new_h) % 32) / 2 AS dh FROM b)
SELECT image_id, round(ratio, 9) AS ratio, new_w, new_h, round_even(dw - 1e-1, 0) + 0 AS pad_left, round_even(dw + 1e-1, 0) AS pad_right, round_even(dh - 1e-1, 0) + 0 AS pad_top, round_even(dh + 1e-1, 0) AS pad_bottom, (ceil(w / 32) * 32)::BIGINT AS w32 FROM c"""


@query
def anchor_decode(spark: SparkSession, d: str) -> DataFrame:
    """Raw grid outputs to boxes: centres from the cell, sizes from the anchor."""
    raw = fixture(spark, d, "gt").select("image_id", "label_id", F.floor(F.col("cx") / 16).alias("gx"), F.floor(F.col("cy") / 16).alias("gy"), ((F.col("w") - 90) / 40).alias("t1"), ((F.col("h") - 80) / 40).alias("t2"))
    s = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return raw.select("image_id", "label_id", r((s("t1") * 2 + F.col("gx") - 0.5) * 16).alias("x"), r((s("t2") * 2 + F.col("gy") - 0.5) * 16).alias("y"), r(F.pow(s("t1") * 2, F.lit(2.0)) * 62).alias("w"), r(F.pow(s("t2") * 2, F.lit(2.0)) * 45).alias("h"))


SQL["anchor_decode"] = f"""{with_sql('gt')}, s AS (SELECT image_id, label_id, floor(cx / 16) AS gx, floor(cy / 16) AS gy, 1 / (1 + exp(-(w - 90) / 40)) AS a, 1 / (1 + exp(-(h - 80) / 40)) AS b FROM gt)
SELECT image_id, label_id, round((a * 2 + gx - 5e-1) * 16, 6) AS x, round((b * 2 + gy - 5e-1) * 16, 6) AS y, round(a * 2 * a * 2 * 62, 6) AS w, round(b * 2 * b * 2 * 45, 6) AS h FROM s"""


@query
def tta_descale(spark: SparkSession, d: str) -> DataFrame:
    """Predictions at scales 1, 0.83 (mirrored) and 0.67 brought back to one frame."""
    gt = fixture(spark, d, "gt").select("image_id", "label_id", "cx", "cy", "w", "h")
    parts = []
    for k, (scale, mirror) in enumerate(((1.0, False), (0.83, True), (0.67, False))):
        x = F.col("cx") / scale
        parts.append(gt.select("image_id", "label_id", F.lit(k).alias("variant"), r(640 - x if mirror else x).alias("x"), r(F.col("cy") / scale).alias("y"), r(F.col("w") / scale).alias("w"), r(F.col("h") / scale).alias("h")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SQL["tta_descale"] = f"{with_sql('gt')} SELECT image_id, label_id, k AS variant, round(CASE WHEN k = 1 THEN 640 - cx / s ELSE cx / s END, 6) AS x, round(cy / s, 6) AS y, round(w / s, 6) AS w, round(h / s, 6) AS h FROM gt, (VALUES (0, 1e0), (1, 83e-2), (2, 67e-2)) v(k, s)"


@query
def augmentation_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Boxes that survive a shear and shift."""
    m = [[0.9, 0.1, 30.0], [0.05, 1.1, -20.0], [0.0001, 0.0, 1.0]]
    p = B.to_corners(B.box("cx", "cy", "w", "h"))
    gt = fixture(spark, d, "gt").select("image_id", "label_id", "w", "h", *B.warp(p, m, 640.0, 480.0).named("x1", "y1", "x2", "y2"))
    ok = B.is_candidate(F.col("w"), F.col("h"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return gt.select("image_id", "label_id", r("x1").alias("x1"), r("y1").alias("y1"), r("x2").alias("x2"), r("y2").alias("y2"), ok.alias("ok"))


_C = {"a": ("(cx - w / 2)", "(cy - h / 2)"), "b": ("(cx + w / 2)", "(cy + h / 2)"), "c": ("(cx - w / 2)", "(cy + h / 2)"), "d": ("(cx + w / 2)", "(cy - h / 2)")}
_WX = ", ".join(f"({x} * 9e-1 + {y} * 1e-1 + 30) / ({x} * 1e-4 + 1)" for x, y in _C.values())
_WY = ", ".join(f"({x} * 5e-2 + {y} * 11e-1 - 20) / ({x} * 1e-4 + 1)" for x, y in _C.values())
SQL["augmentation_candidates"] = f"""{with_sql('gt')}, b AS (SELECT image_id, label_id, w, h, least(greatest(least({_WX}), 0), 640) AS x1, least(greatest(least({_WY}), 0), 480) AS y1, least(greatest(greatest({_WX}), 0), 640) AS x2, least(greatest(greatest({_WY}), 0), 480) AS y2 FROM gt),
s AS (SELECT *, x2 - x1 AS a, y2 - y1 AS b FROM b) SELECT image_id, label_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, a > 2 AND b > 2 AND a * b / (w * h + 1e-16) > 1e-1 AND greatest(a / (b + 1e-16), b / (a + 1e-16)) < 100 AS ok FROM s"""


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    """A diamond for each box; some corners lie outside."""
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    c = [F.col(n) for n in ("cx", "cy", "w", "h")]
    return fixture(spark, d, "gt").select("image_id", "label_id", F.array(pt(c[0] - c[2], c[1]), pt(c[0], c[1] - c[3]), pt(c[0] + c[2], c[1]), pt(c[0], c[1] + c[3])).alias("points"))


@query
def polygon_boxes(spark: SparkSession, d: str) -> DataFrame:
    p = _polygons(spark, d)
    return p.select("image_id", "label_id", *rounded_box(B.to_centre(B.polygon_bounds(F.col("points"))), "x", "y", "w", "h"), *rounded_box(B.polygon_box_inside(F.col("points"), 640.0, 480.0), "ix1", "iy1", "ix2", "iy2"))


SQL["polygon_boxes"] = f"""{with_sql('gt')}, q AS (SELECT image_id, label_id, unnest([{{'x': cx - w, 'y': cy}}, {{'x': cx, 'y': cy - h}}, {{'x': cx + w, 'y': cy}}, {{'x': cx, 'y': cy + h}}]) AS p FROM gt),
f AS (SELECT *, p.x AS x, p.y AS y, p.x BETWEEN 0 AND 640 AND p.y BETWEEN 0 AND 480 AS i FROM q)
SELECT image_id, label_id, round((min(x) + max(x)) / 2, 6) AS x, round((min(y) + max(y)) / 2, 6) AS y, round(max(x) - min(x), 6) AS w, round(max(y) - min(y), 6) AS h, round(coalesce(min(x) FILTER (i), 0), 6) AS ix1, round(coalesce(min(y) FILTER (i), 0), 6) AS iy1, round(coalesce(max(x) FILTER (i), 0), 6) AS ix2, round(coalesce(max(y) FILTER (i), 0), 6) AS iy2 FROM f GROUP BY ALL"""


@query
def resampled_polygons(spark: SparkSession, d: str) -> DataFrame:
    p = _polygons(spark, d).select("*", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("i"))
    p = p.select("image_id", "label_id", "i", B.resampled_point(F.col("points"), F.col("i"), 9).alias("p"))
    return p.select("image_id", "label_id", "i", r("p.x").alias("x"), r("p.y").alias("y"))


SQL["resampled_polygons"] = f"""{with_sql('gt')}, q AS (SELECT image_id, label_id, [cx - w, cx, cx + w, cx, cx - w] AS xs, [cy, cy - h, cy, cy + h, cy] AS ys, k, k * 4 / 8e0 AS s, least(floor(k * 4 / 8e0)::INT, 3) AS l FROM gt, range(9) g(k))
SELECT image_id, label_id, k::INTEGER AS i, round(xs[l + 1] + (xs[l + 2] - xs[l + 1]) * (s - l), 6) AS x, round(ys[l + 1] + (ys[l + 2] - ys[l + 1]) * (s - l), 6) AS y FROM q"""


@query
def mosaic_labels(spark: SparkSession, d: str) -> DataFrame:
    """Four images (of one group of four ids) around a common centre on a canvas of twice the size, boxes moved and clipped."""
    p = B.to_corners(B.box("cx", "cy", "w", "h"))
    gt = fixture(spark, d, "gt").select("image_id", "label_id", *p.named("x1", "y1", "x2", "y2"))
    tile = F.pmod("image_id", F.lit(4))
    xc, yc = 600.0, 700.0
    dx, dy = F.when(tile.isin(0, 2), xc - 640).otherwise(xc), F.when(tile.isin(0, 1), yc - 480).otherwise(yc)
    moved = B.clip(B.Box(F.col("x1") + dx, F.col("y1") + dy, F.col("x2") + dx, F.col("y2") + dy), 1280.0, 1280.0)
    return gt.select(F.floor(F.col("image_id") / 4).alias("mosaic"), "image_id", "label_id", *rounded_box(moved, "x1", "y1", "x2", "y2")).where("x2 > x1 AND y2 > y1")


SQL["mosaic_labels"] = f"""{with_sql('gt')}, m AS (SELECT image_id, label_id, CASE WHEN image_id % 4 IN (0, 2) THEN -40 ELSE 600 END AS dx, CASE WHEN image_id % 4 IN (0, 1) THEN 220 ELSE 700 END AS dy, cx, cy, w, h FROM gt),
c AS (SELECT image_id // 4 AS mosaic, image_id, label_id, round(least(greatest(cx - w / 2 + dx, 0), 1280), 6) AS x1, round(least(greatest(cy - h / 2 + dy, 0), 1280), 6) AS y1, round(least(greatest(cx + w / 2 + dx, 0), 1280), 6) AS x2, round(least(greatest(cy + h / 2 + dy, 0), 1280), 6) AS y2 FROM m) SELECT * FROM c WHERE x2 > x1 AND y2 > y1"""


@query
def quad_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of four images laid out two by two: normalised, shifted by a tile, halved."""
    gt = fixture(spark, d, "gt")
    tile = F.pmod("image_id", F.lit(4))
    return gt.select(F.floor(F.col("image_id") / 4).alias("quad"), "image_id", "label_id", r((F.col("cx") / 640 + (tile % 2)) * 0.5, 9).alias("x"), r((F.col("cy") / 480 + F.floor(tile / 2)) * 0.5, 9).alias("y"), r(F.col("w") / 640 * 0.5, 9).alias("w"), r(F.col("h") / 480 * 0.5, 9).alias("h"))


SQL["quad_labels"] = f"{with_sql('gt')} SELECT image_id // 4 AS quad, image_id, label_id, round((cx / 640 + image_id % 2) / 2, 9) AS x, round((cy / 480 + (image_id % 4) // 2) / 2, 9) AS y, round(w / 640 / 2, 9) AS w, round(h / 480 / 2, 9) AS h FROM gt"


@query
def occlusion_filter(spark: SparkSession, d: str) -> DataFrame:
    """Labels that no detection of another class covers by 30 per cent or more."""
    lab = labels(spark, d)
    det = fixture(spark, d, "det").select(F.col("image_id").alias("i2"), F.col("class_id").alias("c2"), *(F.col(c).alias(f"d{c}") for c in ("x1", "y1", "x2", "y2")))
    covered = B.ioa(B.box("dx1", "dy1", "dx2", "dy2"), B.box("x1", "y1", "x2", "y2")) >= 0.3
    return lab.join(det, (F.col("image_id") == F.col("i2")) & (F.col("class_id") != F.col("c2")) & covered, "left_anti").select("image_id", "label_id")


SQL["occlusion_filter"] = f"""{with_sql('det')}, {LAB} SELECT image_id, label_id FROM lab l WHERE NOT EXISTS (SELECT 1 FROM det d WHERE d.image_id = l.image_id AND d.class_id <> l.class_id
AND greatest(least(l.x2, d.x2) - greatest(l.x1, d.x1), 0) * greatest(least(l.y2, d.y2) - greatest(l.y1, d.y1), 0) / ((l.x2 - l.x1) * (l.y2 - l.y1) + 1e-7) >= 3e-1)"""


@query
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    i = fixture(spark, d, "images")
    return i.select(
        "image_id", T.label_path(F.col("path")).alias("label_path"), T.label_path_everywhere(F.concat(F.lit("/images/x"), F.col("path"))).alias("label_path2"), T.stem(F.col("path")).alias("stem"), T.extension(F.col("path")).alias("ext"), T.numeric_prefix(F.col("stem")).alias("prefix"),
        T.last_prefix(F.col("stem")).alias("prefix2"), T.clean(F.concat(F.col("stem"), F.lit("#a:b"))).alias("clean"), T.class_folder(F.col("path")).alias("folder"), T.is_ascii(F.col("path")).alias("ascii"), T.is_chinese(F.concat(F.lit("图"), F.col("stem"))).alias("chinese"),
    )


SQL["text_helpers"] = f"""{with_sql('images')} SELECT image_id, replace(replace(path, '/images/', '/labels/'), '.JPG', '.txt') AS label_path, '/labels/x' || replace(replace(path, '/images/', '/labels/'), '.JPG', '.txt') AS label_path2, stem, 'jpg' AS ext, regexp_replace(stem, '_[0-9]+$', '') AS prefix, regexp_replace(stem, '_[^_]*$', '') AS prefix2,
stem || '_a_b' AS clean, 'images' AS folder, true AS ascii, true AS chinese FROM images"""


@query
def anchor_recall(spark: SparkSession, d: str) -> DataFrame:
    out = anchors.best_possible_recall(fixture(spark, d, "gt"))
    return out.select(*(r(c, 9).alias(c) for c in out.columns))


_ANCH = "anch AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {anchors.STRIDES[i]}, {w}::DOUBLE, {h}::DOUBLE)" for i, lv in enumerate(anchors.ANCHORS) for j, (w, h) in enumerate(lv)) + ") v(level, anchor, stride, aw, ah))"
SQL["anchor_recall"] = f"""{with_sql('gt')}, {_ANCH}, m AS (SELECT image_id, label_id, max(least(least(w / aw, aw / w), least(h / ah, ah / h))) AS best, sum((least(least(w / aw, aw / w), least(h / ah, ah / h)) > 25e-2)::INT) AS near FROM gt, anch GROUP BY ALL)
SELECT round(avg((best > 25e-2)::INT), 9) AS bpr, round(avg(near), 9) AS aat, round(avg(best), 9) AS mean_best FROM m"""


@query
def anchor_assign(spark: SparkSession, d: str) -> DataFrame:
    gt = fixture(spark, d, "gt").select("image_id", "label_id", "class_id", F.col("cx").alias("x"), F.col("cy").alias("y"), "w", "h")
    return anchors.assign_targets(gt).groupBy("image_id", "level", "anchor").agg(F.count("*").alias("n"), F.sum("gi").alias("gi"), F.sum("gj").alias("gj"), r(F.sum("tx"), 4).alias("tx"), r(F.sum("ty"), 4).alias("ty"))


SQL["anchor_assign"] = f"""{with_sql('gt')}, {_ANCH}, t AS (SELECT *, cx / stride AS gx, cy / stride AS gy, 640 // stride AS g FROM gt, anch WHERE greatest(w / aw, aw / w, h / ah, ah / h) < 4),
s AS (SELECT *, unnest([{{'x': 0e0, 'y': 0e0, 'o': true}}, {{'x': 5e-1, 'y': 0e0, 'o': gx % 1 < 5e-1 AND gx > 1}}, {{'x': 0e0, 'y': 5e-1, 'o': gy % 1 < 5e-1 AND gy > 1}}, {{'x': -5e-1, 'y': 0e0, 'o': (g - gx) % 1 < 5e-1 AND g - gx > 1}}, {{'x': 0e0, 'y': -5e-1, 'o': (g - gy) % 1 < 5e-1 AND g - gy > 1}}]) AS o FROM t),
c AS (SELECT *, trunc(gx - o.x)::INT AS i, trunc(gy - o.y)::INT AS j FROM s WHERE o.o)
SELECT image_id, level, anchor, count(*) AS n, sum(least(greatest(i, 0), g - 1))::BIGINT AS gi, sum(least(greatest(j, 0), g - 1))::BIGINT AS gj, round(sum(gx - i), 4) AS tx, round(sum(gy - j), 4) AS ty FROM c GROUP BY ALL"""


_START = [(20.0, 20.0), (60.0, 50.0), (120.0, 100.0), (180.0, 150.0)]
_KS = range(len(_START))


@query
def anchor_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of label sizes by IoU distance, medians as centres."""
    return anchors.kmeans(fixture(spark, d, "gt").select("w", "h"), _START, rounds=20)


def _centre_rounds(rounds: int, score: str, pick: str, middle: str) -> str:
    """CTEs k0 to k<rounds>: one row with the centres w0, h0, w1 ...; score and pick choose a centre, middle is the aggregate."""
    out = ["k0 AS (SELECT " + ", ".join(f"{w!r}::DOUBLE AS w{i}, {h!r}::DOUBLE AS h{i}" for i, (w, h) in enumerate(_START)) + ")"]
    for n in range(rounds):
        scores = ", ".join(score.format(i=i) for i in _KS)
        out.append(f"m{n} AS MATERIALIZED (SELECT list_position(s, {pick}(s)) - 1 AS c, {middle}(w) AS w, {middle}(h) AS h FROM (SELECT w, h, [{scores}] AS s FROM gt, k{n}) GROUP BY 1)")
        out.append(f"k{n + 1} AS MATERIALIZED (SELECT " + ", ".join(f"coalesce((SELECT {v} FROM m{n} WHERE c = {i}), {v}{i}) AS {v}{i}" for i in _KS for v in "wh") + f" FROM k{n})")
    return ", ".join(out)


_WH_IOU = "least(w, w{i}) * least(h, h{i}) / (w * h + w{i} * h{i} - least(w, w{i}) * least(h, h{i}) + 1e-12)"
_BY_AREA = lambda k: "[" + ", ".join(f"{{'w': w{i}, 'h': h{i}}}" for i in _KS) + f"] FROM {k}"
SQL["anchor_kmeans"] = f"""{with_sql('gt')}, {_centre_rounds(20, _WH_IOU, 'list_max', 'median')},
z AS (SELECT (row_number() OVER (ORDER BY c.w * c.h) - 1)::INTEGER AS j, c.w AS w0, c.h AS h0 FROM (SELECT unnest({_BY_AREA('k20').replace(' FROM', ') AS c FROM')})),
s AS (SELECT w, h, j AS center FROM gt, z QUALIFY row_number() OVER (PARTITION BY image_id, label_id ORDER BY {_WH_IOU.format(i=0)} DESC, j) = 1)
SELECT center, count(*) AS n, median(w) AS w, median(h) AS h FROM s GROUP BY center"""


def _by_area(centres: list[tuple[float, float]], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, round(w, 6), round(h, 6)) for i, (w, h) in enumerate(centres)], "anchor int, w double, h double")


@query
def anchor_whitened(spark: SparkSession, d: str) -> DataFrame:
    """Centres of label sizes by distance in units of deviation, means as centres."""
    return _by_area(anchors.whitened_rounds(fixture(spark, d, "gt").select("w", "h"), _START, rounds=20), spark)


SQL["anchor_whitened"] = f"""{with_sql('gt')}, sd AS (SELECT stddev_pop(w) AS sw, stddev_pop(h) AS sh FROM gt),
{_centre_rounds(20, 'power((w - w{i}) / (SELECT sw FROM sd), 2) + power((h - h{i}) / (SELECT sh FROM sd), 2)', 'list_min', 'avg')}
SELECT (row_number() OVER (ORDER BY c.w * c.h) - 1)::INTEGER AS anchor, round(c.w, 6) AS w, round(c.h, 6) AS h FROM (SELECT unnest({_BY_AREA('k20').replace(' FROM', ') AS c FROM')})"""

_GENERATIONS, _BROOD = 4, 8


@query
def anchor_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Anchors that four generations of mutations leave."""
    return _by_area(anchors.evolved(fixture(spark, d, "gt").select("w", "h"), _START, _GENERATIONS, _BROOD), spark)


def _evolution_sql() -> str:
    """k<n>: anchors and score after n generations; t<n>: its children."""
    fit = "avg(CASE WHEN q > 25e-2 THEN q ELSE 0e0 END)"
    best = "greatest(" + ", ".join(f"least(least(w / w{i}, w{i} / w), least(h / h{i}, h{i} / h))" for i in _KS) + ")"
    sides = [f"{v}{i}" for i in _KS for v in "wh"]
    out = ["a0 AS (SELECT " + ", ".join(f"{c!r}::DOUBLE AS {v}{i}" for i, wh in enumerate(_START) for v, c in zip("wh", wh, strict=True)) + ")", f"k0 AS MATERIALIZED (SELECT a0.*, (SELECT {fit} FROM (SELECT {best} AS q FROM gt, a0)) AS score FROM a0)"]
    for n, brood in enumerate(anchors.mutations(len(_START), _GENERATIONS, _BROOD)):
        rows = ", ".join("(" + ", ".join([str(b), *(f"{f!r}::DOUBLE" for pair in child for f in pair)]) + ")" for b, child in enumerate(brood))
        names = ", ".join(f"f{s}" for s in sides)
        out.append(f"t{n} AS MATERIALIZED (SELECT b, " + ", ".join(f"greatest(2e0, {s} * f{s}) AS {s}" for s in sides) + f" FROM k{n}, (VALUES {rows}) v(b, {names}))")
        out.append(f"s{n} AS (SELECT b, {', '.join(sides)}, {fit} AS score FROM (SELECT t{n}.*, {best} AS q FROM gt, t{n}) GROUP BY ALL)")
        out.append(f"k{n + 1} AS MATERIALIZED (SELECT {', '.join(sides)}, score FROM (SELECT -1 AS b, * FROM k{n} UNION ALL BY NAME SELECT * FROM s{n}) ORDER BY score DESC, b LIMIT 1)")
    return ", ".join(out)


SQL["anchor_evolution"] = f"""{with_sql('gt')}, {_evolution_sql()}
SELECT (row_number() OVER (ORDER BY c.w * c.h) - 1)::INTEGER AS anchor, round(c.w, 6) AS w, round(c.h, 6) AS h FROM (SELECT unnest({_BY_AREA(f'k{_GENERATIONS}').replace(' FROM', ') AS c FROM')})"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    log = fixture(spark, d, "runlog")
    return log.withColumn("fitness", r(runlog.fitness(F.col("precision_"), F.col("recall"), F.col("map50"), F.col("map")), 9))


_LOG = "log AS (SELECT *, round(map50 * 1e-1 + map * 9e-1, 9) AS fitness FROM runlog)"


@query
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    return runlog.early_stopping(_log(spark, d), 30)


SQL["early_stopping"] = f"""{with_sql('runlog')}, {_LOG}, b AS (SELECT epoch, fitness, max(fitness) OVER (ORDER BY epoch) AS best FROM log), c AS (SELECT *, max(CASE WHEN fitness >= best THEN epoch END) OVER (ORDER BY epoch) AS best_epoch FROM b)
SELECT *, epoch - best_epoch >= 30 AS stop FROM c"""


@query
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return runlog.best_row(_log(spark, d)).select("epoch", "fitness", "map50", "map")


SQL["best_epoch"] = f"{with_sql('runlog')}, {_LOG} SELECT epoch, fitness, map50, map FROM log ORDER BY fitness DESC, epoch LIMIT 1"


@query
def evolve_parents(spark: SparkSession, d: str) -> DataFrame:
    return runlog.parents(_log(spark, d)).select("epoch", r("weight", 9).alias("weight"))


SQL["evolve_parents"] = f"{with_sql('runlog')}, {_LOG}, t AS (SELECT epoch, fitness FROM log ORDER BY fitness DESC, epoch LIMIT 5) SELECT epoch, round(fitness - min(fitness) OVER () + 1e-6, 9) AS weight FROM t"


@query
def running_mean(spark: SparkSession, d: str) -> DataFrame:
    cents = table(spark, d, "events").select("event_id", F.rint(F.col("value") * 100).cast("long").alias("cents"))  # whole numbers: sums don't depend on their order
    return runlog.running_mean(cents, "event_id", "cents").withColumn("mean", r("mean", 6))


SQL["running_mean"] = "SELECT event_id, round(sum(round_even(value * 100, 0)::BIGINT) OVER w / count(*) OVER w, 6) AS mean FROM events WINDOW w AS (ORDER BY event_id)"


@query
def schedules(spark: SparkSession, d: str) -> DataFrame:
    """Learning rates of the epochs of the run log, beside their losses."""
    log = fixture(spark, d, "runlog").select("epoch", r("loss", 6).alias("loss"))
    s = runlog.schedules(spark, log.count()).join(log, "epoch")
    return s.select("epoch", "loss", *(r(c, 9).alias(c) for c in ("linear", "cosine", "lr")))


SQL["schedules"] = f"""{with_sql('runlog')}, n AS (SELECT count(*)::DOUBLE AS n FROM runlog), s AS (SELECT epoch, loss, (1 - epoch / n) * 99e-2 + 1e-2 AS linear, (1 - cos(epoch * pi() / n)) / 2 * (1e-2 - 1) + 1 AS cosine FROM runlog, n WHERE epoch < n)
SELECT epoch, round(loss, 6) AS loss, round(linear, 9) AS linear, round(cosine, 9) AS cosine, round(CASE WHEN epoch < 3 THEN epoch / 3e0 * 1e-2 * linear ELSE 1e-2 * linear END, 9) AS lr FROM s"""


@query
def ema(spark: SparkSession, d: str) -> DataFrame:
    return runlog.ema(_log(spark, d), "epoch", "loss", tau=20.0).withColumn("ema", r("ema", 6))


SQL["ema"] = f"""{with_sql('runlog')}, l AS (SELECT list(loss ORDER BY epoch) AS v, count(*) AS n FROM runlog),
f AS (SELECT n, list_reduce(v, lambda a, x: {{'t': a.t + 1, 'e': a.e * 9999e-4 * (1 - exp(-(a.t + 1) / 20)) + x * (1 - 9999e-4 * (1 - exp(-(a.t + 1) / 20)))}}, {{'t': 0e0, 'e': 0e0}}) AS s FROM l) SELECT round(s.e, 6) AS ema, n FROM f"""


@query
def ema_series(spark: SparkSession, d: str) -> DataFrame:
    """Exponential average of the values of each type of event, in the order of time, at every event."""
    e = table(spark, d, "events")
    return recurrence.running_ema(e, "event_type", "ts", "value", tau=50.0).select("event_type", "ts", r("ema", 6).alias("ema"))


_STEP = """i AS MATERIALIZED (SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, value) AS t, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)"""
SQL["ema_series"] = f"""WITH RECURSIVE {_STEP},
f AS (SELECT event_type, ts, t, value * (1 - 9999e-4 * (1 - exp(-1 / 50e0))) AS e FROM i WHERE t = 1
  UNION ALL SELECT i.event_type, i.ts, i.t, f.e * 9999e-4 * (1 - exp(-i.t / 50e0)) + value * (1 - 9999e-4 * (1 - exp(-i.t / 50e0))) FROM f JOIN i ON i.event_type = f.event_type AND i.t = f.t + 1)
SELECT event_type, ts, round(e, 6) AS ema FROM f"""


@query
def lowpass_series(spark: SparkSession, d: str) -> DataFrame:
    """Values of each type of event through a Butterworth low-pass in both directions."""
    e = table(spark, d, "events").select("event_type", "ts", "value")
    out = recurrence.lowpass_series(e, "event_type", "ts", "value", "event_type string, ts timestamp_ntz, smooth double", cutoff=0.2, poles=3)
    return out.withColumn("smooth", r("smooth", 6))


def _pass(name: str, source: str, order: str) -> str:
    """y of one direction: delays z1 to z3 step by step, from those that the first value would leave for ever."""
    f = recurrence.Filter(*recurrence.butterworth(3, 0.2))
    rest, gain, first = f.rest.tolist(), f.gain.tolist(), f.matrix[:, 0].tolist()
    z = lambda i, v, z1, nxt: f"{nxt} + {first[i]!r}::DOUBLE * {z1} + {gain[i]!r}::DOUBLE * {v}"
    step = lambda v, z1, z2, z3: f"{f.b0!r}::DOUBLE * {v} + {z1} AS y, {z(0, v, z1, z2)} AS z1, {z(1, v, z1, z3)} AS z2, {z(2, v, z1, '0e0')} AS z3"
    starts = [f"({c!r}::DOUBLE * v)" for c in rest]
    return f"""{name}_i AS MATERIALIZED (SELECT event_type, t, v, row_number() OVER (PARTITION BY event_type ORDER BY t {order}) AS k FROM {source}),
{name} AS (SELECT event_type, t, k, {step('v', *starts)} FROM {name}_i WHERE k = 1
  UNION ALL SELECT i.event_type, i.t, i.k, {step('i.v', 's.z1', 's.z2', 's.z3')} FROM {name} s JOIN {name}_i i ON i.event_type = s.event_type AND i.k = s.k + 1)"""


SQL["lowpass_series"] = f"""WITH RECURSIVE {_STEP},
ends AS (SELECT event_type, max(value) FILTER (WHERE t = 1) AS v0, max(value) FILTER (WHERE t = n) AS v1 FROM i GROUP BY event_type),
wide AS (SELECT event_type, t, value AS v FROM i UNION ALL SELECT event_type, 2 - t, 2 * v0 - value FROM i JOIN ends USING (event_type) WHERE t BETWEEN 2 AND 1 + least(12, n - 1)
  UNION ALL SELECT event_type, 2 * n - t, 2 * v1 - value FROM i JOIN ends USING (event_type) WHERE t BETWEEN n - least(12, n - 1) AND n - 1),
{_pass('there', 'wide', 'ASC')}, turned AS (SELECT event_type, t, y AS v FROM there), {_pass('back', 'turned', 'DESC')}
SELECT event_type, i.ts, round(y, 6) AS smooth FROM back JOIN i USING (event_type, t)"""


@query
def trimmed_series(spark: SparkSession, d: str) -> DataFrame:
    return runlog.trimmed(fixture(spark, d, "runlog").select("epoch", r("loss").alias("loss")), "epoch", 90, 30)


SQL["trimmed_series"] = f"{with_sql('runlog')} SELECT epoch, round(loss, 6) AS loss, epoch - min(epoch) OVER () AS t FROM runlog QUALIFY row_number() OVER (ORDER BY epoch) > 90 AND row_number() OVER (ORDER BY epoch) <= count(*) OVER () - 30"


@query
def smooth_curve(spark: SparkSession, d: str) -> DataFrame:
    from boxlake.operators.evaluate import smooth

    return smooth(fixture(spark, d, "runlog").select("epoch", "loss"), "epoch", "loss", 200, 0.05).select("epoch", r("smooth").alias("smooth"))


SQL["smooth_curve"] = f"""{with_sql('runlog')}, e AS (SELECT k, (SELECT loss FROM runlog WHERE epoch = least(greatest(k, 0), 199)) AS v FROM range(-20, 220) g(k)),
w AS (SELECT k, avg(v) OVER (ORDER BY k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM e) SELECT k AS epoch, round(s, 6) AS smooth FROM w WHERE k BETWEEN 0 AND 199"""


@query
def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    """Slope and intercept of price over quantity, mean and deviation."""
    l = table(spark, d, "lineitem")
    return l.groupBy("l_returnflag").agg(r(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), r(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), r(F.avg("l_quantity")).alias("mean"), r(F.stddev_pop("l_quantity")).alias("std"))


SQL["linear_fit"] = "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1"


@query
def aspect_batches(spark: SparkSession, d: str) -> DataFrame:
    return runlog.aspect_batches(fixture(spark, d, "images"), 32)


SQL["aspect_batches"] = f"""{with_sql('images')}, a AS (SELECT image_id, height / width AS ar FROM images), b AS (SELECT *, (row_number() OVER (ORDER BY ar, image_id) - 1) // 32 AS batch FROM a), g AS (SELECT batch, count(*) AS n, min(ar) AS lo, max(ar) AS hi FROM b GROUP BY batch)
SELECT batch, n, (ceil(640 * CASE WHEN hi < 1 THEN hi ELSE 1 END / 32 + 5e-1) * 32)::BIGINT AS shape_h, (ceil(640 * CASE WHEN hi >= 1 AND lo > 1 THEN 1 / lo ELSE 1 END / 32 + 5e-1) * 32)::BIGINT AS shape_w FROM g"""


@query
def coco_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.coco_rows(fixture(spark, d, "det"))


SQL["coco_rows"] = f"{with_sql('det')} SELECT image_id, det_id, class_id + 1 AS category_id, round_even(x1, 3) AS bx, round_even(y1, 3) AS by, round_even(x2 - x1, 3) AS bw, round_even(y2 - y1, 3) AS bh, round_even(conf, 5) AS score FROM (SELECT image_id, det_id, class_id, conf, (x1 + x2) / 2 - (x2 - x1) / 2 AS x1, (y1 + y2) / 2 - (y2 - y1) / 2 AS y1, (x1 + x2) / 2 - (x2 - x1) / 2 + (x2 - x1) AS x2, (y1 + y2) / 2 - (y2 - y1) / 2 + (y2 - y1) AS y2 FROM det) q"


@query
def yolo_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.yolo_rows(fixture(spark, d, "det"), 640.0, 480.0)


SQL["yolo_rows"] = f"{with_sql('det')} SELECT image_id, det_id, format('{{}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}} {{:.6f}}', class_id, round_even((x1 + x2) / 2 / 640 * 1e6, 0) / 1e6, round_even((y1 + y2) / 2 / 480 * 1e6, 0) / 1e6, round_even((x2 - x1) / 640 * 1e6, 0) / 1e6, round_even((y2 - y1) / 480 * 1e6, 0) / 1e6, conf) AS line FROM det"


@query
def crop_boxes(spark: SparkSession, d: str) -> DataFrame:
    return sinks.crop_boxes(fixture(spark, d, "det"), 640.0, 480.0)


SQL["crop_boxes"] = f"""{with_sql('det')}, c AS (SELECT image_id, det_id, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, (x2 - x1) * 102e-2 + 10 AS w, (y2 - y1) * 102e-2 + 10 AS h FROM det)
SELECT image_id, det_id, floor(least(greatest(x - w / 2, 0), 640))::BIGINT AS x1, floor(least(greatest(y - h / 2, 0), 480))::BIGINT AS y1, floor(least(greatest(x + w / 2, 0), 640))::BIGINT AS x2, floor(least(greatest(y + h / 2, 0), 480))::BIGINT AS y2 FROM c"""


@query
def latest_per_stream(spark: SparkSession, d: str) -> DataFrame:
    return frames.latest_per_stream(table(spark, d, "events"), "user_id", "event_id", "event_type", "value")


SQL["latest_per_stream"] = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"


@query
def frame_stride(spark: SparkSession, d: str) -> DataFrame:
    return frames.every_nth(table(spark, d, "events"), "event_id", 7).select("event_id", "user_id")


SQL["frame_stride"] = "SELECT event_id, user_id FROM events WHERE event_id % 7 = 0"


@query
def epoch_image_cap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_id") % 20).alias("epoch"), F.col("user_id").alias("image"))
    return frames.capped_per_epoch(e, "epoch", "image", 16)


SQL["epoch_image_cap"] = "SELECT DISTINCT event_id % 20 AS epoch, user_id AS image FROM events QUALIFY dense_rank() OVER (PARTITION BY event_id % 20 ORDER BY user_id) <= 16"


@query
def stage_timers(spark: SparkSession, d: str) -> DataFrame:
    return frames.stage_timers(table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


SQL["stage_timers"] = "SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean_ms, round(sum(value), 6) AS total_ms FROM events GROUP BY 1"


@query
def shape_check(spark: SparkSession, d: str) -> DataFrame:
    return frames.same_shape(fixture(spark, d, "images"))


SQL["shape_check"] = f"{with_sql('images')} SELECT count(DISTINCT (width, height)) AS n_shapes, count(DISTINCT (width, height)) = 1 AS rectangular FROM images"


@query
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Extension: events per type and hour."""
    return frames.windowed_counts(table(spark, d, "events"), "ts", "event_type")


SQL["windowed_counts"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"
