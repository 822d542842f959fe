"""Queries over images that resemble each other, with SQL twins: every embedding becomes three images of unlike sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.fixtures import table
from boxlake.operators import dedup, pixels
from boxlake.operators.scan import written

SIZE, EXPAND = 16, 0.2
LIMIT = dedup.hamming_limit(0.85)
Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


#: the embedding's 8 x 8 values spread over 16 to 24 by 12 to 18 pixels; variant 1 is brighter, variant 2 more or less noisy or an exact copy
_WIDTH, _HEIGHT = "16 + 4 * (vec_id % 3)", "12 + 6 * (vec_id % 2)"
_ITEM = f"""SELECT vec_id * 3 + v AS item_id, vec_id, v, embedding, {_WIDTH} AS width, {_HEIGHT} AS height, CASE WHEN v = 1 AND vec_id % 11 = 0 THEN 1 ELSE 0 END + vec_id % 3 AS class_id,
 45e-2 + 2e-2 * (vec_id % 5) AS cx, 5e-1 AS cy, 4e-1 + 5e-2 * (vec_id % 4) - CASE WHEN v = 2 AND vec_id % 5 = 0 THEN 1e-1 ELSE 0e0 END AS w, 5e-1 + 5e-2 * (vec_id % 3) AS h"""
_SHIFT = "CASE v WHEN 1 THEN 4 + (x * y) % 3 WHEN 2 THEN CASE WHEN vec_id % 4 = 0 THEN 0 ELSE ((x + 2 * y) % 5) * (vec_id % 7) END ELSE 0 END"


def images(spark: SparkSession, d: str) -> DataFrame:
    """item_id, class_id, box and grey pixels of every image."""
    item = spark.sql(f"{_ITEM} FROM {{e}} LATERAL VIEW explode(sequence(0, 2)) AS v", e=table(spark, d, "embeddings"))
    level = f"""transform(sequence(0, height * width - 1), k -> CAST(least(255, greatest(0, floor(CAST(embedding[CAST((((k div width) * 8) div height) * 8 + ((k % width) * 8) div width AS INT)] AS DOUBLE) * 400 + 128)
      + {_SHIFT.replace('x', '(k % width)').replace('y', '(k div width)')})) AS LONG))"""
    byte = F.transform(F.expr(level), lambda p: F.lpad(F.hex(p), 2, "0"))
    return item.select("item_id", "class_id", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.lit(1).alias("channels"), *(F.col(c).cast("double").alias(c) for c in ("cx", "cy", "w", "h")), F.unhex(F.array_join(byte, "")).alias("pixels"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Thumbnails, hashes and quality of the images, made once."""
    im = images(spark, d)
    made = pixels.thumbnails(im, SIZE, EXPAND).join(im.select("item_id", "class_id", (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"), (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2")), "item_id")
    return written(made.withColumn("quality", F.round(dedup.quality(F.col("sharpness"), F.col("brightness"), F.col("overexposed"), F.col("underexposed")), 9)))


_LEVEL = "least(255e0, greatest(0e0, floor(round(sum(wt * p), 6) + 5e-1)))"
#: spec: for each kind of thumbnail and each axis the pixels that it takes (n from off), the stretch (span from lo) and its size m
ITEMS = f"""it AS ({_ITEM} FROM embeddings, range(3) g(v)),
px AS (SELECT item_id, y, x, least(255, greatest(0, floor(embedding[((y * 8) // height) * 8 + (x * 8) // width + 1]::DOUBLE * 400 + 128) + {_SHIFT})) AS p
  FROM (SELECT *, unnest(range(width)) AS x FROM (SELECT *, unnest(range(height)) AS y FROM it))),
cut AS (SELECT *, greatest(0, round_even((cx - (w * 14e-1) / 2) * width, 0))::BIGINT AS l, least(width, round_even((cx + (w * 14e-1) / 2) * width, 0))::BIGINT AS r,
  greatest(0, round_even((cy - (h * 14e-1) / 2) * height, 0))::BIGINT AS t, least(height, round_even((cy + (h * 14e-1) / 2) * height, 0))::BIGINT AS b FROM it),
spec AS (SELECT item_id, 'hash' AS kind, width AS nx, 0 AS ox, 0e0 AS lx, width::DOUBLE AS sx, height AS ny, 0 AS oy, 0e0 AS ly, height::DOUBLE AS sy, 32 AS m FROM it
  UNION ALL SELECT item_id, 'whole', width, 0, (width - least(width, height)) / 2e0, least(width, height)::DOUBLE, height, 0, (height - least(width, height)) / 2e0, least(width, height)::DOUBLE, {SIZE} FROM it
  UNION ALL SELECT item_id, 'part', r - l, l, (r - l - least(r - l, b - t)) / 2e0, least(r - l, b - t)::DOUBLE, b - t, t, (b - t - least(r - l, b - t)) / 2e0, least(r - l, b - t)::DOUBLE, {SIZE} FROM cut),
ax AS (SELECT row_number() OVER () AS ax, * FROM (SELECT nx AS n, lx AS lo, sx AS span, m FROM spec UNION SELECT ny, ly, sy, m FROM spec)),
tap AS (SELECT *, (i + 5e-1 - (lo + (j + 5e-1) * span / m)) / greatest(span / m, 1e0) AS q FROM (SELECT *, unnest(range(m)) AS j FROM (SELECT *, unnest(range(n)) AS i FROM ax))),
raw AS (SELECT ax, i, j, CASE WHEN abs(q) < 1e-12 THEN 1e0 WHEN abs(q) < 3 THEN sin(pi() * q) / (pi() * q) * sin(pi() * q / 3) / (pi() * q / 3) ELSE 0e0 END AS k FROM tap),
wts AS MATERIALIZED (SELECT ax, i, j, wt FROM (SELECT ax, i, j, k / sum(k) OVER (PARTITION BY ax, j) AS wt FROM raw) WHERE wt <> 0),
num AS MATERIALIZED (SELECT item_id, kind, ox, oy, ny, a.ax AS axx, c.ax AS axy, row_number() OVER () AS th FROM spec s JOIN ax a ON a.n = nx AND a.lo = lx AND a.span = sx AND a.m = s.m JOIN ax c ON c.n = ny AND c.lo = ly AND c.span = sy AND c.m = s.m),
gx AS MATERIALIZED (SELECT th, axx, axy, y - oy AS y, x - ox AS i, p FROM num JOIN px ON px.item_id = num.item_id AND y >= oy AND y < oy + ny),
hz AS MATERIALIZED (SELECT th, axy, y, j AS x, {_LEVEL} AS p FROM gx JOIN wts ON wts.ax = axx AND wts.i = gx.i GROUP BY ALL),
vt AS MATERIALIZED (SELECT th, j AS y, x, {_LEVEL} AS p FROM hz JOIN wts ON wts.ax = axy AND wts.i = hz.y GROUP BY ALL),
th AS (SELECT item_id, kind, y, x, p FROM vt JOIN num USING (th)),
cs AS (SELECT u, i, cos(pi() * u * (2 * i + 1) / 64) * CASE WHEN u = 0 THEN 25e-2 / sqrt(2e0) ELSE 25e-2 END AS k FROM range(8) a(u), range(32) b(i)),
rowed AS (SELECT item_id, x, u, sum(k * p) AS f FROM th JOIN cs ON i = y WHERE kind = 'hash' GROUP BY ALL),
low AS (SELECT item_id, rowed.u, cs.u AS z, sum(k * f) AS f FROM rowed JOIN cs ON i = x GROUP BY ALL),
mid AS (SELECT item_id, median(f) AS m FROM low WHERE u + z > 0 GROUP BY ALL),
ph AS (SELECT item_id, string_agg(CASE WHEN f >= m THEN '1' ELSE '0' END, '' ORDER BY u, z) AS bits FROM low JOIN mid USING (item_id) GROUP BY item_id),
tl AS (SELECT item_id, kind, list(p ORDER BY y, x) AS l, avg(p) AS bright, avg((p >= 245)::INT) AS over, avg((p <= 10)::INT) AS under FROM th WHERE kind <> 'hash' GROUP BY ALL),
lap AS (SELECT item_id, var_pop(l[(y - 1) * {SIZE} + x + 1] + l[(y + 1) * {SIZE} + x + 1] + l[y * {SIZE} + x] + l[y * {SIZE} + x + 2] - 4 * l[y * {SIZE} + x + 1]) AS sharp FROM tl, range(1, {SIZE - 1}) a(y), range(1, {SIZE - 1}) b(x) WHERE kind = 'whole' GROUP BY ALL),
items AS MATERIALIZED (SELECT it.item_id, class_id, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2, ph.bits, a.l AS whole, b.l AS part, a.bright, a.over, a.under, sharp, round(ln(1 + sharp) - abs(a.bright - 128) / 64 - 3 * a.over - 2 * a.under, 9) AS quality
  FROM it JOIN ph USING (item_id) JOIN tl a ON a.item_id = it.item_id AND a.kind = 'whole' JOIN tl b ON b.item_id = it.item_id AND b.kind = 'part' JOIN lap ON lap.item_id = it.item_id)"""


@query
def image_measures(spark: SparkSession, d: str) -> DataFrame:
    """Brightness, contrast, exposure, sharpness and the bits of the perceptual hash of whole images."""
    m = pixels.image_measures(images(spark, d).withColumn("path", F.col("item_id").cast("string")))
    return m.select("path", *(F.round(c, 6).alias(c) for c in ("brightness", "contrast", "overexposed", "underexposed", "sharpness")), F.lpad(F.bin("phash"), 64, "0").alias("phash"))


SQL["image_measures"] = f"""WITH {ITEMS},
base AS (SELECT item_id, list(p ORDER BY y, x) AS l, avg(p) AS brightness, stddev_pop(p) AS contrast, avg((p >= 245)::INT) AS overexposed, avg((p <= 10)::INT) AS underexposed FROM px GROUP BY item_id),
spot AS (SELECT item_id, l, width, y, unnest(range(1, width - 1)) AS x FROM (SELECT item_id, l, width, unnest(range(1, height - 1)) AS y FROM base JOIN it USING (item_id))),
sh AS (SELECT item_id, var_pop(l[(y - 1) * width + x + 1] + l[(y + 1) * width + x + 1] + l[y * width + x] + l[y * width + x + 2] - 4 * l[y * width + x + 1]) AS sharpness FROM spot GROUP BY item_id)
SELECT item_id::VARCHAR AS path, round(brightness, 6) AS brightness, round(contrast, 6) AS contrast, round(overexposed, 6) AS overexposed, round(underexposed, 6) AS underexposed, round(sharpness, 6) AS sharpness, bits AS phash
FROM base JOIN sh USING (item_id) JOIN ph USING (item_id)"""


@query
def thumbnail_measures(spark: SparkSession, d: str) -> DataFrame:
    """Hash bits, thumbnails and quality of every image."""
    made = items(spark, d)
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return made.select("item_id", F.lpad(F.bin("phash"), 64, "0").alias("phash"), hexed("whole"), hexed("part"), F.round("brightness", 6).alias("brightness"), F.round("sharpness", 6).alias("sharpness"), F.round("quality", 6).alias("quality"))


_HEX = "array_to_string(list_transform({}, lambda p: printf('%02x', p::INT)), '')"
SQL["thumbnail_measures"] = f"WITH {ITEMS} SELECT item_id, bits AS phash, {_HEX.format('whole')} AS whole, {_HEX.format('part')} AS part, round(bright, 6) AS brightness, round(sharp, 6) AS sharpness, round(quality, 6) AS quality FROM items"

@query
def crop_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of a crop around the box of every image: a fifth wider and three pixels, whole corners, inside the image."""
    im = images(spark, d)
    far = lambda c, size, side, sign: F.floor(F.col(c) * F.col(side) + sign * (F.col(size) * F.col(side) * 1.2 + 3) / 2)
    boxes = im.select("item_id", F.lit(0).cast("long").alias("box_id"), far("cx", "w", "width", -1).alias("x1"), far("cy", "h", "height", -1).alias("y1"), far("cx", "w", "width", 1).alias("x2"), far("cy", "h", "height", 1).alias("y2"))
    return pixels.crops(im, boxes).select("item_id", "height", "width", F.lower(F.hex("pixels")).alias("pixels"))


_FAR = "floor({c} * {s} {o} ({w} * {s} * 12e-1 + 3) / 2)"
SQL["crop_pixels"] = f"""WITH {ITEMS}, b AS (SELECT item_id, {", ".join(f"{_FAR.format(c=c, s=s, o=o, w=w)} AS {n}" for c, s, w, o, n in (("cx", "width", "w", "-", "x1"), ("cy", "height", "h", "-", "y1"), ("cx", "width", "w", "+", "x2"), ("cy", "height", "h", "+", "y2")))} FROM it)
SELECT item_id, count(DISTINCT y)::INTEGER AS height, count(DISTINCT x)::INTEGER AS width, string_agg(printf('%02x', p::INT), '' ORDER BY y, x) AS pixels FROM px JOIN b USING (item_id) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY item_id"""

_MIRROR = f"CASE WHEN {{0}} < 0 THEN -({{0}}) WHEN {{0}} >= {SIZE} THEN {2 * SIZE - 2} - ({{0}}) ELSE {{0}} END"


def _ssim(kind: str) -> str:
    """a, b and the similarity of their thumbnails of a kind: sums over rows, then over columns."""
    return f"""{kind}_v AS (SELECT a, b, y, x, unnest(range(-5, 6)) AS o, la, lb FROM (SELECT a, b, p.{kind} AS la, q.{kind} AS lb, unnest(range({SIZE})) AS y FROM cand JOIN items p ON p.item_id = a JOIN items q ON q.item_id = b), range({SIZE}) g(x)),
{kind}_r AS (SELECT a, b, y, x, sum(u) AS u, sum(v) AS v, sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv FROM (SELECT a, b, y, x, la[y * {SIZE} + ({_MIRROR.format('(x + o)')}) + 1] AS u, lb[y * {SIZE} + ({_MIRROR.format('(x + o)')}) + 1] AS v FROM {kind}_v) GROUP BY ALL),
{kind}_c AS (SELECT s.a, s.b, t.y, s.x, sum(u) / 121 AS ma, sum(v) / 121 AS mb, sum(uu) / 121 AS maa, sum(vv) / 121 AS mbb, sum(uv) / 121 AS mab FROM {kind}_r s JOIN (SELECT y, {_MIRROR.format('(y + o)')} AS yy FROM range({SIZE}) a(y), range(-5, 6) b(o)) t ON s.y = t.yy GROUP BY ALL),
{kind}_s AS (SELECT a, b, avg((2 * ma * mb + 65025e-4) * (2 * (mab - ma * mb) + 585225e-4) / ((ma * ma + mb * mb + 65025e-4) * (greatest(0, maa - ma * ma) + greatest(0, mbb - mb * mb) + 585225e-4))) AS {kind}_ssim FROM {kind}_c GROUP BY a, b)"""


#: kc: classes of equal content, by their first item; sc: their candidates with all measures
SCORED = f"""{ITEMS},
kc AS (SELECT *, min(item_id) OVER (PARTITION BY whole, part, class_id, x1, y1, x2, y2) AS first_id FROM items),
one AS (SELECT * FROM kc WHERE item_id = first_id),
cand AS MATERIALIZED (SELECT p.item_id AS a, q.item_id AS b, bit_count(xor(p.bits::BIT, q.bits::BIT))::INTEGER AS hamming FROM one p JOIN one q ON p.item_id < q.item_id AND bit_count(xor(p.bits::BIT, q.bits::BIT)) <= {LIMIT}),
{_ssim('whole')}, {_ssim('part')},
ov AS (SELECT a, b, hamming, p.class_id AS class_a, q.class_id AS class_b, greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0e0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0e0) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) AS s FROM cand JOIN one p ON p.item_id = a JOIN one q ON q.item_id = b),
sc AS (SELECT a, b, hamming, whole_ssim, part_ssim AS region_ssim, i / (s - i) AS iou, class_a, class_b FROM ov JOIN whole_s USING (a, b) JOIN part_s USING (a, b))"""


@query
def confirmed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates between classes of equal content, with the similarity of wholes and regions and the overlap of boxes."""
    classes = dedup.content_classes(items(spark, d), ["whole", "part", "class_id", "x1", "y1", "x2", "y2"]).where("item_id = first_id")
    scored = dedup.scored_pairs(written(classes), LIMIT, SIZE)
    return scored.select("a", "b", "hamming", *(F.round(c, 6).alias(c) for c in ("whole_ssim", "region_ssim", "iou")), (F.col("class_a") == F.col("class_b")).alias("same_class"))


SQL["confirmed_pairs"] = f"WITH {SCORED} SELECT a, b, hamming, round(whole_ssim, 6) AS whole_ssim, round(region_ssim, 6) AS region_ssim, round(iou, 6) AS iou, class_a = class_b AS same_class FROM sc"


@query
def confirmed_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of similar images, who stays, and who stands for the others."""
    return dedup.confirmed_duplicates(items(spark, d), LIMIT, SIZE)


SQL["confirmed_duplicates"] = f"""WITH RECURSIVE {SCORED},
e AS MATERIALIZED (SELECT a, b FROM sc WHERE whole_ssim >= 85e-2 UNION ALL SELECT b, a FROM sc WHERE whole_ssim >= 85e-2),
red AS (SELECT a, b FROM sc WHERE whole_ssim >= 95e-2 AND region_ssim >= 95e-2 AND iou >= 9e-1 AND class_a = class_b),
rr AS MATERIALIZED (SELECT a, b FROM red UNION ALL SELECT b, a FROM red),
r(n, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON r.n = e.a),
c AS (SELECT n AS item_id, min(m) AS cluster_id FROM r GROUP BY n),
mem AS (SELECT one.item_id, coalesce(cluster_id, one.item_id) AS cluster_id, quality FROM one LEFT JOIN c ON c.item_id = one.item_id WHERE cluster_id IS NOT NULL OR one.item_id IN (SELECT first_id FROM kc WHERE item_id > first_id)),
near AS (SELECT mem.*, coalesce(list(rr.b) FILTER (WHERE rr.b IS NOT NULL), []) AS near FROM mem LEFT JOIN rr ON rr.a = mem.item_id GROUP BY ALL),
g AS (SELECT cluster_id, list({{'id': item_id, 'near': near}} ORDER BY quality DESC, item_id) AS ms FROM near GROUP BY cluster_id),
f AS (SELECT cluster_id, ms, list_reduce(ms, lambda acc, x: CASE WHEN list_has_any(acc, x.near) THEN acc ELSE list_append(acc, x.id) END, CAST([] AS BIGINT[])) AS reps FROM g),
v AS (SELECT cluster_id, m.id AS first_id, list_contains(reps, m.id) AS kept, CASE WHEN list_contains(reps, m.id) THEN m.id ELSE list_filter(reps, lambda q: list_contains(m.near, q))[1] END AS represented_by FROM (SELECT cluster_id, reps, unnest(ms) AS m FROM f))
SELECT cluster_id, kc.item_id, kept AND kc.item_id = kc.first_id AS kept, represented_by FROM kc JOIN v ON v.first_id = kc.first_id"""
