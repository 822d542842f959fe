"""Queries of detection evaluation and suppression over the fixtures, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.fixtures import fixture, with_sql
from boxlake.functions import boxes as B
from boxlake.operators import evaluate, suppress
from boxlake.operators.scan import written

CLASSES = 6
Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def labels(spark: SparkSession, d: str, gt: DataFrame | None = None) -> DataFrame:
    """Boxes with corners."""
    gt = fixture(spark, d, "gt") if gt is None else gt
    return gt.select("image_id", "label_id", "class_id", "split", *B.to_corners(B.box("cx", "cy", "w", "h")).named("x1", "y1", "x2", "y2"))


def scene(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Labels and detections, both from boxes that are made and written once."""
    gt = written(fixture(spark, d, "gt"))
    return labels(spark, d, gt), fixture(spark, d, "det", gt=gt)


def rounded(df: DataFrame, *columns: str, places: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


LAB = "lab AS (SELECT image_id, label_id, class_id, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2 FROM gt)"
_INTER = "greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0e0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0e0)"
_AREA = "({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1)"


def sql_iou(a: str, b: str, eps: str = "1e-7") -> str:
    inter = _INTER.format(a=a, b=b)
    return f"{inter} / ({_AREA.format(a=a)} + {_AREA.format(a=b)} - {inter} + {eps})"


TP = f"""{LAB},
pairs AS (SELECT l.image_id, l.class_id, l.label_id, d.det_id, d.conf, {sql_iou("l", "d")} AS iou FROM lab l JOIN det d ON l.image_id = d.image_id AND l.class_id = d.class_id),
best AS (SELECT * FROM pairs WHERE iou >= 5e-1 QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, label_id) = 1),
thr AS (SELECT k AS thr, (10 + k) / 20e0 AS t FROM range(10) r(k)),
tp AS (SELECT image_id, class_id, det_id, conf, thr FROM best JOIN thr ON iou >= t QUALIFY row_number() OVER (PARTITION BY image_id, class_id, label_id, thr ORDER BY conf DESC, det_id) = 1)"""

CURVE = f"""{TP},
nl AS (SELECT class_id, count(*) AS n_labels FROM lab GROUP BY class_id),
rows_ AS (SELECT d.class_id, d.image_id, d.det_id, d.conf, thr.thr, (tp.det_id IS NOT NULL)::BIGINT AS tp, n_labels
          FROM det d JOIN nl USING (class_id) CROSS JOIN thr LEFT JOIN tp ON tp.image_id = d.image_id AND tp.det_id = d.det_id AND tp.class_id = d.class_id AND tp.thr = thr.thr),
cum AS (SELECT *, sum(tp) OVER w AS tpc, row_number() OVER w AS n FROM rows_ WINDOW w AS (PARTITION BY class_id, thr ORDER BY conf DESC, image_id, det_id ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT *, tpc / (n_labels + 1e-16) AS recall, tpc / n::DOUBLE AS precision FROM cum),
env AS (SELECT *, max(precision) OVER (PARTITION BY class_id, thr ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope FROM pr)"""

AP = f"""{CURVE},
pts AS (SELECT class_id, thr, n, recall AS r, envelope AS p FROM env UNION ALL SELECT class_id, thr, 0, 0e0, 1e0 FROM nl, thr UNION ALL SELECT class_id, thr, 1000000000, 1e0, 0e0 FROM nl, thr),
seg AS (SELECT class_id, thr, r, p, lead(r) OVER w AS r2, lead(p) OVER w AS p2 FROM pts WINDOW w AS (PARTITION BY class_id, thr ORDER BY n)),
grid AS (SELECT k, k / 100e0 AS x FROM range(101) g(k)),
at_ AS (SELECT class_id, thr, k, CASE WHEN r2 > r THEN p + (p2 - p) * (x - r) / (r2 - r) ELSE p END AS p FROM seg JOIN grid ON x >= r AND x < r2),
ap AS (SELECT nl.class_id, thr.thr, coalesce(sum(p * CASE WHEN k IN (0, 100) THEN 5e-3 ELSE 1e-2 END), 0e0) AS ap
       FROM nl CROSS JOIN thr LEFT JOIN at_ ON at_.class_id = nl.class_id AND at_.thr = thr.thr GROUP BY nl.class_id, thr.thr)"""


@query
def tp_assignment(spark: SparkSession, d: str) -> DataFrame:
    """True positives per class and threshold."""
    return evaluate.true_positives(labels(spark, d), fixture(spark, d, "det")).groupBy("class_id", "thr").agg(F.count("*").alias("n"), F.sum("det_id").alias("det_sum"), F.sum("image_id").alias("image_sum"))


SQL["tp_assignment"] = f"{with_sql('det')}, {TP} SELECT class_id, thr::INTEGER AS thr, count(*) AS n, sum(det_id)::BIGINT AS det_sum, sum(image_id)::BIGINT AS image_sum FROM tp GROUP BY ALL"


@query
def ap_per_class(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.average_precision(*scene(spark, d)), "ap")


SQL["ap_per_class"] = f"{with_sql('det')}, {AP} SELECT class_id, thr::INTEGER AS thr, round(ap, 9) AS ap FROM ap"


@query
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    """All points of the curves at IoU 0.5."""
    c = evaluate.curve(*scene(spark, d))
    return rounded(c.select("class_id", "n", "tpc", "recall", "precision", "envelope"), "recall", "precision", "envelope")


SQL["pr_curve"] = f"{with_sql('det')}, {CURVE} SELECT class_id, n, tpc::BIGINT AS tpc, round(recall, 9) AS recall, round(precision, 9) AS precision, round(envelope, 9) AS envelope FROM env WHERE thr = 0"

GRID = f"""{CURVE},
c0 AS (SELECT class_id, conf, n, recall, precision FROM env WHERE thr = 0),
s0 AS (SELECT *, lead(conf) OVER w AS conf2, lead(recall) OVER w AS recall2, lead(precision) OVER w AS precision2, row_number() OVER w AS rn FROM c0 WINDOW w AS (PARTITION BY class_id ORDER BY n)),
g0 AS (SELECT k, k / 999e0 AS x FROM range(1000) g(k)),
f0 AS (SELECT class_id, k, recall + (recall2 - recall) * (conf - x) / (conf - conf2) AS recall, precision + (precision2 - precision) * (conf - x) / (conf - conf2) AS precision FROM s0 JOIN g0 ON x <= conf AND x > conf2
       UNION ALL SELECT class_id, k, 0e0, 1e0 FROM s0 JOIN g0 ON rn = 1 AND x > conf
       UNION ALL SELECT class_id, k, recall, precision FROM s0 JOIN g0 ON conf2 IS NULL AND x <= conf),
f1 AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-16) AS f1 FROM f0),
m1 AS (SELECT k, sum(f1) / (SELECT count(*) FROM nl) AS f FROM f1 GROUP BY k),
e1 AS (SELECT k, coalesce(m1.f, CASE WHEN k < 0 THEN (SELECT f FROM m1 WHERE k = 0) ELSE (SELECT f FROM m1 WHERE k = 999) END) AS f FROM range(-50, 1050) g(k) LEFT JOIN m1 USING (k)),
w1 AS (SELECT k, avg(f) OVER (ORDER BY k ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS s FROM e1),
b1 AS (SELECT k FROM w1 WHERE k BETWEEN 0 AND 999 ORDER BY round(s, 9) DESC, k LIMIT 1),
op AS (SELECT class_id, n_labels, k / 999e0 AS conf, precision, recall, f1, round_even(recall * n_labels, 0) AS tp FROM f1 JOIN b1 USING (k) JOIN nl USING (class_id))"""


@query
def f1_operating_point(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.operating_point(*scene(spark, d)), "conf", "precision", "recall", "f1")


SQL["f1_operating_point"] = f"{with_sql('det')}, {GRID} SELECT class_id, n_labels, round(conf, 9) AS conf, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, tp, round_even(tp / (precision + 1e-16) - tp, 0) AS fp FROM op"


@query
def map_summary(spark: SparkSession, d: str) -> DataFrame:
    lab, det = scene(spark, d)
    cells = evaluate.curve_cells(lab, det)
    return rounded(evaluate.map_summary(evaluate.average_precision(lab, det, cells=cells), evaluate.operating_point(lab, det, cells=cells)), "mp", "mr", "map50", "map")


SQL["map_summary"] = f"""{with_sql('det')}, {AP}, {GRID[len(CURVE) + 2:]} SELECT round(avg(precision), 9) AS mp, round(avg(recall), 9) AS mr, sum(n_labels)::BIGINT AS n_labels,
(SELECT round(avg(ap), 9) FROM ap WHERE thr = 0) AS map50, (SELECT round(avg(ap), 9) FROM ap) AS map FROM op"""


CM = f"""{LAB}, seen AS (SELECT * FROM det WHERE conf > 25e-2),
p0 AS (SELECT l.image_id, l.label_id, l.class_id AS tc, d.det_id, d.class_id AS pc, {sql_iou("l", "d")} AS iou FROM lab l JOIN seen d ON l.image_id = d.image_id),
p1 AS (SELECT * FROM p0 WHERE iou > 45e-2 QUALIFY row_number() OVER (PARTITION BY image_id, det_id ORDER BY iou DESC, label_id) = 1),
p2 AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY image_id, label_id ORDER BY iou DESC, det_id) = 1),
cm AS (SELECT pred_class, true_class, count(*) AS n FROM (
  SELECT pc AS pred_class, tc AS true_class FROM p2
  UNION ALL SELECT 6, class_id FROM lab WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.image_id = lab.image_id AND p2.label_id = lab.label_id)
  UNION ALL SELECT class_id, 6 FROM seen s WHERE image_id IN (SELECT image_id FROM p2) AND NOT EXISTS (SELECT 1 FROM p2 WHERE p2.image_id = s.image_id AND p2.det_id = s.det_id)) GROUP BY ALL)"""


@query
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(*scene(spark, d), CLASSES)


SQL["confusion_matrix"] = f"{with_sql('det')}, {CM} SELECT pred_class::BIGINT AS pred_class, true_class::BIGINT AS true_class, n FROM cm"


@query
def confusion_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.normalised(evaluate.confusion(*scene(spark, d), CLASSES)), "share")


SQL["confusion_shares"] = f"""{with_sql('det')}, {CM}, s AS (SELECT *, n / (sum(n) OVER (PARTITION BY true_class) + 1e-9) AS share FROM cm)
SELECT pred_class::BIGINT AS pred_class, true_class::BIGINT AS true_class, CASE WHEN share >= 5e-3 THEN round(share, 9) END AS share FROM s"""


@query
def confusion_tp_fp(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.per_class_counts(evaluate.confusion(*scene(spark, d), CLASSES), CLASSES)


SQL["confusion_tp_fp"] = f"""{with_sql('det')}, {CM} SELECT pred_class::BIGINT AS class_id, sum(CASE WHEN pred_class = true_class THEN n ELSE 0 END)::BIGINT AS tp, (sum(n) - sum(CASE WHEN pred_class = true_class THEN n ELSE 0 END))::BIGINT AS fp
FROM cm WHERE pred_class < 6 GROUP BY pred_class"""


def _nms_sql(keys: str, conf: str = "25e-2", thr: str = "45e-2") -> str:
    inter = "greatest(least(a.x2, x.x2) - greatest(a.x1, x.x1), 0e0) * greatest(least(a.y2, x.y2) - greatest(a.y1, x.y1), 0e0)"
    iou = f"{inter} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (x.x2 - x.x1) * (x.y2 - x.y1) - {inter})"
    return f"""grp AS (SELECT {keys}, list({{'det_id': det_id, 'class_id': class_id, 'conf': conf, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY conf DESC, det_id) AS b FROM det WHERE conf > {conf} GROUP BY {keys}),
kept0 AS (SELECT {keys}, unnest(list_reduce(b, lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: {iou} > {thr})) > 0 THEN acc ELSE list_append(acc, x) END, b[1:0])) AS k FROM grp),
kept AS (SELECT image_id, k.det_id AS det_id, k.class_id AS class_id, k.conf AS conf FROM kept0)"""


@query
def nms(spark: SparkSession, d: str) -> DataFrame:
    return suppress.nms(fixture(spark, d, "det"))


SQL["nms"] = f"{with_sql('det')}, {_nms_sql('image_id, class_id')} SELECT image_id, det_id, class_id, conf FROM kept"


@query
def nms_agnostic_padded(spark: SparkSession, d: str) -> DataFrame:
    return suppress.padded_nms(fixture(spark, d, "det"), top_k=4)


SQL["nms_agnostic_padded"] = f"""{with_sql('det')}, {_nms_sql('image_id')}, top AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) - 1 AS slot FROM kept)
SELECT i.image_id, s.slot::INTEGER AS slot, coalesce(class_id, -1)::BIGINT AS class_id, coalesce(conf, 0e0) AS conf FROM (SELECT DISTINCT image_id FROM det) i CROSS JOIN range(4) s(slot) LEFT JOIN top ON top.image_id = i.image_id AND top.slot = s.slot"""


@query
def merge_nms(spark: SparkSession, d: str) -> DataFrame:
    det = fixture(spark, d, "det")
    return rounded(suppress.merged(det.where("conf > 0.25"), suppress.nms(det)), "x1", "y1", "x2", "y2", places=6)


SQL["merge_nms"] = f"""{with_sql('det')}, {_nms_sql('image_id, class_id')}, k AS (SELECT d.* FROM kept JOIN det d USING (image_id, det_id))
SELECT k.image_id, k.det_id AS kept_id, count(*) AS n, round(sum(d.conf * d.x1) / sum(d.conf), 6) AS x1, round(sum(d.conf * d.y1) / sum(d.conf), 6) AS y1, round(sum(d.conf * d.x2) / sum(d.conf), 6) AS x2, round(sum(d.conf * d.y2) / sum(d.conf), 6) AS y2
FROM k JOIN det d ON d.conf > 25e-2 AND k.image_id = d.image_id AND k.class_id = d.class_id AND {sql_iou("k", "d")} > 45e-2 GROUP BY ALL HAVING count(*) > 1"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    det = fixture(spark, d, "det")
    scores = F.array(*(F.pmod(F.col("det_id") * (c + 3) + F.col("image_id") * 7, F.lit(10)) / 10.0 for c in range(CLASSES)))
    return det.select("image_id", F.col("det_id").alias("cand_id"), F.col("conf").alias("obj"), scores.alias("scores"))


_RAW = "raw AS (SELECT image_id, det_id AS cand_id, conf AS obj, [" + ", ".join(f"(det_id * {c + 3} + image_id * 7) % 10 / 10e0" for c in range(CLASSES)) + "] AS s FROM det)"


@query
def multi_label_expand(spark: SparkSession, d: str) -> DataFrame:
    return rounded(suppress.expand_classes(_raw(spark, d), 0.3), "conf")


SQL["multi_label_expand"] = f"{with_sql('det')}, {_RAW}, e AS (SELECT image_id, cand_id, obj, c::INTEGER AS class_id, s[c + 1] * obj AS conf FROM raw, range(6) r(c) WHERE obj > 3e-1) SELECT image_id, cand_id, class_id, round(conf, 9) AS conf FROM e WHERE conf > 3e-1"


@query
def best_label_expand(spark: SparkSession, d: str) -> DataFrame:
    return rounded(suppress.expand_classes(_raw(spark, d), 0.3, multi_label=False), "conf")


SQL["best_label_expand"] = f"""{with_sql('det')}, {_RAW}, e AS (SELECT image_id, cand_id, c::INTEGER AS class_id, s[c + 1] * obj AS conf FROM raw, range(6) r(c) WHERE obj > 3e-1 QUALIFY row_number() OVER (PARTITION BY image_id, cand_id ORDER BY s[c + 1] * obj DESC, c) = 1)
SELECT image_id, cand_id, class_id, round(conf, 9) AS conf FROM e WHERE conf > 3e-1"""


#: another detector: it sees other labels, is surer of small boxes, and draws them wider
_SECOND = """SELECT image_id, label_id * 3 + 100000 AS det_id, CASE WHEN k % 23 = 0 THEN (class_id + 3) % 6 ELSE class_id END AS class_id, CAST((k * 41) % 600 + CASE WHEN w * h < 4000 THEN 400 ELSE 1 END AS DOUBLE) / 1000 AS conf,
 cx - w * 55e-2 + k % 4 AS x1, cy - h * 52e-2 AS y1, cx + w * 55e-2 + k % 4 AS x2, cy + h * 52e-2 AS y2 FROM (SELECT *, image_id * 89 + label_id * 37 AS k FROM {gt}) q WHERE k % 6 <> 0"""


@query
def ensemble_nms(spark: SparkSession, d: str) -> DataFrame:
    """Two detectors' boxes are pooled, labels of every third image join as certain detections, then suppression."""
    det, lab = fixture(spark, d, "det"), labels(spark, d)
    cols = ["image_id", "det_id", "class_id", "conf", "x1", "y1", "x2", "y2"]
    sure = lab.where("image_id % 3 = 0").select("image_id", (F.col("label_id") + 1000).alias("det_id"), "class_id", F.lit(1.0).alias("conf"), "x1", "y1", "x2", "y2")
    second = spark.sql(_SECOND, gt=fixture(spark, d, "gt"))
    return suppress.nms(det.select(cols).unionByName(second.select(cols)).unionByName(sure))


SQL["ensemble_nms"] = f"""{with_sql('det')}, {LAB}, second AS ({_SECOND.replace('{gt}', 'gt')}),
pool AS (SELECT image_id, det_id, class_id, conf, x1, y1, x2, y2 FROM det UNION ALL SELECT image_id, det_id, class_id, conf, x1, y1, x2, y2 FROM second UNION ALL SELECT image_id, label_id + 1000, class_id, 1e0, x1, y1, x2, y2 FROM lab WHERE image_id % 3 = 0),
{_nms_sql('image_id, class_id').replace('FROM det WHERE', 'FROM pool WHERE')} SELECT image_id, det_id, class_id, conf FROM kept"""


@query
def second_stage_filter(spark: SparkSession, d: str) -> DataFrame:
    """Detections whose class a second classifier repeats."""
    det = fixture(spark, d, "det")
    second = det.select("image_id", "det_id", F.when((F.col("image_id") + F.col("det_id")) % 4 == 0, (F.col("class_id") + 1) % 6).otherwise(F.col("class_id")).alias("class_id"))
    return suppress.agreed(det, second).groupBy("class_id").agg(F.count("*").alias("n"))


SQL["second_stage_filter"] = f"{with_sql('det')} SELECT class_id, count(*) AS n FROM det WHERE (image_id + det_id) % 4 <> 0 GROUP BY class_id"


@query
def mask_iou(spark: SparkSession, d: str) -> DataFrame:
    """IoU of coarse masks: the 40-pixel tiles that a box touches; boxes are dealt out by image before they become tiles."""
    lab, det = labels(spark, d), fixture(spark, d, "det")

    def tiles(df: DataFrame, key: str) -> DataFrame:
        span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 40), F.floor(F.col(b) / 40)))
        return df.repartition("image_id").select("image_id", F.col(key).alias("mask_id"), span("x1", "x2").alias("tx"), "y1", "y2").select("image_id", "mask_id", "tx", span("y1", "y2").alias("ty")).select("image_id", "mask_id", (F.col("tx") * 1000 + F.col("ty")).alias("pixel"))

    return rounded(evaluate.mask_iou(tiles(lab, "label_id"), tiles(det, "det_id")), "iou")


def _tiles(name: str, key: str, source: str) -> str:
    return f"{name} AS (SELECT image_id, {key} AS id, tx * 1000 + ty AS px FROM (SELECT image_id, {key}, y1, y2, unnest(range(floor(x1 / 40)::BIGINT, floor(x2 / 40)::BIGINT + 1)) AS tx FROM {source}) a, LATERAL (SELECT unnest(range(floor(y1 / 40)::BIGINT, floor(y2 / 40)::BIGINT + 1)) AS ty))"


SQL["mask_iou"] = f"""{with_sql('det')}, {LAB}, {_tiles('lt', 'label_id', 'lab')}, {_tiles('dt', 'det_id', 'det')},
ln AS (SELECT image_id, id, count(*) AS n FROM lt GROUP BY ALL), dn AS (SELECT image_id, id, count(*) AS n FROM dt GROUP BY ALL),
x AS (SELECT lt.image_id, lt.id AS l, dt.id AS r, count(*) AS i FROM lt JOIN dt ON lt.image_id = dt.image_id AND lt.px = dt.px GROUP BY ALL)
SELECT x.image_id, l AS left_id, r AS right_id, round(i / (ln.n + dn.n - i + 1e-7), 9) AS iou FROM x JOIN ln ON ln.image_id = x.image_id AND ln.id = l JOIN dn ON dn.image_id = x.image_id AND dn.id = r"""


@query
def iou_family(spark: SparkSession, d: str) -> DataFrame:
    """All IoU relatives of labels and detections of one image and class."""
    gt, det = fixture(spark, d, "gt"), fixture(spark, d, "det")
    c = B.to_centre(B.box("x1", "y1", "x2", "y2"))
    other = det.select("image_id", "class_id", "det_id", *c.named("px", "py", "pw", "ph"), "x1", "y1", "x2", "y2")
    j = gt.join(other, ["image_id", "class_id"])
    p, q = B.box("px", "py", "pw", "ph"), B.box("cx", "cy", "w", "h")
    f = B.iou_family(p, q) | {"plain": B.iou_or_zero(B.box("x1", "y1", "x2", "y2"), B.to_corners(q)), "ioa": B.ioa(B.to_corners(p), B.to_corners(q)), "wh": B.wh_iou(p.c, p.d, q.c, q.d)}
    return j.select("image_id", "label_id", "det_id", *(F.round(v, 6).alias(k) for k, v in f.items()))


SQL["iou_family"] = f"""{with_sql('det')}, j AS (SELECT gt.image_id, label_id, det_id, cx, cy, w, h, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py, x2 - x1 AS pw, y2 - y1 AS ph, cx - w / 2 AS gx1, cy - h / 2 AS gy1, cx + w / 2 AS gx2, cy + h / 2 AS gy2, x1, y1, x2, y2
  FROM gt JOIN det ON gt.image_id = det.image_id AND gt.class_id = det.class_id),
i AS (SELECT *, greatest(least(x2, gx2) - greatest(x1, gx1), 0e0) * greatest(least(y2, gy2) - greatest(y1, gy1), 0e0) AS inter, greatest(x2, gx2) - least(x1, gx1) AS cw, greatest(y2, gy2) - least(y1, gy1) AS ch, cx - px AS gapx, cy - py AS gapy, cx - px + 1e-7 AS sx, cy - py + 1e-7 AS sy FROM j),
u AS (SELECT *, pw * ph + w * h - inter + 1e-7 AS un, (4 / (pi() * pi())) * (atan(w / h) - atan(pw / ph)) * (atan(w / h) - atan(pw / ph)) AS v, (gapx * gapx + gapy * gapy) / (cw * cw + ch * ch + 1e-7) AS near, sqrt(sx * sx + sy * sy) AS sg FROM i),
a AS (SELECT *, inter / un AS io, CASE WHEN abs(sx) / sg > sqrt(2e0) / 2 THEN abs(sy) / sg ELSE abs(sx) / sg END AS sn FROM u),
b AS (SELECT *, cos(asin(sn) * 2 - pi() / 2) AS ang, power(1 - exp(-abs(pw - w) / greatest(pw, w)), 4) + power(1 - exp(-abs(ph - h) / greatest(ph, h)), 4) AS shp FROM a)
SELECT image_id, label_id, det_id, round(io, 6) AS iou, round(io - (cw * ch + 1e-7 - un) / (cw * ch + 1e-7), 6) AS giou, round(io - near, 6) AS diou, round(io - (near + v * v / (v - io + (1 + 1e-7))), 6) AS ciou,
  round(io - (near + (w - pw) * (w - pw) / (cw * cw + 1e-7) + (h - ph) * (h - ph) / (ch * ch + 1e-7)), 6) AS eiou,
  round(io - 5e-1 * (2 - exp((ang - 2) * (sx / cw) * (sx / cw)) - exp((ang - 2) * (sy / ch) * (sy / ch)) + shp), 6) AS siou, round(inter / (un + 1e-7), 6) AS alpha_iou, round(sqrt(inter / (un + 1e-7)), 6) AS focal,
  round(CASE WHEN pw * ph + (gx2 - gx1) * (gy2 - gy1) - inter > 0 THEN inter / (pw * ph + (gx2 - gx1) * (gy2 - gy1) - inter) ELSE 0 END, 6) AS plain, round(inter / (w * h + 1e-7), 6) AS ioa, round(least(pw, w) * least(ph, h) / (pw * ph + w * h - least(pw, w) * least(ph, h) + 1e-7), 6) AS wh FROM b"""
