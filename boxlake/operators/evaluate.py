"""Detection evaluation: matching, precision and recall, average precision, confusion.

Boxes and detections of an image meet in an equi-join on (image, class); the
windows that follow are keyed by the same columns, so matching is one shuffle
of each table.  Curves are scanned in chunks of confidence (see scan), so one
frequent class is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions.boxes import box, iou
from boxlake.operators.scan import maxima_from_here, running_sums, written

N_THR = 10
CHUNKS = 256


def threshold(k: Column) -> Column:
    """0.50, 0.55 ... 0.95 for k = 0 ... 9."""
    return (F.lit(10) + k) / F.lit(20.0)


def overlaps(labels: DataFrame, detections: DataFrame, least: float, by_class: bool, strict: bool = False, all_detections: bool = False) -> DataFrame:
    """Pairs of one image (and class) whose IoU reaches least; labels and detections carry corners x1, y1, x2, y2.

    all_detections: one without a label comes too, with nulls.
    """
    lab = labels.select("image_id", "label_id", F.col("class_id").alias("label_class"), *(F.col(c).alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")))
    on = [F.col("image_id") == F.col("l_image")]
    if by_class:
        on.append(F.col("class_id") == F.col("label_class"))
    value = iou(box("lx1", "ly1", "lx2", "ly2"), box("x1", "y1", "x2", "y2"))
    on.append(value > least if strict else value >= least)
    pairs = detections.join(lab.withColumnRenamed("image_id", "l_image"), on, "left" if all_detections else "inner").withColumn("iou", value)
    return pairs.select("image_id", "det_id", "class_id", "conf", "label_id", "label_class", "iou")


def matched(pairs: DataFrame) -> DataFrame:
    """image_id, class_id, det_id, conf, reached, level of detections, of overlaps of at least 0.5: a true positive at the thresholds from reached up to level, without it.

    A detection takes the label of its class with the largest IoU; a label takes
    the most confident of its detections, at each threshold of those that reach
    it.  So a detection counts at the thresholds that it reaches and no more
    confident one of its label did.  det_id is unique in an image and class.
    """
    best = Window.partitionBy("image_id", "class_id", "det_id").orderBy(F.desc("iou"), "label_id")
    taken = pairs.withColumn("rank", F.rank().over(best)).where("rank = 1")
    level = F.lit(0)
    for k in range(N_THR):
        level = F.when(F.col("iou") >= threshold(F.lit(k)), k + 1).otherwise(level)
    before = Window.partitionBy("image_id", "class_id", "label_id").orderBy(F.desc("conf"), "det_id").rowsBetween(Window.unboundedPreceding, -1)
    out = taken.withColumn("level", level)
    return out.withColumn("reached", F.coalesce(F.max("level").over(before), F.lit(0))).select("image_id", "class_id", "det_id", "conf", "reached", "level")


def true_positives(labels: DataFrame, detections: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """image_id, class_id, det_id, conf, thr of the detections that count as true positives at each threshold.

    pairs are overlaps of at least 0.5, those of the boxes unless others (of
    masks) are given; these are dealt out by image and class once, as functions
    in Python lose how the join dealt them.
    """
    pairs = overlaps(labels, detections, 0.5, by_class=True) if pairs is None else pairs.repartition("image_id", "class_id")
    counted = matched(pairs).where("level > reached")
    return counted.select("image_id", "class_id", "det_id", "conf", F.explode(F.sequence(F.col("reached"), F.col("level") - 1)).alias("thr"))


def with_hits(labels: DataFrame, detections: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """class_id, image_id, det_id, conf, n_labels and hits (bit k: true positive at threshold k) of the detections of classes that labels have."""
    n_labels = labels.groupBy(F.col("class_id").alias("of_class")).agg(F.count("*").alias("n_labels"))  # one row per class
    bits = F.when(F.col("level") > F.col("reached"), F.expr("shiftleft(1L, level) - shiftleft(1L, reached)")).otherwise(F.lit(0).cast("long"))
    known = F.col("class_id") == F.col("of_class")
    if pairs is None:  # detections meet their labels once and aren't dealt out again
        every = matched(overlaps(labels, detections, 0.5, by_class=True, all_detections=True)).withColumn("hits", F.when(F.col("det_id").isNotNull(), bits).otherwise(F.lit(0).cast("long")))
        return every.join(F.broadcast(n_labels), known).select("image_id", "class_id", "det_id", "conf", "n_labels", "hits")
    hits = matched(pairs.repartition("image_id", "class_id")).groupBy("image_id", "class_id", "det_id").agg(F.sum(bits).alias("hits"))
    rows = detections.select("image_id", "class_id", "det_id", "conf").join(F.broadcast(n_labels), known).drop("of_class")
    return rows.join(hits, ["image_id", "class_id", "det_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def confidence_chunk(detections: DataFrame) -> Column:
    """A chunk number that rises as confidence falls; cuts are quantiles of confidence."""
    cuts = detections.agg(F.percentile_approx("conf", [i / CHUNKS for i in range(1, CHUNKS)], 10_000)).first()[0] or []  # CHUNKS numbers, however confidences are spread
    return larger_cuts(sorted(set(cuts), reverse=True), F.col("conf"))


def larger_cuts(cuts: list[float], value: Column) -> Column:
    """How many of the falling cuts are larger than a value: whole blocks of sixteen first, then those of one block."""
    if not cuts:
        return F.lit(0)
    blocks = [cuts[i : i + 16] for i in range(0, len(cuts), 16)]
    count = lambda some: F.size(F.filter(some, lambda c: c > value))
    full = count(F.array(*(F.lit(b[-1]) for b in blocks)))
    nested = F.array(*(F.array(*map(F.lit, b)) for b in blocks))
    return F.aggregate(F.array(full), F.lit(0), lambda _, n: n * 16 + F.when(n < len(blocks), count(F.get(nested, n))).otherwise(len(cuts) - 16 * len(blocks)))


def ranking() -> list[Column]:
    """Order of detections of a class: confidence, then image and detection."""
    return [F.desc("conf"), F.asc("image_id"), F.asc("det_id")]


def hit(k: int) -> Column:
    return F.getbit("hits", F.lit(k)).cast("long")


def curve(labels: DataFrame, detections: DataFrame, thr: int = 0, pairs: DataFrame | None = None) -> DataFrame:
    """Per class one row for every detection in order of confidence, at one threshold: tpc, n, n_labels, recall, precision, envelope.

    Only classes that labels have; rows with equal confidence are ordered by image and detection.
    """
    rows = with_hits(labels, detections, pairs).withColumns({"tp": hit(thr), "one": F.lit(1).cast("long")}).drop("hits")
    sums = written(running_sums(rows, ["class_id"], confidence_chunk(detections), ranking(), {"n": "one", "tpc": "tp"}, null_keys=False).drop("tp", "one"))
    sums = sums.withColumn("precision", F.col("tpc") / F.col("n").cast("double"))
    tops = maxima_from_here(sums, ["class_id"], "n", {"envelope": "precision"}, null_keys=False)
    return tops.drop("__chunk").withColumns({"recall": F.col("tpc") / (F.col("n_labels") + F.lit(1e-16)), "thr": F.lit(thr)})


def curve_cells(labels: DataFrame, detections: DataFrame, pairs: DataFrame | None = None, points: int = 1000) -> DataFrame:
    """All curves of all classes, as far as they count, in one small table: class_id, thr, k, best, and of the first and last row of a cell first_n, last_n, first_j, last_j, high, low.

    Rows with thr 0 to 9 are true positives with a recall in ((k - 1) / 100, k / 100]
    and their best precision: precision between two true positives only falls, so
    nothing else of a curve counts for its AP.  Rows with thr -1 are detections with
    a confidence in [k, k + 1) / (points - 1), for the curve at IoU 0.5.  n is a rank
    and j the number of true positives up to it.  Detections are written with their
    hits in a few bytes each, then ranked and counted for all thresholds in one pass.
    """
    hits = with_hits(labels, detections, pairs).drop("n_labels").withColumn("__chunk", confidence_chunk(detections))
    rows = written(hits).withColumns({"one": F.lit(1).cast("long"), **{f"t{k}": hit(k) for k in range(N_THR)}})
    ranked = running_sums(rows, ["class_id"], F.col("__chunk"), ranking(), {"n": "one", **{f"j{k}": f"t{k}" for k in range(N_THR)}}, null_keys=False)
    n_labels = labels.groupBy(F.col("class_id").alias("of_class")).agg(F.count("*").alias("n_labels"))  # one row per class
    ranked = ranked.join(F.broadcast(n_labels), F.col("class_id") == F.col("of_class"))
    null = F.lit(None).cast("long")
    spots = F.array(F.struct(F.lit(-1).alias("thr"), F.col("j0").alias("j")), *(F.struct(F.lit(k).alias("thr"), F.when(F.col(f"t{k}") > 0, F.col(f"j{k}")).otherwise(null).alias("j")) for k in range(N_THR)))
    each = ranked.select("class_id", "conf", "n", "n_labels", F.inline(F.filter(spots, lambda p: p["j"].isNotNull())))
    recall = F.col("j") / (F.col("n_labels") + F.lit(1e-16))
    up = F.ceil(recall * 100)
    by_recall = F.when((up - 1) / 100.0 >= recall, up - 1).when(up / 100.0 < recall, up + 1).otherwise(up)
    step = float(points - 1)
    down = F.floor(F.col("conf") * step)
    by_conf = F.when(down / step > F.col("conf"), down - 1).when((down + 1) / step <= F.col("conf"), down + 1).otherwise(down)
    cell = F.when(F.col("thr") < 0, by_conf).otherwise(by_recall)
    ends = {"first_n": F.min("n"), "last_n": F.max("n"), "first_j": F.min("j"), "last_j": F.max("j"), "high": F.max("conf"), "low": F.min("conf")}
    best = F.max(F.col("j") / F.col("n").cast("double"))
    return written(each.groupBy("class_id", "thr", cell.alias("k")).agg(best.alias("best"), *(v.alias(c) for c, v in ends.items())))


def average_precision(labels: DataFrame, detections: DataFrame, pairs: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """class_id, thr, ap for every class that labels have: 101-point interpolation of the envelope over recall, by trapezoids.

    At a recall that some later true positive exceeds, the envelope is the best
    precision of those.  Before the first one (if it also ranks first) a line
    falls from precision 1 at recall 0; after the last one a line falls to 0 at
    recall 1, from the precision over all detections.  cells are curve_cells, if
    they are there already.
    """
    cells = (curve_cells(labels, detections, pairs) if cells is None else cells).where("thr >= 0").select("class_id", "thr", "k", "best", F.col("last_j").alias("hits"), "first_n")
    sizes = labels.groupBy("class_id").agg(F.count("*").alias("n_labels")).join(detections.groupBy("class_id").agg(F.count("*").alias("n_class")), "class_id", "left")
    curves = sizes.withColumn("thr", F.explode(F.sequence(F.lit(0), F.lit(N_THR - 1))))  # classes x 10
    grid = curves.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(100).cast("long")))).join(cells, ["class_id", "thr", "k"], "left")
    one = Window.partitionBy("class_id", "thr")  # 101 rows
    later = one.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumns({"above": F.max("best").over(later), "top": F.max("best").over(one), "found": F.coalesce(F.max("hits").over(one), F.lit(0)), "first_rank": F.min("first_n").over(one)})
    x, labels_ = F.col("k") / 100.0, F.col("n_labels") + F.lit(1e-16)
    first, last = 1 / labels_, F.col("found") / labels_
    falling = F.col("found") / F.col("n_class").cast("double") * (1 - F.try_divide(x - last, 1 - last))
    rising = F.when((F.col("first_rank") == 1) & (x < first), 1 + (F.col("top") - 1) * x / first).otherwise(F.col("above"))
    value = F.when((F.col("k") == 100) | (F.col("found") == 0), 0.0).when(F.col("above").isNull(), falling).otherwise(rising)
    weight = F.when(F.col("k").isin(0, 100), 0.005).otherwise(0.01)
    return grid.groupBy("class_id", "thr").agg(F.sum(value * weight).alias("ap"))


def operating_grid(labels: DataFrame, detections: DataFrame, points: int = 1000, eps: float = 1e-16, curves: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """class_id, k, recall, precision, f1 on a grid of confidences k / (points - 1) at IoU 0.5; the curve is linear between its rows.

    Rows are reduced to the first and last of each cell of confidence before anything
    is ordered, unless these come as cells (curve_cells with the same points).
    """
    step = float(points - 1)
    if curves is None:
        found = (curve_cells(labels, detections, points=points) if cells is None else cells).where("thr < 0")
        n_labels = labels.groupBy(F.col("class_id").alias("of_class")).agg(F.count("*").alias("n_labels"))  # one row per class
        spot = lambda conf, j, n: F.struct(F.col(conf).alias("conf"), (F.col(j) / (F.col("n_labels") + F.lit(1e-16))).alias("recall"), (F.col(j) / F.col(n).cast("double")).alias("precision"))
        cells = found.join(F.broadcast(n_labels), F.col("class_id") == F.col("of_class")).select("class_id", "k", spot("high", "first_j", "first_n").alias("first"), spot("low", "last_j", "last_n").alias("last"))
    else:
        low = F.floor(F.col("conf") * step)
        cell = F.when(low / step > F.col("conf"), low - 1).when((low + 1) / step <= F.col("conf"), low + 1).otherwise(low)  # conf in [cell, cell + 1) / step
        spot = F.struct("conf", "recall", "precision")
        cells = curves.groupBy("class_id", cell.alias("k")).agg(F.min_by(spot, "n").alias("first"), F.max_by(spot, "n").alias("last"))
    classes = labels.select("class_id").distinct()
    grid = classes.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long")))).join(cells, ["class_id", "k"], "left")
    w = Window.partitionBy("class_id").orderBy("k")
    x = F.col("k") / step
    grid = grid.withColumns({"h": F.first("last", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), "l": F.last("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    line = lambda c: F.col(f"h.{c}") + (F.col(f"l.{c}") - F.col(f"h.{c}")) * (F.col("h.conf") - x) / (F.col("h.conf") - F.col("l.conf"))
    known = grid.where("h IS NOT NULL OR l IS NOT NULL")  # a class without detections has no curve
    out = known.select("class_id", "k", *(F.when(F.col("h").isNull(), above).when(F.col("l").isNull(), F.col(f"h.{c}")).otherwise(line(c)).alias(c) for c, above in (("recall", 0.0), ("precision", 1.0))))
    return out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))


def smooth(df: DataFrame, order: str, value: str, points: int, share: float = 0.05) -> DataFrame:
    """df with value smoothed by a box filter of an odd number of rows; the ends are repeated.  For grids of a fixed number of points."""
    width = round(points * share * 2) // 2 + 1
    half = width // 2
    w = Window.orderBy(order)
    ends = df.agg(F.min_by(value, order).alias("__first"), F.max_by(value, order).alias("__last"))  # one row
    rows = df.withColumn("__i", F.row_number().over(w) - 1).crossJoin(F.broadcast(ends))
    near = F.sum(value).over(w.rowsBetween(-half, half))
    left, right = F.greatest(F.lit(0), half - F.col("__i")), F.greatest(F.lit(0), F.col("__i") + half - (points - 1))
    return rows.withColumn("smooth", (near + left * F.col("__first") + right * F.col("__last")) / width).drop("__i", "__first", "__last")


def operating_point(labels: DataFrame, detections: DataFrame, points: int = 1000, eps: float = 1e-16, curves: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Per class precision, recall, f1, tp and fp at the confidence with the largest smoothed mean F1."""
    grid = operating_grid(labels, detections, points, eps, curves, cells)
    n_labels = labels.groupBy(F.col("class_id").alias("c")).agg(F.count("*").alias("n_labels"))
    mean = grid.groupBy("k").agg((F.sum("f1") / labels.select("class_id").distinct().count()).alias("f1_mean"))
    best = smooth(mean, "k", "f1_mean", points, 0.1).withColumn("smooth", F.round("smooth", 9)).orderBy(F.desc("smooth"), "k").limit(1).select(F.col("k").alias("best_k"))
    at = grid.join(F.broadcast(best), F.col("k") == F.col("best_k")).join(F.broadcast(n_labels), F.col("class_id") == F.col("c"))
    tp = F.rint(F.col("recall") * F.col("n_labels"))
    return at.select("class_id", "n_labels", (F.col("k") / (points - 1)).alias("conf"), "precision", "recall", "f1", tp.alias("tp"), F.rint(tp / (F.col("precision") + eps) - tp).alias("fp"))


def map_summary(ap: DataFrame, point: DataFrame) -> DataFrame:
    """Means over classes: precision, recall, AP at 0.5, AP over all thresholds."""
    a = ap.agg(F.avg(F.when(F.col("thr") == 0, F.col("ap"))).alias("map50"), F.avg("ap").alias("map"))
    p = point.agg(F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.sum("n_labels").alias("n_labels"))
    return p.crossJoin(F.broadcast(a))  # one row each


def confusion(labels: DataFrame, detections: DataFrame, classes: int, conf: float = 0.25, least: float = 0.45) -> DataFrame:
    """pred_class, true_class, n; the class after the last stands for background.

    Images without labels don't count; a detection without a match counts only if its image has a match.
    """
    seen = detections.where(F.col("conf") > conf)
    pairs = overlaps(labels, seen, least, by_class=False, strict=True)
    by_det = Window.partitionBy("image_id", "det_id").orderBy(F.desc("iou"), "label_id")
    by_label = Window.partitionBy("image_id", "label_id").orderBy(F.desc("iou"), "det_id")
    pairs = pairs.withColumn("rank", F.row_number().over(by_det)).where("rank = 1").withColumn("rank", F.row_number().over(by_label)).where("rank = 1")
    met = pairs.select("image_id", "det_id", "label_id", "class_id", "label_class")
    hits = met.select(F.col("class_id").alias("pred_class"), F.col("label_class").alias("true_class"))
    missed = labels.join(met.select("image_id", "label_id"), ["image_id", "label_id"], "left_anti").select(F.lit(classes).cast("long").alias("pred_class"), F.col("class_id").alias("true_class"))
    with_match = met.select("image_id").distinct()
    false = seen.join(with_match, "image_id", "left_semi").join(met.select("image_id", "det_id"), ["image_id", "det_id"], "left_anti").select(F.col("class_id").alias("pred_class"), F.lit(classes).cast("long").alias("true_class"))
    return hits.unionByName(missed).unionByName(false).groupBy("pred_class", "true_class").agg(F.count("*").alias("n"))


def normalised(matrix: DataFrame) -> DataFrame:
    """Cells as shares of their true class; null below 0.005."""
    share = F.col("n") / (F.sum("n").over(Window.partitionBy("true_class")) + 1e-9)  # classes^2 rows
    return matrix.select("pred_class", "true_class", F.when(share >= 0.005, share).alias("share"))


def per_class_counts(matrix: DataFrame, classes: int) -> DataFrame:
    """class_id, tp, fp of a confusion matrix, without background."""
    out = matrix.groupBy(F.col("pred_class").alias("class_id")).agg(F.sum(F.when(F.col("pred_class") == F.col("true_class"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("all"))
    return out.where(F.col("class_id") < classes).select("class_id", "tp", (F.col("all") - F.col("tp")).alias("fp"))


def mask_iou(left: DataFrame, right: DataFrame) -> DataFrame:
    """IoU of all masks of an image that share a pixel; tables hold (image_id, mask_id, pixel), a pixel once for each mask.

    The pixels of a mask are gathered into one row, so the masks of an image
    meet in one join and neither pixels nor pairs of them are shuffled as rows.
    """
    whole = lambda df, side: df.groupBy("image_id", "mask_id").agg(F.collect_list("pixel").alias(f"{side}_pixels")).withColumnRenamed("mask_id", f"{side}_id")
    pairs = whole(left, "left").join(whole(right, "right"), "image_id").where(F.arrays_overlap("left_pixels", "right_pixels"))
    inter = F.size(F.array_intersect("left_pixels", "right_pixels"))
    return pairs.select("image_id", "left_id", "right_id", (inter / (F.size("left_pixels") + F.size("right_pixels") - inter + 1e-7)).alias("iou"))


def class_maps(ap: DataFrame, classes: int) -> DataFrame:
    """class_id and its AP over all thresholds; classes without labels take the mean of the others."""
    per = ap.groupBy("class_id").agg(F.avg("ap").alias("map"))
    mean = per.agg(F.avg("map").alias("mean"))  # one row
    every = ap.sparkSession.range(classes).select(F.col("id").alias("class_id"))
    return every.join(per, "class_id", "left").crossJoin(F.broadcast(mean)).select("class_id", F.coalesce("map", "mean").alias("map"))


def class_report(ap: DataFrame, point: DataFrame, names: DataFrame) -> DataFrame:
    """One row per class: name, labels, precision, recall, F1, tp, fp, AP at 0.5 and over all thresholds."""
    a = ap.groupBy("class_id").agg(F.max(F.when(F.col("thr") == 0, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap"))
    return point.join(a, "class_id").join(F.broadcast(names), "class_id", "left").select("class_id", F.coalesce("class_name", F.lit("unknown")).alias("class_name"), "n_labels", "precision", "recall", "f1", "tp", "fp", "ap50", "ap")
