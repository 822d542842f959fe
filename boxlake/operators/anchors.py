"""Anchors: how well they fit boxes, target assignment, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.functions.boxes import wh_iou
from boxlake.operators.scan import written

#: fixed values: anchors (width, height) in pixels by level with stride 8, 16, 32
ANCHORS = [[(10, 13), (16, 30), (33, 23)], [(30, 61), (62, 45), (59, 119)], [(116, 90), (156, 198), (373, 326)]]
STRIDES = [8, 16, 32]


def anchor_table(spark) -> DataFrame:
    """Nine rows: level, anchor, stride, aw, ah in pixels."""
    return spark.createDataFrame([(i, j, STRIDES[i], float(w), float(h)) for i, level in enumerate(ANCHORS) for j, (w, h) in enumerate(level)], "level int, anchor int, stride int, aw double, ah double")


def over(a, b):
    """a / b, and infinity where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(float("inf")))


def ratio(w, h, aw, ah):
    """The worse of width and height ratio, as 1 or less; 0 for a box without width or height."""
    return F.least(F.least(w / aw, over(aw, w)), F.least(h / ah, over(ah, h)))


def best_possible_recall(boxes: DataFrame, limit: float = 4.0) -> DataFrame:
    """Share of boxes(w, h) with an anchor within limit, and anchors within limit per box."""
    anchors = anchor_table(boxes.sparkSession)
    best = F.greatest(*(ratio(F.col("w"), F.col("h"), F.lit(float(w)), F.lit(float(h))) for level in ANCHORS for w, h in level))
    near = sum((ratio(F.col("w"), F.col("h"), F.lit(float(w)), F.lit(float(h))) > 1 / limit).cast("int") for level in ANCHORS for w, h in level)
    del anchors
    return boxes.agg(F.avg((best > 1 / limit).cast("double")).alias("bpr"), F.avg(near.cast("double")).alias("aat"), F.avg(best).alias("mean_best"))


def assign_targets(boxes: DataFrame, net: int = 640, limit: float = 4.0) -> DataFrame:
    """Grid cells and anchors that each box(x, y, w, h in pixels) trains: its cell and up to two neighbours at each level."""
    t = boxes.crossJoin(F.broadcast(anchor_table(boxes.sparkSession)))  # 9 rows
    grid = F.lit(float(net)) / F.col("stride")
    gx, gy = F.col("x") / F.col("stride"), F.col("y") / F.col("stride")
    t = t.where(F.greatest(F.col("w") / F.col("aw"), over(F.col("aw"), F.col("w")), F.col("h") / F.col("ah"), over(F.col("ah"), F.col("h"))) < limit).withColumns({"gx": gx, "gy": gy, "grid": grid})
    near = lambda c: (F.pmod(F.col(c), F.lit(1.0)) < 0.5) & (F.col(c) > 1)
    far = lambda c: (F.pmod(F.col("grid") - F.col(c), F.lit(1.0)) < 0.5) & (F.col("grid") - F.col(c) > 1)
    shift = lambda ok, dx, dy: F.when(ok, F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")))
    shifts = F.array(shift(F.lit(True), 0.0, 0.0), shift(near("gx"), 0.5, 0.0), shift(near("gy"), 0.0, 0.5), shift(far("gx"), -0.5, 0.0), shift(far("gy"), 0.0, -0.5))
    t = t.withColumn("s", F.explode(F.filter(shifts, lambda s: s.isNotNull())))
    gi, gj = (F.col("gx") - F.col("s")["dx"]).cast("int"), (F.col("gy") - F.col("s")["dy"]).cast("int")
    last = F.col("grid").cast("int") - 1
    inside = lambda c: F.least(F.greatest(c, F.lit(0)), last)
    return t.select("image_id", "label_id", "class_id", "level", "anchor", inside(gj).alias("gj"), inside(gi).alias("gi"), (F.col("gx") - gi).alias("tx"), (F.col("gy") - gj).alias("ty"))


def order_agrees(anchors: list[list[tuple[int, int]]], strides: list[int]) -> bool:
    """Whether mean anchor areas and strides rise together."""
    mean = [sum(w * h for w, h in level) / len(level) for level in anchors]
    return (mean[-1] - mean[0]) * (strides[-1] - strides[0]) >= 0


def sizes(boxes: DataFrame) -> DataFrame:
    """Each size of boxes(w, h) once, with n, how many have it: rounds read this table, not what the boxes come from."""
    return written(boxes.groupBy("w", "h").agg(F.count("*").alias("n")))


def weighted(value, n="n"):
    """Mean of a value that each row has n times; null counts for nothing."""
    return F.sum(value * F.col(n)) / F.sum(F.when(value.isNotNull(), F.col(n)))


def kmeans(boxes: DataFrame, centers: list[tuple[float, float]], rounds: int = 100) -> DataFrame:
    """Clusters boxes(w, h) by IoU distance with medians as centres; starts from centers, ends when they stay.

    Only k centres come to the driver; a round is one pass over the sizes, with exact medians.
    """
    boxes = sizes(boxes)
    middle = lambda c: F.percentile(c, F.lit(0.5), F.col("n")).alias(c)
    now = [(float(w), float(h)) for w, h in centers]
    for _ in range(rounds):
        score = [wh_iou(F.col("w"), F.col("h"), F.lit(w), F.lit(h), 1e-12) for w, h in now]
        best = F.array_position(F.array(*score), F.greatest(*score)) - 1
        found = {r["c"]: (r["w"], r["h"]) for r in boxes.groupBy(best.alias("c")).agg(middle("w"), middle("h")).collect()}  # k rows
        new = [found.get(i, c) for i, c in enumerate(now)]
        same = all(abs(a - b) <= 1e-8 + 1e-5 * abs(b) for p, q in zip(new, now, strict=True) for a, b in zip(p, q, strict=True))
        now = new
        if same:
            break
    now.sort(key=lambda c: c[0] * c[1])
    score = [wh_iou(F.col("w"), F.col("h"), F.lit(w), F.lit(h), 1e-12) for w, h in now]
    best = F.array_position(F.array(*score), F.greatest(*score)) - 1
    return boxes.groupBy(best.cast("int").alias("center")).agg(F.sum("n").alias("n"), middle("w"), middle("h"))


def whitened_kmeans(boxes: DataFrame, k: int, seed: int = 0, rounds: int = 30) -> list[tuple[float, float]]:
    """k centres of boxes(w, h) by Euclidean distance after scaling both sides to unit deviation, by area."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    s = boxes.agg(F.stddev_pop("w").alias("w"), F.stddev_pop("h").alias("h")).first()
    scaled = boxes.select((F.col("w") / s["w"]).alias("w"), (F.col("h") / s["h"]).alias("h"))
    model = KMeans(k=k, seed=seed, maxIter=rounds).fit(VectorAssembler(inputCols=["w", "h"], outputCol="features").transform(scaled))
    return sorted(((float(c[0] * s["w"]), float(c[1] * s["h"])) for c in model.clusterCenters()), key=lambda c: c[0] * c[1])


def fitness(boxes: DataFrame, anchors: list[tuple[float, float]], limit: float = 4.0, n: str | None = None) -> float:
    """Mean over boxes of the best ratio, where it is within limit; n names a column that says how often a row counts."""
    best = F.greatest(*(ratio(F.col("w"), F.col("h"), F.lit(float(w)), F.lit(float(h))) for w, h in anchors)) if len(anchors) > 1 else ratio(F.col("w"), F.col("h"), F.lit(float(anchors[0][0])), F.lit(float(anchors[0][1])))
    value = F.when(best > 1 / limit, best).otherwise(0.0)
    return boxes.agg(weighted(value, n) if n else F.avg(value)).first()[0] or 0.0


def whitened_rounds(boxes: DataFrame, centers: list[tuple[float, float]], rounds: int = 30) -> list[tuple[float, float]]:
    """Centres of boxes(w, h) by Euclidean distance after scaling both sides to unit deviation, from given ones, by area.

    A centre without boxes stays; a round is one pass over the sizes, and k rows come to the driver.
    """
    boxes = sizes(boxes)
    mean = boxes.agg(weighted(F.col("w")).alias("w"), weighted(F.col("h")).alias("h")).first()
    s = boxes.agg(*(F.sqrt(weighted(F.pow(F.col(c) - F.lit(mean[c]), F.lit(2)))).alias(c) for c in "wh")).first()
    sw, sh = s["w"] or 1.0, s["h"] or 1.0
    now = [(float(w), float(h)) for w, h in centers]
    for _ in range(rounds):
        far = [F.pow((F.col("w") - w) / sw, F.lit(2)) + F.pow((F.col("h") - h) / sh, F.lit(2)) for w, h in now]
        best = F.array_position(F.array(*far), F.least(*far)) - 1
        found = {r["c"]: (r["w"], r["h"]) for r in boxes.groupBy(best.alias("c")).agg(weighted(F.col("w")).alias("w"), weighted(F.col("h")).alias("h")).collect()}
        new = [found.get(i, c) for i, c in enumerate(now)]
        if new == now:
            break
        now = new
    return sorted(now, key=lambda c: c[0] * c[1])


def mutations(k: int, generations: int, brood: int, share: float = 0.9, sigma: float = 0.1, seed: int = 0) -> list[list[list[tuple[float, float]]]]:
    """Factors by generation, child and anchor: each side changes with a probability, by a normal step whose size is drawn for the child, within 0.3 and 3; a child always changes."""
    import random

    rng = random.Random(seed)

    def child() -> list[tuple[float, float]]:
        while True:
            size = rng.random()
            sides = [min(3.0, max(0.3, 1 + (rng.random() < share) * size * rng.gauss(0, 1) * sigma)) for _ in range(2 * k)]
            if any(v != 1 for v in sides):
                return list(zip(sides[::2], sides[1::2], strict=True))

    return [[child() for _ in range(brood)] for _ in range(generations)]


def evolved(boxes: DataFrame, anchors: list[tuple[float, float]], generations: int = 20, brood: int = 16, sigma: float = 0.1, seed: int = 0) -> list[tuple[float, float]]:
    """Anchors mutated by factors; a generation's brood is scored in one pass over the sizes of boxes, its best one stays if it is better.  Sides don't fall below 2."""
    boxes = sizes(boxes)
    best = [(float(w), float(h)) for w, h in anchors]
    score = fitness(boxes, best, n="n")
    for generation in mutations(len(best), generations, brood, sigma=sigma, seed=seed):
        tries = [[(max(2.0, w * f), max(2.0, h * g)) for (w, h), (f, g) in zip(best, child, strict=True)] for child in generation]
        value = lambda a: F.greatest(F.lit(0.0), *(ratio(F.col("w"), F.col("h"), F.lit(w), F.lit(h)) for w, h in a))
        scores = boxes.agg(*(weighted(F.when(value(a) > 0.25, value(a)).otherwise(0.0)).alias(f"s{i}") for i, a in enumerate(tries))).first()
        top = max(range(brood), key=lambda i: scores[i] or 0.0)
        if (scores[top] or 0.0) > score:
            best, score = tries[top], scores[top]
    return sorted(best, key=lambda a: a[0] * a[1])
