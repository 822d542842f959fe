"""Training logs: fitness, best rows, early stop, schedules, averages.

A log has a row per epoch, so windows over the whole log are small by nature;
running_mean also serves long tables and is scanned in chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.operators.recurrence import running_ema
from boxlake.operators.scan import running_sums


def fitness(p: Column, r: Column, m50: Column, m: Column, weights: tuple = (0.0, 0.0, 0.1, 0.9)) -> Column:
    return p * weights[0] + r * weights[1] + m50 * weights[2] + m * weights[3]


def best_row(log: DataFrame, order: str = "epoch") -> DataFrame:
    """The row with the largest fitness; the first of equal ones."""
    return log.orderBy(F.desc("fitness"), order).limit(1)


def early_stopping(log: DataFrame, patience: int) -> DataFrame:
    """Per epoch the best fitness so far, the last epoch that reached it (ties count) and whether training stops.  A log has a row for each epoch: one task orders it."""
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    best = log.select("epoch", "fitness", F.max("fitness").over(w).alias("best"))
    at = best.withColumn("best_epoch", F.max(F.when(F.col("fitness") >= F.col("best"), F.col("epoch"))).over(w))
    return at.withColumn("stop", F.col("epoch") - F.col("best_epoch") >= patience)


def running_mean(df: DataFrame, order: str, value: str, per_chunk: int = 4096) -> DataFrame:
    """Mean of value over all rows up to each one, in the order of an integer column."""
    rows = df.select(order, value, F.lit(0).alias("k"), F.lit(1).alias("one"))
    sums = running_sums(rows, ["k"], F.floor(F.col(order) / per_chunk), [F.asc(order)], {"s": value, "n": "one"}, many_chunks=True)
    return sums.select(order, (F.col("s") / F.col("n")).alias("mean"))


def schedules(spark, epochs: int, warmup: int = 3, lr0: float = 0.01, lrf: float = 0.01) -> DataFrame:
    """Linear and one-cycle (cosine) learning-rate factors, and the linear warm-up."""
    e = F.col("id")
    linear = (1 - e / float(epochs)) * (1 - lrf) + lrf
    cosine = (1 - F.cos(e * math.pi / epochs)) / 2 * (lrf - 1) + 1
    warm = F.when(e < warmup, e / float(warmup) * lr0 * linear).otherwise(lr0 * linear)
    return spark.range(epochs).select(e.alias("epoch"), linear.alias("linear"), cosine.alias("cosine"), warm.alias("lr"))


def ema(df: DataFrame, order: str, value: str, decay: float = 0.9999, tau: float = 2000.0) -> DataFrame:
    """Exponential average of a whole series, with the decay ramped up by 1 - exp(-t / tau): one row, 0 without values."""
    rows = running_ema(df.withColumn("__one", F.lit(0)), "__one", order, value, decay, tau)
    return rows.agg(F.coalesce(F.max_by("ema", "place"), F.lit(0.0)).alias("ema"), F.count("*").alias("n"))


def trimmed(df: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """Without the first and last rows; order is counted from the smallest.  For logs: one task orders all rows."""
    w = Window.orderBy(order)
    return df.withColumns({"i": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy()), "t": F.col(order) - F.min(order).over(Window.partitionBy())}).where(f"i > {first} AND i <= n - {last}").drop("i", "n")


def parents(log: DataFrame, n: int = 5) -> DataFrame:
    """The n fittest rows with selection weights (fitness over the smallest, plus a little)."""
    top = log.orderBy(F.desc("fitness"), "epoch").limit(n)
    return top.withColumn("weight", F.col("fitness") - F.min("fitness").over(Window.partitionBy()) + 1e-6)


def aspect_batches(images: DataFrame, batch: int, net: int = 640, stride: int = 32, pad: float = 0.5, per_chunk: int = 200) -> DataFrame:
    """Batches of images in the order of height / width, with the shape that wastes least: batch, n, shape_h, shape_w."""
    rows = images.select("image_id", (F.col("height") / F.col("width")).alias("ar"), F.lit(1).alias("one"))
    # most images share a few ratios: ratios are scanned first, then the ids of each ratio in chunks
    ratios = rows.groupBy("ar").agg(F.count("*").alias("n")).withColumn("k", F.lit(0))
    upto = running_sums(ratios, ["k"], F.floor(F.col("ar") * per_chunk), [F.asc("ar")], {"upto": "n"})
    before = upto.select(F.col("ar").alias("of"), (F.col("upto") - F.col("n")).alias("base"))
    inside = running_sums(rows, ["ar"], F.floor(F.col("image_id") / 4096), [F.asc("image_id")], {"i": "one"}, many_chunks=True)
    order = inside.join(before, F.col("ar") == F.col("of")).withColumn("rn", F.col("base") + F.col("i"))
    g = order.groupBy(F.floor((F.col("rn") - 1) / batch).alias("batch")).agg(F.count("*").alias("n"), F.min("ar").alias("lo"), F.max("ar").alias("hi"))
    side = lambda s: (F.ceil(F.lit(float(net)) * s / stride + pad) * stride).cast("long")
    h = F.when(F.col("hi") < 1, F.col("hi")).otherwise(F.lit(1.0))
    w = F.when((F.col("hi") >= 1) & (F.col("lo") > 1), 1 / F.col("lo")).otherwise(F.lit(1.0))
    return g.select("batch", "n", side(h).alias("shape_h"), side(w).alias("shape_w"))
