"""Profiles of annotation tables: distributions, summaries, weights, suspects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions.boxes import size_bin
from boxlake.operators.scan import running_sums, written

BINS = ["<5", "5-16", "16-32", "32-64", "64-128", ">=128"]


def class_distribution(labels: DataFrame) -> DataFrame:
    """split, class_id, n and percentage within the split."""
    counts = labels.groupBy("split", "class_id").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("split"))  # splits x classes rows
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / total, 6))


def split_totals(labels: DataFrame) -> DataFrame:
    """Boxes and images per split and over all (split is null)."""
    images = labels.groupBy("split", "image_id").agg(F.count("*").alias("boxes"))
    return images.rollup("split").agg(F.sum("boxes").alias("boxes"), F.count("*").alias("images"))


def size_distribution(labels: DataFrame, width: float, height: float) -> DataFrame:
    """split, bin, n with the empty bins as zeros."""
    spark = labels.sparkSession
    binned = labels.groupBy("split", size_bin(F.col("w"), F.col("h"), F.lit(width), F.lit(height)).alias("bin")).agg(F.count("*").alias("c"))
    bins = spark.createDataFrame([(b,) for b in BINS], "bin string")
    frame = labels.select("split").distinct().crossJoin(F.broadcast(bins))  # splits x 6
    return frame.join(binned, ["split", "bin"], "left").select("split", "bin", F.coalesce("c", F.lit(0)).alias("n"))


def summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Minimum, 5, 25, 50, 75, 95 per cent (linear between rows), mean and maximum; nulls in value don't count.

    The exact places are found among distinct values with their counts, dealt
    over tasks by range: no task holds all values of a key.
    """
    shares = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    whole = df.groupBy(*keys).agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(value).alias("__all"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    dealt = written(counts.repartitionByRange(*keys, "__v").withColumn("__p", F.spark_partition_id()))
    places = running_sums(dealt, list(keys), F.col("__p"), [F.asc("__v")], {"__upto": "__n"})
    total = whole.select(*(F.col(k).alias(f"__w_{k}") for k in keys), "__all")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__w_{k}"))
    placed = places.join(total, same)
    spot = lambda q: F.lit(q) * (F.col("__all") - 1)
    at = lambda i: F.max(F.when((F.col("__upto") - F.col("__n") <= i) & (i < F.col("__upto")), F.col("__v")))
    between = {n: at(F.floor(spot(q))) * (1 - F.max(spot(q) - F.floor(spot(q)))) + at(F.ceil(spot(q))) * F.max(spot(q) - F.floor(spot(q))) for n, q in shares.items()}
    found = placed.groupBy(*(F.col(k).alias(f"__f_{k}") for k in keys)).agg(*(c.alias(n) for n, c in between.items()))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__f_{k}"))
    r = lambda c: F.round(c, 6).alias(c)
    return whole.join(found, same, "left").select(*keys, *(r(c) for c in ("min", *shares, "mean", "max")))


def prefix_suspects(items: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """Rows of items(item_id, prefix, class_id) whose class is not the clear majority of their prefix; ties go to the class seen first."""
    counts = items.groupBy("prefix", "class_id").agg(F.count("*").alias("n"), F.min("item_id").alias("first"))
    w = Window.partitionBy("prefix")  # classes of a prefix
    ranked = counts.withColumns({"total": F.sum("n").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "first"))}).where("rank = 1")
    clear = ranked.where((F.col("total") >= least) & (F.col("n") / F.col("total") >= share)).select("prefix", F.col("class_id").alias("majority"), F.round(F.col("n") / F.col("total"), 6).alias("majority_share"))
    return items.join(clear, "prefix").where(F.col("class_id") != F.col("majority")).select("item_id", "prefix", "class_id", "majority", "majority_share")


def class_weights(labels: DataFrame, classes: int) -> DataFrame:
    """Inverse class frequencies, normalised; a class without rows counts as one."""
    counts = labels.groupBy("class_id").agg(F.count("*").alias("c"))
    every = labels.sparkSession.range(classes).select(F.col("id").alias("class_id"))
    inverse = every.join(counts, "class_id", "left").select("class_id", (1.0 / F.coalesce("c", F.lit(1))).alias("w"))
    return inverse.select("class_id", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("weight"))  # one row per class


def image_weights(labels: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of class weights over the boxes of each image."""
    return labels.join(F.broadcast(weights), "class_id").groupBy("image_id").agg(F.sum("weight").alias("weight"))  # one row per class


def dataset_stats(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Per split: images, unlabelled images, instances, and per class instances and images."""
    per_image = labels.groupBy("image_id", "class_id").agg(F.count("*").alias("n"))
    by_class = images.select("image_id", "split").join(per_image, "image_id", "left")
    per_class = by_class.where("class_id IS NOT NULL").groupBy("split", "class_id").agg(F.sum("n").alias("instances"), F.count("*").alias("images"))
    bare = images.select("image_id", "split").join(labels.select("image_id").distinct(), "image_id", "left_anti").groupBy("split").agg(F.count("*").alias("unlabelled"))
    return per_class.join(bare, "split", "left").select("split", "class_id", "instances", "images", F.coalesce("unlabelled", F.lit(0)).alias("unlabelled"))


def shared_histogram(df: DataFrame, value: str, group: str, bins: int = 40) -> DataFrame:
    """Shares of each group in equal bins between the minimum and maximum over all groups; the last bin is closed.  A single value is the middle of a range of 1."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    ends = ends.select(F.when(F.col("lo") < F.col("hi"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"), F.when(F.col("lo") < F.col("hi"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("long")
    counts = df.crossJoin(F.broadcast(ends)).groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)), 6))


def joint_histogram(df: DataFrame, x: str, y: str, step: float) -> DataFrame:
    """Cells of a two-dimensional histogram with the logarithm of their counts."""
    return df.groupBy(F.floor(F.col(x) / step).alias("bx"), F.floor(F.col(y) / step).alias("by")).agg(F.count("*").alias("n")).withColumn("log_n", F.round(F.log("n"), 9))


def class_summary_text(det: DataFrame, names: DataFrame) -> DataFrame:
    """Per image a text such as "2 dogs, 1 cat", by class id."""
    counts = det.groupBy("image_id", "class_id").agg(F.count("*").alias("n")).join(F.broadcast(names), "class_id", "left")  # names: one row per class
    piece = F.concat(F.col("n").cast("string"), F.lit(" "), F.coalesce("class_name", F.lit("unknown")), F.when(F.col("n") > 1, "s").otherwise(""))
    parts = F.sort_array(F.collect_list(F.struct("class_id", piece.alias("piece"))))
    return counts.groupBy("image_id").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), ", ").alias("summary"))


def class_confidences(det: DataFrame, classes: int, least: float = 0.25) -> DataFrame:
    """Per image and class the mean confidence of the detections that reach least; 0 without one."""
    pivot = det.where(F.col("conf") >= least).groupBy("image_id").pivot("class_id", list(range(classes))).agg(F.avg("conf"))
    return pivot.select("image_id", *(F.round(F.coalesce(str(c), F.lit(0.0)), 9).alias(f"class_{c}") for c in range(classes)))


def class_sets(labels: DataFrame, names: DataFrame) -> DataFrame:
    """Per image its distinct class names in order."""
    return labels.join(F.broadcast(names), "class_id").groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_set("class_name")), ",").alias("classes"))


def topk_accuracy(rows: DataFrame) -> DataFrame:
    """Per label top-1 and top-5 accuracy of rows(label, scores); the first of equal scores ranks higher."""
    ranked = F.sort_array(F.transform("scores", lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    top = F.transform(F.slice(ranked, 1, 5), lambda x: x["i"])
    hits = rows.select("label", F.get(top, F.lit(0)).alias("first"), F.array_contains(top, F.col("label")).alias("in5"))
    return hits.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("first") == F.col("label")).cast("double")).alias("top1"), F.avg(F.col("in5").cast("double")).alias("top5"))


def even_sample(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """k rows of each group at even distances in the order of an integer column (all of a smaller group); a group is ordered in chunks of 4096 ids."""
    n = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))  # one row per group
    places = running_sums(df.withColumn("__one", F.lit(1)), [group], F.floor(F.col(order) / 4096), [F.asc(order)], {"__i": "__one"}, many_chunks=True)
    rows = places.withColumn("__i", F.col("__i") - 1).join(n, F.col(group).eqNullSafe(F.col("__g")))
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("__n") - 1) / float(k - 1)).cast("long"))
    return rows.where((F.col("__n") <= k) | F.array_contains(spots, F.col("__i"))).select(df.columns)


def mean_and_std(df: DataFrame, *columns: str) -> DataFrame:
    """One row per column: name, mean and population deviation."""
    one = df.agg(*(F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(f"s{i}") for i, c in enumerate(columns)))
    return one.select(F.explode(F.array(*one.columns)).alias("s")).select("s.*")


def shared_entries(a: DataFrame, b: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a(key, shape, ...) whose key b has with the same shape, without keys that hold one of exclude."""
    for x in exclude:
        a = a.where(~F.col("key").contains(x))
    return a.join(b.select("key", "shape").distinct(), ["key", "shape"], "left_semi")


def with_min_items(labels: DataFrame, least: int) -> DataFrame:
    """Labels of the images that have at least so many."""
    enough = labels.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("image_id")
    return labels.join(enough, "image_id", "left_semi")


def single_class(rows: DataFrame) -> DataFrame:
    """Every box or detection in class 0."""
    return rows.withColumn("class_id", F.lit(0).cast("long"))


def smallest_half(labels: DataFrame) -> DataFrame:
    """Per image the half (half to even) of its boxes with the smallest areas."""
    w = Window.partitionBy("image_id")
    ranked = labels.withColumns({"__r": F.row_number().over(w.orderBy(F.col("w") * F.col("h"), "label_id")), "__n": F.count("*").over(w)})
    return ranked.where(F.col("__r") <= F.rint(F.col("__n") / 2)).drop("__r", "__n")
