"""Sampling and splitting that give the same rows on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.operators.recurrence import numbered


def bucket(key: Column, buckets: int) -> Column:
    """A bucket from the first 13 hex digits of the MD5 of the key."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 13), 16, 10).cast("long"), F.lit(buckets))


def auto_split(items: DataFrame, key: str, weights: tuple[float, float, float] = (0.9, 0.1, 0.0)) -> DataFrame:
    """items with split: train, val or test by the hash of the key."""
    at = bucket(F.col(key), 1_000_000) / 1e6
    return items.withColumn("split", F.when(at < weights[0], "train").when(at < weights[0] + weights[1], "val").otherwise("test"))


def sample_per_group(items: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """n rows of each group: those with the smallest hashes."""
    w = Window.partitionBy(group).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return items.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")  # planned as a group limit: each task keeps n rows


def weighted_draws(items: DataFrame, draws: int) -> DataFrame:
    """draw, item_id: draws with replacement by items(item_id, weight); draw i takes the item at a hashed point of the cumulative weights."""
    from boxlake.operators.scan import running_sums

    cum = running_sums(items.withColumn("one", F.lit(0)), ["one"], F.floor(F.col("item_id") / 4096), [F.asc("item_id")], {"upto": "weight"}, many_chunks=True)
    total = items.agg(F.sum("weight").alias("total"))
    points = items.sparkSession.range(draws).select(F.col("id").alias("draw"), (bucket(F.col("id"), 1_000_000) / F.lit(1e6)).alias("u")).crossJoin(F.broadcast(total)).withColumn("point", F.col("u") * F.col("total"))
    # a range join on buckets of weight: an item covers the buckets between its ends
    width = F.greatest(F.col("total") / 4096, F.lit(1e-12))
    spans = cum.crossJoin(F.broadcast(total)).withColumn("start", F.col("upto") - F.col("weight"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("upto") / width)))).select("item_id", "start", "upto", "cell")
    hit = points.withColumn("cell", F.floor(F.col("point") / width)).join(spans, "cell").where("point >= start AND point < upto")
    return hit.select("draw", "item_id")


def placements(runs: list[tuple[int, int, int]], fixed: dict[tuple[str, int], int], target: dict[str, float]) -> list[tuple[int, int, int, int, str]]:
    """amount, class_id, first, last, split: which of the clusters of each run(amount, class_id, clusters) go where, greedily, biggest first.

    A cluster goes where it brings the counts of its class and of all classes
    nearest to their shares; the earlier split wins a tie.  As long as a split
    stays below or above both of its shares, the cost of a further cluster there
    doesn't change, so so many are placed at once: a few steps for each run.
    """
    order = list(target)
    total: dict[int, int] = {}
    for (_, c), n in fixed.items():
        total[c] = total.get(c, 0) + n
    for amount, c, n in runs:
        total[c] = total.get(c, 0) + amount * n
    have, have_all = {k: float(n) for k, n in fixed.items()}, {s: float(sum(n for (t, _), n in fixed.items() if t == s)) for s in order}
    want_all = {s: sum(total.values()) * target[s] for s in order}
    out = []
    for amount, c, n in sorted(runs, key=lambda r: (-r[0], r[1])):
        first = 0
        while first < n:

            def gaps(s: str, c: int = c) -> list[tuple[float, float, float]]:
                return [(1.0, have.get((s, c), 0.0), total[c] * target[s]), (0.35, have_all[s], want_all[s])]

            def cost(s: str, amount: int = amount) -> float:
                return round(sum(w * (abs(x + amount - y) - abs(x - y)) for w, x, y in gaps(s)), 6)

            best = min(order, key=lambda s: (cost(s), order.index(s)))
            steps = [n - first] + [int((y - x) // amount) if x + amount <= y else 1 for _, x, y in gaps(best) if x < y]
            k = max(1, min(steps)) if amount else n - first
            out.append((amount, c, first, first + k - 1, best))
            have[best, c] = have.get((best, c), 0.0) + k * amount
            have_all[best] += k * amount
            first += k
    return out


def balance_clusters(clusters: DataFrame, fixed: DataFrame, target: dict[str, float]) -> DataFrame:
    """target_split of each cluster(cluster_id, class_id, amount), biggest first, so that classes and totals near the target shares.

    Clusters of one amount are taken by class, then by id; so only how many there
    are of each amount and class reaches the driver (amounts add up to the items,
    so there are few unlike ones), and the clusters are numbered where they are
    and find their split by a join.  fixed(split, class_id, n) counts what is
    placed already.
    """
    spark = clusters.sparkSession
    runs = clusters.groupBy("amount", "class_id").agg(F.count("*").alias("n")).collect()
    known = {(r["split"], r["class_id"]): r["n"] for r in fixed.groupBy("split", "class_id").agg(F.sum("n").alias("n")).collect()}  # splits x classes
    found = placements([(r["amount"], r["class_id"], r["n"]) for r in runs], known, target)
    plan = spark.createDataFrame(found, "amount long, class_id long, first long, last long, target_split string").withColumn("run", F.concat_ws(":", "amount", "class_id"))
    rows = clusters.select(F.concat_ws(":", "amount", "class_id").alias("run"), "cluster_id", F.lit(0.0).alias("v"))
    placed = numbered(rows, "run", "cluster_id", "v").select(F.col("k").alias("run"), F.col("o").alias("cluster_id"), "t")
    return placed.join(plan, "run").where("t BETWEEN first AND last").select("cluster_id", "class_id", "amount", "target_split")
