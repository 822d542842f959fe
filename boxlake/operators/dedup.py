"""Duplicates and near duplicates of images: hashes, pairs, clusters, representatives."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions.boxes import box, iou_or_zero
from boxlake.operators.pixels import ssim_column
from boxlake.operators.scan import running_sums, written


def exact_groups(items: DataFrame) -> DataFrame:
    """Groups of equal content: digest, members, splits, cross_split; items hold item_id, split, digest."""
    g = items.groupBy("digest").agg(F.count("*").alias("members"), F.min("item_id").alias("first_id"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.count_distinct("split").alias("n_splits"))
    return g.where("members > 1").select("digest", "members", "first_id", "splits", (F.col("n_splits") > 1).alias("cross_split"))


def numbered(groups: DataFrame) -> DataFrame:
    """group_no in the order of first_id, counted over ranges of a thousand ids."""
    rows = groups.withColumns({"__all": F.lit(0), "__one": F.lit(1).cast("long")})
    return running_sums(rows, ["__all"], F.floor(F.col("first_id") / 1000), [F.asc("first_id")], {"group_no": "__one"}, many_chunks=True).drop("__all", "__one", "__chunk")


def hamming_limit(similarity: float, bits: int = 64) -> int:
    return int((1 - similarity) * bits + 1e-9)


def sign_hash(values: Column) -> Column:
    """64 signs as a long, the first value in the highest bit."""
    bits = F.transform(values, lambda v, i: F.when(v >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming_pairs(items: DataFrame, limit: int, bits: int = 64, errors: int = 1) -> DataFrame:
    """Pairs a < b of items(item_id, hash) whose hashes differ in limit bits at most; never all pairs.

    Of limit // (errors + 1) + 1 bands one at least differs in errors bits at
    most.  One side of the join lists the values of its bands with up to errors
    bits turned, the other its bands as they are: wider bands, fewer candidates.
    A pair comes from the first band that finds it.  Neither side is broadcast:
    Spark takes the size of a table for that of its exploded bands, which is
    dozens of times as much for the driver.
    """
    bands = limit // (errors + 1) + 1
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    signed = lambda m: F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long")
    masks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(bands)]
    turns = [[sum(1 << b for b in c) for n in range(errors + 1) for c in combinations(range(edges[i], edges[i + 1]), n)] for i in range(bands)]
    plain = items.select(F.col("item_id").alias("b"), F.col("hash").alias("hash_b"), F.posexplode(F.array(*(F.col("hash").bitwiseAND(signed(m)) for m in masks))).alias("band", "bits"))

    def around(i: int) -> Column:
        own = F.col("hash").bitwiseAND(signed(masks[i]))
        return F.struct(F.lit(i).alias("band"), F.transform(F.array(*map(signed, turns[i])), lambda t: own.bitwiseXOR(t)).alias("bits"))

    near = F.array(*map(around, range(bands)))
    turned = items.select(F.col("item_id").alias("a"), F.col("hash").alias("hash_a"), F.explode(near).alias("n")).select("a", "hash_a", F.col("n.band").alias("band"), F.explode("n.bits").alias("bits"))
    pairs = turned.join(plain.hint("merge"), ["band", "bits"]).where("a < b")
    differs = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    earlier = F.lit(False)
    for i, m in enumerate(masks):
        earlier = earlier | ((F.lit(i) < F.col("band")) & (F.bit_count(differs.bitwiseAND(signed(m))) <= errors))
    return pairs.where(~earlier).select("a", "b", F.bit_count(differs).cast("int").alias("hamming")).where(F.col("hamming") <= limit)


def hash_classes(items: DataFrame) -> DataFrame:
    """One row for each hash of items(item_id, hash): the smallest item_id with it, and the hash."""
    return items.groupBy("hash").agg(F.min("item_id").alias("item_id")).select("item_id", "hash")


def linking_edges(items: DataFrame, limit: int) -> DataFrame:
    """Edges a, b that connect the same items as all pairs of hamming_pairs do.

    Different hashes are searched once, whatever the number of items that share
    one; each further item of a hash is tied to the first one only.
    """
    classes = written(hash_classes(items))
    first = classes.select(F.col("item_id").alias("a"), "hash")
    ties = items.join(first.hint("merge"), "hash").where("a <> item_id").select("a", F.col("item_id").alias("b"))
    return hamming_pairs(classes, limit).select("a", "b").unionByName(ties)


def pair_counts(items: DataFrame, limit: int) -> DataFrame:
    """pair, such as "train-val", and n: similar pairs by the splits of their ends, of items(item_id, hash, split).

    Pairs are multiplied out from the items of each hash and split, not listed.
    """
    classes = written(hash_classes(items))
    of = items.groupBy("hash", "split").agg(F.count("*").alias("n")).join(classes.hint("merge"), "hash")
    of = written(of.select("item_id", "split", "n"))
    links = hamming_pairs(classes, limit).select("a", "b").unionByName(classes.select(F.col("item_id").alias("a"), F.col("item_id").alias("b")))
    x, y = of.toDF("a", "split_a", "n_a"), of.toDF("b", "split_b", "n_b")
    product = F.col("n_a") * F.col("n_b")
    inside = F.when(F.col("split_a") == F.col("split_b"), (product - F.col("n_a")) / 2).when(F.col("split_a") < F.col("split_b"), product).otherwise(0)
    n = F.when(F.col("a") != F.col("b"), product).otherwise(inside).cast("long")
    pair = F.concat_ws("-", F.least("split_a", "split_b"), F.greatest("split_a", "split_b"))
    return links.join(x.hint("merge"), "a").join(y.hint("merge"), "b").groupBy(pair.alias("pair")).agg(F.sum(n).alias("n")).where("n > 0")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for the nodes of edges(a, b).

    Labels spread along edges and then jump to the label of their label, so a
    chain of n nodes needs about log n rounds; each round is written down.
    Rounds send nothing through the driver: their broadcasts would pile up there.
    """
    e = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = written(e.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    while True:
        over = e.join(label.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = label.join(over.hint("merge"), F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = label.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        new = written(spread.join(jump.hint("merge"), F.col("label") == F.col("n2")).select("node", F.least("label", "l2").alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        label = new.select("node", "label")


def clusters(members: DataFrame, cross_split: bool = True) -> DataFrame:
    """cluster_no by size (largest first), then smallest member, for members(node, label, split); only clusters over several splits if asked."""
    sizes = members.groupBy("label").agg(F.count("*").alias("size"), F.count_distinct("split").alias("n_splits"))
    if cross_split:
        sizes = sizes.where("n_splits > 1")
    by_size = sizes.groupBy("size").agg(F.count("*").alias("c"))  # one row per size
    before = by_size.select(F.col("size").alias("s"), F.coalesce(F.sum("c").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = sizes.withColumn("i", F.row_number().over(Window.partitionBy("size").orderBy("label"))).join(before, F.col("size") == F.col("s"))
    return members.join(place.select("label", "size", (F.col("base") + F.col("i")).alias("cluster_no")).hint("merge"), "label").select("cluster_no", "size", "node", "label", "split")


def quality(sharpness: Column, brightness: Column, over: Column, under: Column) -> Column:
    """Sharp images score high; far from mid grey, overexposed and underexposed ones low."""
    return F.log1p(sharpness) - F.abs(brightness - 128) / 64 - 3 * over - 2 * under


def representatives(members: DataFrame, redundant: DataFrame) -> DataFrame:
    """Of each cluster the best items that are not redundant with a better kept one: cluster_id, item_id, kept, represented_by.

    members(cluster_id, item_id, quality), redundant(a, b) pairs; ties go to the
    smaller id.  The greedy choice in rounds of joins, so that no cluster has to
    fit in a task: an item goes as soon as a better one beside it is kept, and
    stays as soon as all better ones beside it are gone.
    """
    both = redundant.select("a", "b").unionByName(redundant.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = lambda who: members.select(F.col("item_id").alias(who), F.struct((-F.col("quality")).alias("q"), F.col("item_id").alias("i")).alias(f"rank_{who}"))
    better = written(both.join(rank("a"), "a").join(rank("b"), "b").where("rank_b < rank_a").select("a", "b", "rank_b"))
    state = written(members.select("item_id", F.lit(None).cast("boolean").alias("kept")))
    while True:
        beside = better.join(state.select(F.col("item_id").alias("b"), "kept"), "b").groupBy("a").agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("any_kept"), F.bool_or(F.col("kept").isNull()).alias("any_open"))
        verdict = F.when(F.coalesce("any_kept", F.lit(False)), False).when(~F.coalesce("any_open", F.lit(False)), True)
        state = written(state.join(beside, F.col("item_id") == F.col("a"), "left").select("item_id", F.coalesce("kept", verdict).alias("kept")))
        if state.where("kept IS NULL").isEmpty():
            break
    stands_for = better.join(state.where("kept").select(F.col("item_id").alias("b")), "b").groupBy(F.col("a").alias("of")).agg(F.min_by("b", "rank_b").alias("best"))
    out = members.select("cluster_id", "item_id").join(state, "item_id").join(stands_for, F.col("item_id") == F.col("of"), "left")
    return out.select("cluster_id", "item_id", "kept", F.when(F.col("kept"), F.col("item_id")).otherwise(F.col("best")).alias("represented_by"))


def cluster_summary(members: DataFrame) -> DataFrame:
    """Per cluster: size, number of classes, whether classes conflict, splits; members hold cluster_id, class_id, split."""
    return members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.count_distinct("class_id").alias("n_classes"), (F.count_distinct("class_id") > 1).alias("conflict"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"))


def redundant_pairs(scored: DataFrame, whole: float = 0.95, region: float = 0.95, overlap: float = 0.9) -> DataFrame:
    """Pairs a, b of scored(a, b, whole_ssim, region_ssim, iou, class_a, class_b) that show the same thing."""
    same = (F.col("whole_ssim") >= whole) & (F.col("region_ssim") >= region) & (F.col("iou") >= overlap) & (F.col("class_a") == F.col("class_b"))
    return scored.where(same).select("a", "b")


def content_classes(items: DataFrame, columns: list[str]) -> DataFrame:
    """items(item_id, ...) with first_id, the smallest item_id with equal columns: only one of each class has to be compared."""
    key = F.sha2(F.to_json(F.struct(*(F.hex(c).alias(c) if dict(items.dtypes)[c] == "binary" else F.col(c) for c in columns))), 256)
    keyed = items.withColumn("__key", key)
    first = keyed.groupBy("__key").agg(F.min("item_id").alias("first_id"))
    return keyed.join(first, "__key").drop("__key")


def scored_pairs(classes: DataFrame, limit: int, size: int) -> DataFrame:
    """Candidates a < b of classes(item_id, phash, whole, part, class_id, x1, y1, x2, y2) by their hashes, with whole_ssim, region_ssim, iou and both classes."""
    pairs = hamming_pairs(classes.select("item_id", F.col("phash").alias("hash")), limit)
    side = lambda s: classes.select(F.col("item_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("whole", "part", "class_id", "x1", "y1", "x2", "y2")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    like = ssim_column(size)
    overlap = iou_or_zero(box("x1_a", "y1_a", "x2_a", "y2_a"), box("x1_b", "y1_b", "x2_b", "y2_b"))
    return both.select("a", "b", "hamming", like("whole_a", "whole_b").alias("whole_ssim"), like("part_a", "part_b").alias("region_ssim"), overlap.alias("iou"), F.col("class_id_a").alias("class_a"), F.col("class_id_b").alias("class_b"))


def confirmed_duplicates(items: DataFrame, limit: int, size: int, alike: float = 0.85, **bounds: float) -> DataFrame:
    """cluster_id, item_id, kept and represented_by of the items that resemble another one.

    items hold item_id, phash, whole, part, class_id, corners x1, y1, x2, y2 and
    quality.  Items with equal content are one class and only their first is
    compared, so copies give no pairs.  Candidates come from the hashes; those
    with a whole similarity of `alike` are edges, and clusters are the
    components.  Inside a cluster redundant_pairs, with its bounds, says which
    show the same thing; the best of them stay.  A copy is represented as the
    first of its class is.
    """
    items = written(content_classes(items, ["whole", "part", "class_id", "x1", "y1", "x2", "y2"]))
    classes = items.where("item_id = first_id")
    scored = written(scored_pairs(classes, limit, size))
    edges = scored.where(F.col("whole_ssim") >= alike)
    redundant = redundant_pairs(edges, **bounds)
    labels = components(edges).select(F.col("node").alias("item_id"), F.col("label").alias("cluster_id"))
    copied = items.where("item_id > first_id").select(F.col("first_id").alias("item_id")).distinct()
    members = classes.select("item_id", "quality").join(labels, "item_id", "left").join(copied.withColumn("copied", F.lit(True)), "item_id", "left")
    members = members.where("cluster_id IS NOT NULL OR copied").select(F.coalesce("cluster_id", "item_id").alias("cluster_id"), "item_id", "quality")
    verdict = representatives(written(members), redundant).withColumnRenamed("item_id", "first_id")
    out = items.select("item_id", "first_id").join(verdict, "first_id")
    return out.select("cluster_id", "item_id", (F.col("kept") & (F.col("item_id") == F.col("first_id"))).alias("kept"), "represented_by")


def inner_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges both ends of which are members(node)."""
    m = members.select("node")
    return edges.join(m.withColumnRenamed("node", "a"), "a", "left_semi").join(m.withColumnRenamed("node", "b"), "b", "left_semi").select(edges.columns)
