"""Dataset versions: manifests, fingerprints, differences, relabelling, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.operators.scan import written


def manifest(files: DataFrame) -> DataFrame:
    """path, size and SHA-256 of files(path, content)."""
    return files.select("path", F.length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def place(path: str = "path") -> Column:
    """Where a path stands in the tree: the hex digits of its MD5, a level for each."""
    return F.md5(F.col(path).cast("binary"))


def depth_of(files: int, per_leaf: int = 4096) -> int:
    """Levels below the root at which a leaf holds about per_leaf files at most; every node has 16 children."""
    depth = 0
    while files > per_leaf * 16**depth:
        depth += 1
    return depth


def merkle(manifest: DataFrame, depth: int) -> DataFrame:
    """level, prefix, digest, files, bytes of every node of the tree over manifest(path, size, sha256).

    A leaf digests its files in the order of path, a node its children; so a task
    holds a leaf or sixteen digests, never a list of all.  Empty nodes are left
    out; without files there are none at all.
    """
    line = F.concat_ws("\t", "path", F.col("size").cast("string"), "sha256")
    listing = F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda r: r["line"])
    one = manifest.groupBy(F.left(place(), F.lit(depth)).alias("prefix"))
    level = written(one.agg(F.sha2(F.array_join(listing, "\n"), 256).alias("digest"), F.count("*").alias("files"), F.sum("size").alias("bytes")))
    out = level.withColumn("level", F.lit(depth))
    for up in reversed(range(depth)):
        children = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda c: F.concat(c["prefix"], c["digest"]))
        parent = F.left(F.col("prefix"), F.lit(up))
        level = written(level.groupBy(parent.alias("prefix")).agg(F.sha2(F.array_join(children, "\n"), 256).alias("digest"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes")))
        out = out.unionByName(level.withColumn("level", F.lit(up)))
    return out.select("level", "prefix", "digest", "files", "bytes")


def fingerprint(manifest: DataFrame, per_leaf: int = 4096, depth: int | None = None) -> DataFrame:
    """fingerprint, files and bytes: the root of the tree; null and nothing without files."""
    root = merkle(manifest, depth_of(manifest.count(), per_leaf) if depth is None else depth).where("level = 0")
    return root.agg(F.max("digest").alias("fingerprint"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def changed_leaves(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """prefix of the leaves that differ between two trees: from the root down, only below nodes that differ."""
    suspects = old.sparkSession.range(1).select(F.lit("").alias("prefix"))
    for level in range(depth + 1):
        side = lambda tree, name: tree.where(F.col("level") == level).select("prefix", F.col("digest").alias(name))
        both = side(old, "d0").join(side(new, "d1"), "prefix", "full_outer")
        parent = F.left(F.col("prefix"), F.lit(max(0, level - 1)))
        below = both.withColumn("parent", parent).join(suspects.withColumnRenamed("prefix", "parent"), "parent", "left_semi")
        suspects = written(below.where(~F.col("d0").eqNullSafe(F.col("d1"))).select("prefix"))
        if suspects.isEmpty():
            break
    return suspects if level == depth else suspects.limit(0)


def freeze(manifest: DataFrame, path: str, per_leaf: int = 4096, depth: int | None = None) -> None:
    """The manifest, by leaf, and its tree below path, which must not be there yet."""
    spark = manifest.sparkSession
    depth = depth_of(manifest.count(), per_leaf) if depth is None else depth
    leaf = F.left(place(), F.lit(depth))
    manifest.withColumn("leaf", leaf).repartitionByRange("leaf", "path").sortWithinPartitions("leaf", "path").write.mode("errorifexists").parquet(f"{path}/manifest")
    merkle(spark.read.parquet(f"{path}/manifest"), depth).write.mode("errorifexists").parquet(f"{path}/tree")


def verify_frozen(files: DataFrame, path: str) -> DataFrame:
    """path and change of files(path, content) against a frozen version: nothing if they are the same.

    Only leaves whose digests differ are compared file by file; rows of the frozen
    manifest lie in the order of leaves, so others are passed over by their
    bounds.
    """
    spark = files.sparkSession
    now = written(manifest(files))
    tree = spark.read.parquet(f"{path}/tree")
    depth = tree.agg(F.max("level")).first()[0] or 0
    leaves = changed_leaves(tree, merkle(now, depth), depth)
    bounds = leaves.agg(F.min("prefix"), F.max("prefix")).first()
    old = spark.read.parquet(f"{path}/manifest")
    if bounds[0] is None:
        return diff(old.limit(0), now.limit(0))
    old = old.where(F.col("leaf").between(*bounds)).join(leaves.withColumnRenamed("prefix", "leaf"), "leaf", "left_semi")
    new = now.withColumn("leaf", F.left(place(), F.lit(depth))).join(leaves.withColumnRenamed("prefix", "leaf"), "leaf", "left_semi")
    return diff(old, new)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and change - missing, added, size, content - between two manifests."""
    a = old.select("path", F.col("size").alias("s0"), F.col("sha256").alias("h0"))
    b = new.select("path", F.col("size").alias("s1"), F.col("sha256").alias("h1"))
    change = F.when(F.col("h1").isNull(), "missing").when(F.col("h0").isNull(), "added").when(F.col("s0") != F.col("s1"), "size").when(F.col("h0") != F.col("h1"), "content")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def verify(old: DataFrame, new: DataFrame) -> None:
    """Raises unless two manifests are the same."""
    depth = depth_of(old.count())
    if not changed_leaves(merkle(old, depth), merkle(new, depth), depth).isEmpty():
        raise ValueError("the dataset differs from its manifest")


def gate(files: DataFrame, path: str, shown: int = 5) -> None:
    """For the start of a training run: raises, naming a few changes, unless files are those of the frozen version."""
    first = verify_frozen(files, path).orderBy("path").limit(shown).collect()
    if first:
        raise ValueError("the dataset differs from its frozen version: " + ", ".join(f"{r['path']} ({r['change']})" for r in first))


def relabel(boxes: DataFrame, fixes: DataFrame, prefix_class: DataFrame | None = None) -> DataFrame:
    """boxes(image_id, stem, prefix, class_id, ...) with new_class: a fix by stem, else the class of the prefix, else the old class."""
    out = boxes.join(fixes.select("stem", "fix"), "stem", "left")
    if prefix_class is not None:
        out = out.join(prefix_class, "prefix", "left")
        return out.withColumn("new_class", F.coalesce("fix", "prefix_class", "class_id")).drop("fix", "prefix_class")
    return out.withColumn("new_class", F.coalesce("fix", "class_id")).drop("fix")


def audit(relabelled: DataFrame) -> DataFrame:
    """Rows whose class changed."""
    return relabelled.where("class_id <> new_class").select("image_id", "label_id", F.col("class_id").alias("old_class"), "new_class")


def resolve_pairs(members: DataFrame) -> DataFrame:
    """Of each group of equal images the row to keep: the reviewed one, then the smaller box, then the smaller id."""
    w = Window.partitionBy("digest").orderBy(F.desc("reviewed"), "box_area", "item_id")
    return members.withColumns({"rank": F.row_number().over(w), "keep_id": F.first("item_id").over(w)}).select("digest", "item_id", "keep_id", F.when(F.col("rank") == 1, "keep").otherwise("drop").alias("action"))
