"""Trees of digests, frozen versions, the label cache and cluster placement."""

import hashlib
import random

import pytest
from boxlake.operators import split, version
from boxlake.sources import dataset
from pyspark.sql import functions as F


def files(spark, contents):
    return spark.createDataFrame(list(contents.items()), "path string, content binary").repartition(3)


def plain_tree(contents, depth):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = sorted((p, f"{p}\t{len(c)}\t{hashlib.sha256(c).hexdigest()}") for p, c in contents.items())
    out, level = {}, {}
    for p, line in lines:
        level.setdefault(hashlib.md5(p.encode()).hexdigest()[:depth], []).append(line)
    level = {k: digest("\n".join(v)) for k, v in level.items()}
    for d in range(depth, -1, -1):
        out |= {(d, k): v for k, v in level.items()}
        up = {}
        for k in sorted(level):
            up.setdefault(k[: d - 1], []).append(k + level[k])
        level = {k: digest("\n".join(v)) for k, v in up.items()}
    return out


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_tree_matches_a_plain_one(spark, depth):
    contents = {f"a/{i}.txt": bytes([i]) * i for i in range(70)}
    got = {(r.level, r.prefix): r.digest for r in version.merkle(version.manifest(files(spark, contents)), depth).collect()}
    assert got == plain_tree(contents, depth)
    assert version.fingerprint(version.manifest(files(spark, contents)), depth=depth).first()["fingerprint"] == got[0, ""]


def test_walk_visits_changed_branches_only(spark):
    old = {f"f{i}": b"x" for i in range(300)}
    new = {k: v for k, v in old.items() if k != "f7"} | {"f9": b"yy", "g": b"new"}
    depth = 3
    trees = [version.merkle(version.manifest(files(spark, c)), depth) for c in (old, new)]
    leaves = {r.prefix for r in version.changed_leaves(*trees, depth).collect()}
    assert leaves == {hashlib.md5(p.encode()).hexdigest()[:depth] for p in ("f7", "f9", "g")}
    assert version.changed_leaves(trees[0], trees[0], depth).count() == 0


def test_freeze_verify_and_gate(spark, tmp_path):
    old = {f"f{i}": b"x" * i for i in range(200)}
    path = str(tmp_path / "v1")
    version.freeze(version.manifest(files(spark, old)), path, per_leaf=8)
    assert version.verify_frozen(files(spark, old), path).count() == 0
    version.gate(files(spark, old), path)
    new = {k: v for k, v in old.items() if k != "f3"} | {"f5": b"yyyyy", "f6": b"longer than before", "h": b""}
    assert {tuple(r) for r in version.verify_frozen(files(spark, new), path).collect()} == {("f3", "missing"), ("f5", "content"), ("f6", "size"), ("h", "added")}
    with pytest.raises(ValueError, match="f3 .missing"):
        version.gate(files(spark, new), path)
    with pytest.raises(Exception, match="(?i)exist"):
        version.freeze(version.manifest(files(spark, old)), path)
    nothing = files(spark, old).limit(0)
    assert version.verify_frozen(nothing, path).count() == 200
    version.freeze(version.manifest(nothing), str(tmp_path / "none"))
    assert version.verify_frozen(files(spark, old), str(tmp_path / "none")).where("change = 'added'").count() == 200


def test_fixes_are_joined_whatever_their_number(spark):
    boxes = spark.range(1000).select(F.col("id").alias("image_id"), F.col("id").cast("string").alias("stem"), F.lit("p").alias("prefix"), F.lit(1).cast("long").alias("label_id"), F.lit(0).cast("long").alias("class_id"))
    fixes = boxes.select("stem", F.lit(2).cast("long").alias("fix"))
    plan = version.relabel(boxes, fixes)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan.lower()
    assert version.audit(version.relabel(boxes, fixes)).count() == 1000


def test_label_cache_parses_what_changed(spark, tmp_path):
    cache, parsed = dataset.LabelCache(spark, str(tmp_path / "c")), []

    def parse(df):
        parsed.append(sorted(r.path for r in df.collect()))
        return dataset.label_boxes(df)

    one = {"a": b"0 .5 .5 .1 .1\n1 .5 .5 .1", "b": b"2 .5 .5 .1 1.5", "c": b"\n  \n"}
    assert cache.refresh(files(spark, one), parse) == {"files": 3, "parsed": 3, "removed": 0, "kept": 0}
    two = {"a": one["a"], "b": b"2 .5 .5 .1 .15", "d": b"3 0 0 1 1"}
    assert cache.refresh(files(spark, two), parse) == {"files": 3, "parsed": 2, "removed": 1, "kept": 1}
    assert sorted((r.path, r.line_no, r.class_id, r.valid) for r in cache.rows().collect()) == [("a", 0, 0, True), ("a", 1, None, False), ("b", 0, 2, True), ("d", 0, 3, True)]
    assert cache.refresh(files(spark, two), parse)["parsed"] == 0
    cache.refresh(files(spark, one), parse)
    assert parsed == [["a", "b", "c"], ["b", "d"], [], ["b", "c"]]
    assert {(r.path, r.valid) for r in cache.rows().collect()} == {("a", True), ("a", False), ("b", False)}


def test_broken_refresh_leaves_the_version_before(spark, tmp_path):
    cache = dataset.LabelCache(spark, str(tmp_path / "c"))
    cache.refresh(files(spark, {"a": b"0 .5 .5 .1 .1"}), dataset.label_boxes)
    with pytest.raises(Exception, match="stop"):
        cache.refresh(files(spark, {"a": b"1 .5 .5 .1 .1"}), lambda df: dataset.label_boxes(df).withColumn("x", F.raise_error(F.lit("stop"))))
    assert cache.version() == 0 and [r.class_id for r in cache.rows().collect()] == [0]
    cache.refresh(files(spark, {"a": b"1 .5 .5 .1 .1"}), dataset.label_boxes)
    assert [r.class_id for r in cache.rows().collect()] == [1]


def greedy(clusters, fixed, target):
    """One cluster after the other."""
    order = list(target)
    total, have = {}, dict(fixed)
    for (_, c), n in fixed.items():
        total[c] = total.get(c, 0) + n
    for _, c, n in clusters:
        total[c] = total.get(c, 0) + n
    out = {}
    for i, c, n in sorted(clusters, key=lambda x: (-x[2], x[1], x[0])):

        def cost(s, c=c, n=n):
            mine, every = have.get((s, c), 0), sum(v for (t, _), v in have.items() if t == s)
            want, want_all = total[c] * target[s], sum(total.values()) * target[s]
            return round(abs(mine + n - want) - abs(mine - want) + 0.35 * (abs(every + n - want_all) - abs(every - want_all)), 6)

        out[i] = min(order, key=lambda s: (cost(s), order.index(s)))
        have[out[i], c] = have.get((out[i], c), 0) + n
    return out


@pytest.mark.parametrize("seed", range(12))
def test_placement_in_steps_is_the_greedy_one(seed):
    r = random.Random(seed)
    clusters = [(i, r.randrange(3), r.choice([1, 1, 1, 2, 3, 7, 20])) for i in range(r.choice([5, 60, 400]))]
    fixed = {(s, c): r.randrange(40) for s in ("train", "val") for c in range(3)}
    target = {"train": 0.7, "val": 0.2, "test": 0.1}
    runs = {}
    for i, c, n in sorted(clusters):
        runs.setdefault((n, c), []).append(i)
    got = {}
    for n, c, first, last, s in split.placements([(n, c, len(v)) for (n, c), v in runs.items()], fixed, target):
        got |= {i: s for i in runs[n, c][first : last + 1]}
    assert got == greedy(clusters, fixed, target)


def test_many_equal_clusters_take_few_steps():
    steps = split.placements([(1, 0, 10_000_000), (1, 1, 10_000_000)], {}, {"train": 0.7, "val": 0.15, "test": 0.15})
    assert len(steps) < 40 and sum(last - first + 1 for *_, first, last, _ in steps) == 20_000_000


def test_refresh_shuffles_and_writes_no_more_than_it_needs(spark, tmp_path):
    cache = dataset.LabelCache(spark, str(tmp_path / "c"))
    some = {f"f{i}": b"0 .5 .5 .1 .1" for i in range(9)} | {"none": None}
    assert cache.refresh(files(spark, some), dataset.label_boxes) == {"files": 10, "parsed": 10, "removed": 0, "kept": 0}
    assert "Exchange" not in cache.rows()._jdf.queryExecution().executedPlan().toString()
    assert "digest" not in spark.read.parquet(str(tmp_path / "c/segments")).columns
    fewer = {k: v for k, v in some.items() if k != "f3"} | {"f4": b"1 .5 .5 .1 .1"}
    assert cache.refresh(files(spark, fewer), dataset.label_boxes) == {"files": 9, "parsed": 2, "removed": 1, "kept": 7}
    assert sorted((r.path, r.class_id) for r in cache.rows().collect()) == [(f"f{i}", int(i == 4)) for i in range(9) if i != 3]
    assert cache.refresh(files(spark, fewer), dataset.label_boxes) == {"files": 9, "parsed": 1, "removed": 0, "kept": 8}
