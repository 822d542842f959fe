"""Queries of profiling, validation, deduplication, splitting and versioning, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.fixtures import fixture, table, with_sql
from boxlake.operators import dedup, profile, split, validate, version
from boxlake.operators.scan import shared_path, written
from boxlake.sources import dataset

Q: dict = {}
SQL: dict[str, str] = {}
NAMES = ["bolt", "nut", "gear", "ring", "cap", "rod"]


def query(f):
    Q[f.__name__] = f
    return f


def names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "class_id long, class_name string")


NAMES_SQL = "names AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{n}')" for i, n in enumerate(NAMES)) + ") v(class_id, class_name))"


@query
def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.class_distribution(fixture(spark, d, "gt"))


SQL["class_distribution"] = f"{with_sql('gt')} SELECT split, class_id, count(*) AS n, round(1e2 * count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS percent FROM gt GROUP BY split, class_id"


@query
def split_totals(spark: SparkSession, d: str) -> DataFrame:
    return profile.split_totals(fixture(spark, d, "gt"))


SQL["split_totals"] = f"{with_sql('gt')} SELECT split, count(*) AS boxes, count(DISTINCT image_id) AS images FROM gt GROUP BY ROLLUP (split)"


@query
def size_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.size_distribution(fixture(spark, d, "gt"), 640.0, 480.0)


_BIN = "CASE WHEN s < 5 THEN '<5' WHEN s < 16 THEN '5-16' WHEN s < 32 THEN '16-32' WHEN s < 64 THEN '32-64' WHEN s < 128 THEN '64-128' ELSE '>=128' END"
SQL["size_distribution"] = f"""{with_sql('gt')}, b AS (SELECT split, {_BIN} AS bin FROM (SELECT split, sqrt(w * h) AS s FROM gt)),
f AS (SELECT split, bin FROM (SELECT DISTINCT split FROM gt) CROSS JOIN (VALUES ('<5'), ('5-16'), ('16-32'), ('32-64'), ('64-128'), ('>=128')) v(bin))
SELECT f.split, f.bin, count(b.bin) AS n FROM f LEFT JOIN b USING (split, bin) GROUP BY ALL"""


@query
def numeric_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.summary(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")


SQL["numeric_summary"] = "SELECT l_returnflag, round(min(l_extendedprice), 6) AS min, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for q, n in ((0.05, "p05"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"))) + ", round(avg(l_extendedprice), 6) AS mean, round(max(l_extendedprice), 6) AS max FROM lineitem GROUP BY 1"


@query
def prefix_majority_suspects(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("prefix"), F.when(F.col("p_partkey") % 19 == 0, 1).otherwise(0).alias("class_id"))
    return profile.prefix_suspects(items)


SQL["prefix_majority_suspects"] = """WITH i AS (SELECT p_partkey AS item_id, p_brand AS prefix, CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END AS class_id FROM part),
c AS (SELECT prefix, class_id, count(*) AS n, min(item_id) AS first, sum(count(*)) OVER (PARTITION BY prefix) AS total FROM i GROUP BY prefix, class_id),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, first) = 1)
SELECT item_id, i.prefix, i.class_id, m.class_id AS majority, round(n / total, 6) AS majority_share FROM i JOIN m ON i.prefix = m.prefix WHERE total >= 5 AND n / total >= 8e-1 AND i.class_id <> m.class_id"""


@query
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return profile.class_weights(fixture(spark, d, "gt"), 8).withColumn("weight", F.round("weight", 12))


_CW = "cw AS (SELECT c AS class_id, w / sum(w) OVER () AS weight FROM (SELECT c, 1e0 / greatest(count(class_id), 1) AS w FROM range(8) r(c) LEFT JOIN gt ON class_id = c GROUP BY c) x)"
SQL["class_weights"] = f"{with_sql('gt')}, {_CW} SELECT class_id, round(weight, 12) AS weight FROM cw"


@query
def image_weights(spark: SparkSession, d: str) -> DataFrame:
    gt = fixture(spark, d, "gt")
    return profile.image_weights(gt, profile.class_weights(gt, 8)).withColumn("weight", F.round("weight", 12))


SQL["image_weights"] = f"{with_sql('gt')}, {_CW} SELECT image_id, round(sum(weight), 12) AS weight FROM gt JOIN cw USING (class_id) GROUP BY image_id"


@query
def dataset_stats(spark: SparkSession, d: str) -> DataFrame:
    return profile.dataset_stats(fixture(spark, d, "images"), fixture(spark, d, "gt"))


SQL["dataset_stats"] = f"""{with_sql('images', 'gt')}, u AS (SELECT split, count(*) AS n FROM images WHERE image_id NOT IN (SELECT image_id FROM gt) GROUP BY split)
SELECT i.split, class_id, count(*) AS instances, count(DISTINCT i.image_id) AS images, coalesce(max(u.n), 0) AS unlabelled FROM images i JOIN gt USING (image_id) LEFT JOIN u ON u.split = i.split GROUP BY i.split, class_id"""


@query
def shared_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.shared_histogram(fixture(spark, d, "images"), "sharpness", "split")


SQL["shared_histogram"] = f"""{with_sql('images')}, e AS (SELECT min(sharpness) AS lo, max(sharpness) AS hi FROM images),
c AS (SELECT split, least(39, floor((sharpness - lo) / (hi - lo) * 40))::BIGINT AS bin, count(*) AS n FROM images, e GROUP BY ALL) SELECT *, round(1e2 * n / sum(n) OVER (PARTITION BY split), 6) AS percent FROM c"""


@query
def joint_histogram(spark: SparkSession, d: str) -> DataFrame:
    return profile.joint_histogram(fixture(spark, d, "gt"), "w", "h", 20.0)


SQL["joint_histogram"] = f"{with_sql('gt')} SELECT floor(w / 20)::BIGINT AS bx, floor(h / 20)::BIGINT AS by, count(*) AS n, round(ln(count(*)), 9) AS log_n FROM gt GROUP BY 1, 2"


@query
def detection_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.class_summary_text(fixture(spark, d, "det"), names(spark))


SQL["detection_counts"] = f"""{with_sql('det')}, {NAMES_SQL}, c AS (SELECT image_id, class_id, count(*) AS n FROM det GROUP BY ALL)
SELECT image_id, string_agg(n || ' ' || class_name || CASE WHEN n > 1 THEN 's' ELSE '' END, ', ' ORDER BY class_id) AS summary FROM c JOIN names USING (class_id) GROUP BY image_id"""


@query
def class_confidences(spark: SparkSession, d: str) -> DataFrame:
    return profile.class_confidences(fixture(spark, d, "det"), 6)


SQL["class_confidences"] = f"{with_sql('det')} SELECT image_id, " + ", ".join(f"round(coalesce(avg(conf) FILTER (class_id = {c}), 0), 9) AS class_{c}" for c in range(6)) + " FROM det WHERE conf >= 25e-2 GROUP BY image_id"


@query
def class_sets(spark: SparkSession, d: str) -> DataFrame:
    return profile.class_sets(fixture(spark, d, "gt"), names(spark))


SQL["class_sets"] = f"{with_sql('gt')}, {NAMES_SQL} SELECT image_id, string_agg(DISTINCT class_name, ',' ORDER BY class_name) AS classes FROM gt JOIN names USING (class_id) GROUP BY image_id"


@query
def topk_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.slice("embedding", 1, 10).alias("scores"))
    return profile.topk_accuracy(e)


SQL["topk_accuracy"] = """WITH r AS (SELECT vec_id, label, i, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i + 1] DESC, i) AS k FROM embeddings, range(10) g(i)),
t AS (SELECT vec_id, label, max((k = 1 AND i = label)::INT) AS a, max((k <= 5 AND i = label)::INT) AS b FROM r GROUP BY ALL) SELECT label, count(*) AS n, avg(a) AS top1, avg(b) AS top5 FROM t GROUP BY label"""


@query
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    gt = fixture(spark, d, "gt").withColumn("key", F.col("image_id") * 10 + F.col("label_id"))
    return profile.even_sample(gt, "class_id", "key", 20).select("class_id", "image_id", "label_id")


SQL["even_sample"] = f"""{with_sql('gt')}, r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY image_id * 10 + label_id) - 1 AS i, count(*) OVER (PARTITION BY class_id) AS n FROM gt)
SELECT class_id, image_id, label_id FROM r WHERE n <= 20 OR i IN (SELECT round_even(k * (n - 1) / 19e0, 0)::BIGINT FROM range(20) g(k))"""


@query
def quality_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 200 sharpest-looking images of train and val by the quality score."""
    i = fixture(spark, d, "images").where("split <> 'test'")
    q = F.round(dedup.quality(F.col("sharpness"), F.col("brightness"), F.col("overexposed"), F.col("underexposed")), 9)
    return i.select("image_id", q.alias("quality")).orderBy(F.desc("quality"), "image_id").limit(200)


_QUALITY = "round(ln(1 + sharpness) - abs(brightness - 128) / 64 - 3 * overexposed - 2 * underexposed, 9)"
SQL["quality_topk"] = f"{with_sql('images')} SELECT image_id, {_QUALITY} AS quality FROM images WHERE split <> 'test' ORDER BY quality DESC, image_id LIMIT 200"


@query
def label_issues(spark: SparkSession, d: str) -> DataFrame:
    return validate.label_issues(fixture(spark, d, "lines"), 80)


_PARSED = """p AS (SELECT image_id, line_no, t, len(t) AS n, try_cast(t[1] AS DOUBLE) AS c, try_cast(t[2] AS DOUBLE) AS x, try_cast(t[3] AS DOUBLE) AS y, try_cast(t[4] AS DOUBLE) AS w, try_cast(t[5] AS DOUBLE) AS h FROM (SELECT *, string_split(line, ' ') AS t FROM lines)),
ok AS (SELECT *, n = 5 AND c IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL AS num FROM p), wh AS (SELECT * FROM ok WHERE num AND c = floor(c))"""
_IN = "x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1"
SQL["label_issues"] = f"""{with_sql('lines')}, {_PARSED} SELECT image_id, line_no, 'invalid_column_count' AS issue FROM ok WHERE n <> 5 UNION ALL SELECT image_id, line_no, 'non_numeric_label' FROM ok WHERE n = 5 AND NOT num
UNION ALL SELECT image_id, line_no, 'non_integer_class' FROM ok WHERE num AND c <> floor(c) UNION ALL SELECT image_id, line_no, 'coordinate_out_of_range' FROM wh WHERE NOT ({_IN})
UNION ALL SELECT image_id, line_no, 'box_crosses_boundary' FROM wh WHERE {_IN} AND (x - w / 2 < 0 OR x + w / 2 > 1 OR y - h / 2 < 0 OR y + h / 2 > 1) UNION ALL SELECT image_id, line_no, 'class_out_of_range' FROM wh WHERE c < 0 OR c >= 80
UNION ALL SELECT image_id, line_no, 'duplicate_box' FROM (SELECT *, row_number() OVER (PARTITION BY image_id, c, x, y, w, h ORDER BY line_no) AS k FROM wh) WHERE k > 1"""


@query
def kept_boxes(spark: SparkSession, d: str) -> DataFrame:
    return validate.kept_boxes(fixture(spark, d, "lines"))


SQL["kept_boxes"] = f"{with_sql('lines')}, {_PARSED} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY line_no)::INTEGER AS line_number, c::BIGINT AS class_id, x, y, w, h FROM wh"


@query
def strict_report(spark: SparkSession, d: str) -> DataFrame:
    return validate.strict_report(fixture(spark, d, "images"), fixture(spark, d, "lines"))


SQL["strict_report"] = f"""{with_sql('images', 'lines')}, {_PARSED}, g AS (SELECT image_id, max((NOT num OR c <> floor(c) OR least(c, x, y, w, h) < 0 OR greatest(x, y, w, h) > 1)::INT) AS bad, count(DISTINCT (c, x, y, w, h)) FILTER (c IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL) AS boxes FROM ok GROUP BY image_id)
SELECT i.image_id, CASE WHEN bad = 1 THEN 'corrupt' WHEN boxes IS NULL THEN 'missing' WHEN boxes = 0 THEN 'empty' ELSE 'found' END AS status, coalesce(boxes, 0) AS boxes FROM images i LEFT JOIN g USING (image_id)"""


@query
def orphan_labels(spark: SparkSession, d: str) -> DataFrame:
    i, l = fixture(spark, d, "images"), fixture(spark, d, "gt").select("image_id").distinct()
    images = i.where("image_id % 7 <> 0").select(F.col("image_id").alias("key"), "path")
    return validate.pairing(images, l.select(F.col("image_id").alias("key"), F.concat(F.lit("/labels/"), F.col("image_id").cast("string")).alias("path")))


SQL["orphan_labels"] = f"""{with_sql('images', 'gt')}, a AS (SELECT image_id, path FROM images WHERE image_id % 7 <> 0), b AS (SELECT DISTINCT image_id, '/labels/' || image_id AS path FROM gt)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing_label' ELSE 'orphan_label' END AS issue FROM a FULL JOIN b USING (image_id) WHERE a.path IS NULL OR b.path IS NULL"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 10 == 0, "val").when(F.col("doc_id") % 10 == 1, "test").otherwise("train").alias("split"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


_DOCS = "d AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 10 = 0 THEN 'val' WHEN doc_id % 10 = 1 THEN 'test' ELSE 'train' END AS split, sha256(coalesce(text, '')) AS digest FROM documents)"
_GROUPS = f"{_DOCS}, g AS (SELECT digest, count(*) AS members, min(item_id) AS first_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(DISTINCT split) > 1 AS cross_split FROM d GROUP BY digest HAVING count(*) > 1)"


@query
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.numbered(dedup.exact_groups(_docs(spark, d)))


SQL["exact_duplicates"] = f"WITH {_GROUPS} SELECT *, row_number() OVER (ORDER BY first_id) AS group_no FROM g"


@query
def cross_split_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_groups(_docs(spark, d)).where("cross_split").groupBy("splits").agg(F.count("*").alias("groups"), F.sum("members").alias("members"))


SQL["cross_split_duplicates"] = f"WITH {_GROUPS} SELECT splits, count(*) AS groups, sum(members)::BIGINT AS members FROM g WHERE cross_split GROUP BY splits"


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    """Sign bits of the embeddings, and of each two copies with up to eleven bits turned."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.array(*map(F.lit, range(3)))).alias("c"))
    place = F.col("vec_id") * (7 - 2 * F.col("c"))
    turned = lambda i: (F.col("c") > 0) & (F.pmod((i - place) * 35, F.lit(64)) < F.col("vec_id") % (13 - F.col("c") * 3))
    bits = F.transform("embedding", lambda v, i: F.when((v >= 0) == turned(i), -1.0).otherwise(1.0))
    return e.select((F.col("vec_id") + F.col("c") * 1_000_000).alias("item_id"), dedup.sign_hash(bits).alias("hash"))


_HASH = """h0 AS (SELECT vec_id, c, i, (embedding[i + 1] >= 0) <> (c > 0 AND ((((i - vec_id * (7 - 2 * c)) * 35) % 64 + 64) % 64) < vec_id % (13 - c * 3)) AS bit FROM embeddings, range(64) g(i), range(3) k(c)),
h AS (SELECT vec_id + c * 1000000 AS vec_id, string_agg(CASE WHEN bit THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS b FROM h0 GROUP BY h0.vec_id, c), p AS (SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.b, y.b))::INTEGER AS hamming FROM h x JOIN h y ON x.vec_id < y.vec_id AND bit_count(xor(x.b, y.b)) <= 9)"""
LIMIT = dedup.hamming_limit(0.85)


@query
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.hamming_pairs(_hashes(spark, d), LIMIT)


SQL["hamming_pairs"] = f"WITH {_HASH} SELECT * FROM p"


@query
def split_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Similar pairs by the splits of their ends."""
    return dedup.pair_counts(_hashes(spark, d).withColumn("split", F.when(F.col("item_id") % 3 == 0, "val").otherwise("train")), LIMIT)


SQL["split_pair_counts"] = f"WITH {_HASH}, s AS (SELECT CASE WHEN a % 3 = 0 THEN 'val' ELSE 'train' END AS x, CASE WHEN b % 3 = 0 THEN 'val' ELSE 'train' END AS y FROM p) SELECT least(x, y) || '-' || greatest(x, y) AS pair, count(*) AS n FROM s GROUP BY 1"


@query
def similarity_components(spark: SparkSession, d: str) -> DataFrame:
    labels = dedup.components(dedup.linking_edges(_hashes(spark, d), LIMIT))
    members = labels.withColumn("split", F.when(F.col("node") % 3 == 0, "val").otherwise("train"))
    return dedup.clusters(members).select("cluster_no", "size", "node", F.col("label").alias("first"))


_COMP = f"WITH RECURSIVE {_HASH}, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(n, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON r.n = e.a), c AS (SELECT n AS node, min(m) AS label FROM r GROUP BY n)"
SQL["similarity_components"] = f"""{_COMP}, s AS (SELECT label, count(*) AS size FROM c GROUP BY label HAVING count(DISTINCT CASE WHEN node % 3 = 0 THEN 1 ELSE 0 END) > 1), k AS (SELECT *, row_number() OVER (ORDER BY size DESC, label) AS cluster_no FROM s)
SELECT cluster_no, size, node, c.label AS first FROM c JOIN k ON c.label = k.label"""


@query
def greedy_representatives(spark: SparkSession, d: str) -> DataFrame:
    pairs = dedup.hamming_pairs(_hashes(spark, d), LIMIT)
    members = dedup.components(pairs).select(F.col("label").alias("cluster_id"), F.col("node").alias("item_id"), (F.pmod(F.col("node") * 37, F.lit(101)) / 101.0).alias("quality"))
    return dedup.representatives(members, pairs)


SQL["greedy_representatives"] = f"""{_COMP}, q AS (SELECT label, node, node * 37 % 101 / 101e0 AS quality, coalesce((SELECT list(e.b) FROM e WHERE e.a = node), []) AS near FROM c),
g AS (SELECT label, list({{'id': node, 'near': near}} ORDER BY quality DESC, node) AS ms FROM q GROUP BY label),
f AS (SELECT label, ms, list_reduce(ms, lambda acc, x: CASE WHEN list_has_any(acc, x.near) THEN acc ELSE list_append(acc, x.id) END, CAST([] AS BIGINT[])) AS reps FROM g)
SELECT label AS cluster_id, m.id AS item_id, list_contains(reps, m.id) AS kept, CASE WHEN list_contains(reps, m.id) THEN m.id ELSE list_filter(reps, lambda r: list_contains(m.near, r))[1] END AS represented_by FROM (SELECT label, reps, unnest(ms) AS m FROM f)"""


@query
def cluster_conflicts(spark: SparkSession, d: str) -> DataFrame:
    labels = dedup.components(dedup.linking_edges(_hashes(spark, d), LIMIT)).withColumnRenamed("label", "cluster_id")
    e = table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.array(*map(F.lit, range(3)))).alias("c")).select((F.col("vec_id") + F.col("c") * 1_000_000).alias("node"), F.when(F.col("c") == 2, 9 - F.col("label")).otherwise(F.col("label")).alias("class_id"), "vec_id").select("node", "class_id", F.when(F.col("node") % 3 == 0, "val").otherwise("train").alias("split"))
    return dedup.cluster_summary(labels.join(e.hint("merge"), "node"))


SQL["cluster_conflicts"] = f"""{_COMP} SELECT c.label AS cluster_id, count(*) AS size, count(DISTINCT CASE WHEN node >= 2000000 THEN 9 - e2.label ELSE e2.label END) AS n_classes, count(DISTINCT CASE WHEN node >= 2000000 THEN 9 - e2.label ELSE e2.label END) > 1 AS conflict, string_agg(DISTINCT CASE WHEN node % 3 = 0 THEN 'val' ELSE 'train' END, ',' ORDER BY CASE WHEN node % 3 = 0 THEN 'val' ELSE 'train' END) AS splits
FROM c JOIN embeddings e2 ON e2.vec_id = node % 1000000 GROUP BY c.label"""


@query
def auto_split(spark: SparkSession, d: str) -> DataFrame:
    return split.auto_split(fixture(spark, d, "images").select("image_id"), "image_id", (0.8, 0.15, 0.05))


_BUCKET = "(('0x' || substr(md5(image_id::VARCHAR), 1, 13))::BIGINT % 1000000) / 1e6"
SQL["auto_split"] = f"{with_sql('images')} SELECT image_id, CASE WHEN {_BUCKET} < 8e-1 THEN 'train' WHEN {_BUCKET} < 8e-1 + 15e-2 THEN 'val' ELSE 'test' END AS split FROM images"


@query
def sample_per_split(spark: SparkSession, d: str) -> DataFrame:
    return split.sample_per_group(fixture(spark, d, "images").select("split", "image_id"), "split", "image_id", 50)


SQL["sample_per_split"] = f"{with_sql('images')} SELECT split, image_id FROM images QUALIFY row_number() OVER (PARTITION BY split ORDER BY md5(image_id::VARCHAR), image_id) <= 50"


@query
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    items = fixture(spark, d, "gt").groupBy(F.col("image_id").alias("item_id")).agg(F.sum("class_id").alias("weight")).where("weight > 0")
    return split.weighted_draws(items, 500)


SQL["weighted_sample"] = f"""{with_sql('gt')}, i AS (SELECT image_id, sum(class_id) AS weight FROM gt GROUP BY image_id HAVING sum(class_id) > 0), c AS (SELECT image_id, sum(weight) OVER (ORDER BY image_id) AS upto, weight FROM i),
u AS (SELECT k AS image_id FROM range(500) r(k)), p AS (SELECT image_id AS draw, {_BUCKET} * (SELECT sum(weight) FROM i) AS point FROM u) SELECT draw, c.image_id AS item_id FROM p JOIN c ON point >= upto - weight AND point < upto"""


_TARGET = {"train": 0.7, "val": 0.15, "test": 0.15}
_FIXED = [("train", 0, 30), ("val", 1, 20), ("test", 2, 1)]


@query
def cluster_split_plan(spark: SparkSession, d: str) -> DataFrame:
    """Customers as clusters of orders, placed greedily so that classes near 70/15/15."""
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("cluster_id")).agg(F.count("*").alias("amount")).withColumn("class_id", F.col("cluster_id") % 3)
    fixed = spark.createDataFrame(_FIXED, "split string, class_id long, n long")
    return split.balance_clusters(c, fixed, _TARGET)


def _plan_sql() -> str:
    """One cluster after the other: h<split><class> count what each split holds."""
    cells = [(s, c) for s in range(3) for c in range(3)]
    start = ", ".join(f"{sum(n for t, k, n in _FIXED if list(_TARGET).index(t) == s and k == c)}::BIGINT AS h{s}{c}" for s, c in cells)
    shares = list(_TARGET.values())
    of_class = lambda s: f"CASE class_id WHEN 0 THEN h{s}0 WHEN 1 THEN h{s}1 ELSE h{s}2 END"
    gap = lambda have, want: f"(abs({have} + amount - {want}) - abs({have} - {want}))"
    cost = ", ".join(f"round({gap(f'({of_class(s)})', f'class_total * {w!r}::DOUBLE')} + 35e-2 * {gap(f'(h{s}0 + h{s}1 + h{s}2)', f'all_total * {w!r}::DOUBLE')}, 6) AS cost{s}" for s, w in enumerate(shares))
    grown = ", ".join(f"h{s}{c} + CASE WHEN pick = {s} AND class_id = {c} THEN amount ELSE 0 END" for s, c in cells)
    held = ", ".join(f"h{s}{c}" for s, c in cells)
    return f"""WITH RECURSIVE c AS (SELECT o_custkey::BIGINT AS cluster_id, count(*) AS amount, o_custkey % 3 AS class_id FROM orders GROUP BY o_custkey),
fx AS (SELECT * FROM (VALUES {", ".join(f"({k}, {n})" for _, k, n in _FIXED)}) v(class_id, n)),
t AS (SELECT class_id, sum(n)::DOUBLE AS class_total FROM (SELECT class_id, amount AS n FROM c UNION ALL FROM fx) GROUP BY class_id),
o AS MATERIALIZED (SELECT c.*, class_total, (SELECT sum(class_total) FROM t) AS all_total, row_number() OVER (ORDER BY amount DESC, c.class_id, cluster_id) AS k FROM c JOIN t ON t.class_id = c.class_id),
st AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS cluster_id, NULL::BIGINT AS class_id, NULL::BIGINT AS amount, -1 AS pick, {start}
  UNION ALL SELECT k, cluster_id, class_id, amount, pick, {grown} FROM (
    SELECT *, CASE WHEN cost0 <= cost1 AND cost0 <= cost2 THEN 0 WHEN cost1 <= cost2 THEN 1 ELSE 2 END AS pick FROM (
      SELECT o.k, o.cluster_id, o.class_id, o.amount, {held}, {cost.replace("class_id", "o.class_id").replace("amount", "o.amount")} FROM st JOIN o ON o.k = st.k + 1) x) y)
SELECT cluster_id, class_id, amount, CASE pick WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS target_split FROM st WHERE k > 0"""


SQL["cluster_split_plan"] = _plan_sql()


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("train/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), "doc_id")


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the documents as files: some are missing from each, some are longer or turned round in the later one."""
    docs = _files(spark, d)
    changed = docs.where("doc_id % 13 <> 0").withColumn("content", F.when(F.col("doc_id") % 17 == 0, F.concat("content", F.lit(b"!"))).when(F.col("doc_id") % 19 == 0, F.reverse(F.col("content").cast("string")).cast("binary")).otherwise(F.col("content")))
    return docs.where("doc_id % 11 <> 0"), changed


@query
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return version.diff(*map(version.manifest, _versions(spark, d)))


SQL["manifest_diff"] = """WITH f AS (SELECT doc_id, 'train/' || doc_id || '.txt' AS path, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, path, CASE WHEN doc_id % 17 = 0 THEN t || '!' WHEN doc_id % 19 = 0 THEN list_aggregate(list_reverse(string_split(t, '')), 'string_agg', '') ELSE t END AS t FROM f WHERE doc_id % 13 <> 0),
o AS (SELECT * FROM f WHERE doc_id % 11 <> 0) SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'missing' WHEN o.path IS NULL THEN 'added' WHEN strlen(o.t) <> strlen(n.t) THEN 'size' ELSE 'content' END AS change
FROM o FULL JOIN n ON o.path = n.path WHERE n.path IS NULL OR o.path IS NULL OR o.t <> n.t"""


_TREE = """f AS (SELECT 'train/' || doc_id || '.txt' AS path, strlen(coalesce(text, '')) AS size, sha256(coalesce(text, '')) AS h FROM documents),
n2 AS (SELECT substr(md5(path), 1, 2) AS prefix, sha256(string_agg(path || chr(9) || size || chr(9) || h, chr(10) ORDER BY path)) AS digest, count(*) AS files, sum(size)::BIGINT AS bytes FROM f GROUP BY 1),
n1 AS (SELECT left(prefix, 1) AS prefix, sha256(string_agg(prefix || digest, chr(10) ORDER BY prefix)) AS digest, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM n2 GROUP BY 1),
n0 AS (SELECT '' AS prefix, sha256(string_agg(prefix || digest, chr(10) ORDER BY prefix)) AS digest, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM n1)"""


@query
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The root of the tree over all documents as files."""
    return version.fingerprint(version.manifest(_files(spark, d)), depth=2)


SQL["fingerprint"] = f"WITH {_TREE} SELECT digest AS fingerprint, files, bytes FROM n0"


@query
def merkle_tree(spark: SparkSession, d: str) -> DataFrame:
    """All nodes of that tree."""
    return version.merkle(version.manifest(_files(spark, d)), 2)


SQL["merkle_tree"] = f"WITH {_TREE} SELECT 2 AS level, * FROM n2 UNION ALL SELECT 1, * FROM n1 UNION ALL SELECT 0, * FROM n0"


@query
def frozen_changes(spark: SparkSession, d: str) -> DataFrame:
    """A version of the documents is frozen; a later one is verified against it through the tree."""
    path = shared_path(spark, "frozen")
    old, new = _versions(spark, d)
    version.freeze(version.manifest(old), path, per_leaf=50)
    return version.verify_frozen(new, path)


SQL["frozen_changes"] = SQL["manifest_diff"]


@query
def label_cache(spark: SparkSession, d: str) -> DataFrame:
    """A cache of parsed labels is built, refreshed after changes, and refreshed again without any: what each round parses, keeps and drops, and what the cache then holds."""
    lines = fixture(spark, d, "lines")
    files = lines.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    files = written(files.select("image_id", F.concat_ws("", F.lit("labels/"), "image_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content")))
    longer = F.when(F.col("image_id") % 11 == 0, F.concat("content", F.lit(b"\n0 0.5 0.5 0.5 0.5"))).otherwise(F.col("content"))
    later = files.where("image_id % 7 <> 0").withColumn("content", longer)
    cache = dataset.LabelCache(spark, shared_path(spark, "labels"))
    out = []
    for i, now in enumerate((files.where("image_id % 5 <> 0"), later, later)):
        counts = cache.refresh(now.select("path", "content"), dataset.label_boxes)
        held = cache.rows().agg(F.count_if("valid").alias("boxes"), F.count_if(~F.col("valid")).alias("bad_lines")).first()
        out.append((i, counts["files"], counts["parsed"], counts["kept"], counts["removed"], held["boxes"], held["bad_lines"]))
    return spark.createDataFrame(out, "round int, files long, parsed long, kept long, removed long, boxes long, bad_lines long")


SQL["label_cache"] = f"""{with_sql('lines')}, tk AS (SELECT image_id, string_split(line, ' ') AS t FROM lines),
ok AS (SELECT image_id, len(t) = 5 AND regexp_full_match(t[1], '[0-9]+') AND len(list_filter(t[2:], lambda v: coalesce(TRY_CAST(v AS DOUBLE) BETWEEN 0 AND 1, false))) = 4 AS valid FROM tk),
f AS (SELECT image_id, count(*) FILTER (WHERE valid) AS good, count(*) FILTER (WHERE NOT valid) AS bad, image_id % 5 <> 0 AS in0, image_id % 7 <> 0 AS in1, image_id % 11 = 0 AS longer FROM ok GROUP BY image_id)
SELECT 0 AS round, count(*) AS files, count(*) AS parsed, 0 AS kept, 0 AS removed, sum(good)::BIGINT AS boxes, sum(bad)::BIGINT AS bad_lines FROM f WHERE in0
UNION ALL SELECT 1, count(*) FILTER (WHERE in1), count(*) FILTER (WHERE in1 AND (longer OR NOT in0)), count(*) FILTER (WHERE in0 AND in1 AND NOT longer), count(*) FILTER (WHERE in0 AND NOT in1),
  sum(good + longer::INT) FILTER (WHERE in1)::BIGINT, sum(bad) FILTER (WHERE in1)::BIGINT FROM f
UNION ALL SELECT 2, count(*), 0, count(*), 0, sum(good + longer::INT)::BIGINT, sum(bad)::BIGINT FROM f WHERE in1"""


@query
def relabel_audit(spark: SparkSession, d: str) -> DataFrame:
    """Fixes by image and classes by prefix, then the rows that changed."""
    i = fixture(spark, d, "images").select("image_id", "stem", F.regexp_replace("stem", r"_\d+$", "").alias("prefix"))
    b = fixture(spark, d, "gt").join(i, "image_id")
    fixes = i.where("image_id % 97 = 0").select("stem", F.lit(5).cast("long").alias("fix"))
    prefixes = i.select("prefix").distinct().where("prefix LIKE 'f_1%'").withColumn("prefix_class", F.lit(1).cast("long"))
    return version.audit(version.relabel(b, fixes, prefixes))


SQL["relabel_audit"] = f"""{with_sql('images', 'gt')}, x AS (SELECT gt.image_id, label_id, class_id, CASE WHEN gt.image_id % 97 = 0 THEN 5 WHEN regexp_replace(stem, '_[0-9]+$', '') LIKE 'f_1%' THEN 1 ELSE class_id END AS n FROM gt JOIN images i ON i.image_id = gt.image_id)
SELECT image_id, label_id, class_id AS old_class, n::BIGINT AS new_class FROM x WHERE class_id <> n"""


@query
def resolve_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Which of equal documents to keep: a reviewed one first, then the smaller area."""
    m = _docs(spark, d).withColumns({"reviewed": F.col("item_id") % 5 == 0, "box_area": F.pmod(F.col("item_id") * 7, F.lit(31))})
    groups = m.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return version.resolve_pairs(m.join(groups, "digest", "left_semi"))


SQL["resolve_duplicates"] = f"""WITH {_DOCS}, m AS (SELECT *, item_id % 5 = 0 AS reviewed, item_id * 7 % 31 AS a FROM d QUALIFY count(*) OVER (PARTITION BY digest) > 1)
SELECT digest, item_id, first_value(item_id) OVER w AS keep_id, CASE WHEN row_number() OVER w = 1 THEN 'keep' ELSE 'drop' END AS action FROM m WINDOW w AS (PARTITION BY digest ORDER BY reviewed DESC, a, item_id)"""


@query
def postconditions(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the split of the documents: duplicates that remain, duplicates over splits."""
    g = dedup.exact_groups(_docs(spark, d))
    return g.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("cross_split").cast("long")), F.lit(0)).alias("cross_split_groups"))


SQL["postconditions"] = f"WITH {_GROUPS} SELECT count(*) AS duplicate_groups, coalesce(sum(cross_split::INT), 0)::BIGINT AS cross_split_groups FROM g"
