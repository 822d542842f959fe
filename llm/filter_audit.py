"""Filter interaction audit: what each order of five filters removes, and what a filter is worth.

The word pipeline is relational: texts are dealt by their key, exploded into
words, aggregated by (document, word) and then by document for totals and
distinct words; the partitioning of the first step serves both aggregations, so
the words themselves never move.  The other flags come from a second, narrow
branch and are joined from outside.  A document then is a set of failed filters,
one of 32; one aggregation counts the sets for every part as 32 conditional
counts (and 32 each for labels of quality and toxicity), and all 120 orders are
sums of those counts: no order reads a document again.

Equal texts are found by digest.  A digest that many rows share is dealt over
``salts`` tasks: a row knows its digest and a salt of its id, minima are taken
for (digest, salt), then for the digest, and go back to the salts that exist.

Edge cases: a null text is an empty one, without words, and empty texts are
equal to each other; a null part and an empty one are one part; a null doc_id is
smaller than none and has no smaller one, so it passes E and fails nobody;
repeated rows (equal doc_id and text) count as rows, and none of them fails E
because of another; rows of one doc_id and unlike texts are told apart; a
document has a label if any of its label rows says so; labels that are null or
name no document count nowhere; an empty table gives no rows; other columns of
docs are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import table

FILTERS = "ABCDE"
GAP = r"[\x20\x09-\x0D]+"


def word_totals(docs: DataFrame) -> DataFrame:
    """k1, k2, n_words, n_distinct for each key of docs(k1, k2, text); equal rows are one key.

    A null beside the words of every row counts the rows of a key.
    """
    dealt = docs.select("k1", "k2", "text").repartition("k1", "k2")
    words = dealt.select("k1", "k2", F.explode(F.concat(F.split("text", GAP), F.array(F.lit(None).cast("string")))).alias("word"))
    counts = words.groupBy("k1", "k2", "word").agg(F.count(F.lit(1)).alias("n"))
    real = F.col("word") != ""
    return counts.groupBy("k1", "k2").agg(
        (F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)) / F.max(F.when(F.col("word").isNull(), F.col("n")))).cast("long").alias("n_words"),
        F.count_if(real).alias("n_distinct"),
    )


def with_copies(rows: DataFrame, salts: int = 64) -> DataFrame:
    """rows(doc_id, digest, ...) with `copied`: the digest also belongs to a smaller doc_id."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "k2"), F.lit(salts)))
    parts = salted.groupBy("digest", "salt").agg(F.min("doc_id").alias("least"))
    least = parts.groupBy("digest").agg(F.min("least").alias("least"), F.collect_list("salt").alias("salts"))  # salts entries at most
    back = least.select("digest", F.explode("salts").alias("salt"), "least")
    return salted.join(back, ["digest", "salt"]).select(*rows.columns, F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copied"))


def failures(docs: DataFrame, part: str = "lang", min_words: int = 200, distinct_share: int = 50, upper_share: int = 3) -> DataFrame:
    """doc_id, part and mask of every row of docs(doc_id, text, part): bit i says that filter i fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    keyed = rows.withColumns({"k1": F.coalesce("doc_id", F.lit(-(1 << 62))), "k2": F.xxhash64("text")})
    narrow = keyed.select(
        "doc_id", "part", "k1", "k2", F.unhex(F.sha2("text", 256)).alias("digest"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > upper_share * F.length("text")).alias("c"),
        F.col("text").rlike(r"[#$%&*|]").alias("d"),
    )
    flags = with_copies(narrow)
    words = word_totals(keyed)
    few = F.coalesce("n_words", F.lit(0)) < min_words
    dull = F.coalesce(100 * F.col("n_distinct") < distinct_share * F.col("n_words"), F.lit(False))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate([few, dull, F.col("c"), F.col("d"), F.col("copied")])), F.lit(0))
    return flags.join(words, ["k1", "k2"], "left").select("doc_id", "part", mask.alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows(doc_id, ...) with `good` and `toxic`: whether any label row of the document says 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    return rows.join(known, "doc_id", "left").select(*rows.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def set_counts(rows: DataFrame) -> DataFrame:
    """One row per part with the arrays n, good and toxic: 32 conditional counts each, by set of failed filters."""
    sets = range(1 << len(FILTERS))
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    wide = rows.groupBy("part").agg(*(F.count_if((F.col("mask") == m) & x).alias(f"{k}_{m}") for k, x in kinds.items() for m in sets))
    return wide.select("part", *(F.array(*(f"{k}_{m}" for m in sets)).alias(k) for k in kinds))


def orders() -> Column:
    """Array of (filter_order, step, bit, before) for 120 orders x 5 steps: the step's filter and the filters before it as bits."""
    out = [("".join(FILTERS[i] for i in p), s + 1, 1 << p[s], sum(1 << i for i in p[:s])) for p in itertools.permutations(range(len(FILTERS))) for s in range(len(FILTERS))]
    names = ("filter_order", "step", "bit", "before")
    return F.arrays_zip(*(F.lit(list(v)).alias(k) for k, v in zip(names, zip(*out, strict=True), strict=True)))


def audit(counts: DataFrame) -> DataFrame:
    """All orders over set_counts: sums of the 32 counts of a part."""
    sets = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    bit, before = F.col("bit"), F.col("before")

    def total(kind: str, keep) -> Column:
        chosen = F.transform(sets, lambda m: F.when(keep(m), F.get(F.col(kind), m)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, x: a + x)

    def meets(m: Column, with_: Column) -> Column:
        return m.bitwiseAND(with_) != 0

    rows = counts.select("*", F.explode(orders()).alias("o")).select("part", "n", "good", "toxic", "o.*").select(
        "part", "filter_order", "step", "bit",
        total("n", lambda m: ~meets(m, before.bitwiseOR(bit))).alias("kept"),
        total("n", lambda m: meets(m, bit) & ~meets(m, before)).alias("removed"),
        total("n", lambda m: meets(m, bit) & meets(m, before)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: meets(m, bit) & ~meets(m, before)).alias("good_lost"),
        total("toxic", lambda m: meets(m, bit) & ~meets(m, before)).alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")  # 120 rows each


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of docs(doc_id, text, part) with labels(doc_id, quality, toxic)."""
    return audit(set_counts(labelled(failures(docs, part), labels)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
e AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
y AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e
      FROM w JOIN e USING (text) LEFT JOIN y USING (doc_id)),
m AS (SELECT part, good, toxic, (a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT) AS mask, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
      FROM l v, l w, l x, l y, l z WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior FROM o, range(1, 6) AS r(step)),
g AS (SELECT part, filter_order, step::INT AS step, bit,
             coalesce(sum(n) FILTER (WHERE mask & (prior | bit) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & prior = 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & prior > 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
             coalesce(sum(n) FILTER (WHERE good AND mask & bit > 0 AND mask & prior = 0), 0)::BIGINT AS good_lost,
             coalesce(sum(n) FILTER (WHERE toxic AND mask & bit > 0 AND mask & prior = 0), 0)::BIGINT AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM g
"""
