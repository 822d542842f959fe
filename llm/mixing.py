"""Mixing of sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a and normalised:
w = p^a / sum p^a.  Bisection finds the exponent at which the entropy of w
reaches ``target_entropy`` (a share of the largest possible), or the largest
flattening at which no source is repeated more than ``max_repeats`` times,
whichever flattens less.  Both only need sums over the sources and the smallest
source, so the sources stay a table, however many there are; one aggregate
serves several steps of the bisection.  Weights become token budgets.

A budget is realised by permuted blocks: a document belongs to a block of its
source by hash, blocks of about ``block_tokens`` tokens are taken in the order
of a hash until the budget is spent, whole passes first, and in the one block
that the budget cuts the documents are taken in the order of theirs.  What a
source draws beyond whole passes is thus a prefix of one order, and one limit
per source tells each row how often it is drawn: the texts are never shuffled.
Limits come from block sums, over ranges of the order first and inside one range
then, so no source is ever sorted in one task, whatever its share.

Edge cases: a null or wordless text has no tokens and is never drawn; a null
source is a source; a null doc_id is drawn like any other; without tokens the
result is empty; rows with equal doc_id, source and text are drawn together;
ties between hashes go by block and text; a text of any length is one document,
so a budget is missed by less than one document (or its equal rows); a table of
one source has weight 1.  mix_documents keeps all columns of its input; those
named n_tokens, epoch, block or mix_order are replaced by its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import saved, table

RESULT = ("n_tokens", "epoch", "block", "mix_order")
Moments = Callable[[list[float]], list[tuple[float, float]]]


def entropy(a: float, z: float, d: float) -> float:
    """Entropy of p^a / z, where z = sum p^a and d = sum p^a log p."""
    return math.log(z) - a * d / z


def solve_exponent(moments: Moments, sources: int, least: float, target_entropy: float, max_repeats: float, budget_share: float, rounds: int = 6, steps: int = 5) -> float:
    """Smallest exponent in [0, 1] that keeps the entropy at or below its target and repetition at or below its limit; 1 if there is none.

    moments gives (z, d) for exponents, least is the smallest share; a round makes some steps of the bisection with one call.
    """
    limit = target_entropy * math.log(sources)

    def flat_enough(a: float, z: float, d: float) -> bool:
        return entropy(a, z, d) <= limit + 1e-12 and least ** (a - 1) / z * budget_share <= max_repeats

    if flat_enough(0.0, *moments([0.0])[0]):
        return 0.0
    low, high, parts = 0.0, 1.0, 2**steps
    for _ in range(rounds):
        grid = [low + (high - low) * i / parts for i in range(1, parts)]
        good = [a for a, m in zip(grid, moments(grid), strict=True) if flat_enough(a, *m)]
        width = (high - low) / parts
        high = good[0] if good else high
        low = high - width
    return math.ceil(high * 1e9) / 1e9


def counted(docs: DataFrame, seed: int) -> DataFrame:
    """row (all columns of docs), source, n_tokens and two hashes h, t; rows without tokens go."""
    key = F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")), F.coalesce(F.col("source").cast("string"), F.lit("\x00")))
    n = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("row"), F.col("source"), n.alias("n_tokens"), F.xxhash64(key).alias("h"), F.xxhash64("text").alias("t")).where("n_tokens > 0")


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def planned(narrow: DataFrame, budget_share: float, target_entropy: float, max_repeats: float, block_tokens: int) -> DataFrame:
    """source_of, n_blocks, passes and cut (tokens beyond whole passes): one row per source of narrow(source, n_tokens)."""
    totals = saved(narrow.groupBy(F.col("source").alias("source_of")).agg(F.sum("n_tokens").alias("have")), "sources")
    sources, tokens, least = totals.agg(F.count("*"), F.sum("have"), F.min("have")).first()
    p = F.col("have") / float(tokens or 1)

    def moments(exponents: list[float]) -> list[tuple[float, float]]:
        power = [F.pow(p, F.lit(a)) for a in exponents]
        got = totals.agg(*map(F.sum, power), *(F.sum(x * F.log(p)) for x in power)).first()
        return list(zip(got[: len(power)], got[len(power) :], strict=True))

    a, z = 1.0, 1.0
    if sources:
        a = solve_exponent(moments, sources, least / tokens, target_entropy, max_repeats, budget_share)
        z = float(f"{moments([a])[0][0]:.12g}")  # the order of summation leaves no trace
    want = F.round(F.pow(p, F.lit(a)) / z * (budget_share * (tokens or 0))).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("have") / block_tokens)).cast("long")
    return totals.withColumn("want", want).select("source_of", blocks.alias("n_blocks"), F.expr("want div have").alias("passes"), F.expr("want % have").alias("cut"))


def placed(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows with their plan, block and o, the place of the block; whether the plan is broadcast is decided by its size."""
    block = F.pmod("h", "n_blocks")
    return rows.join(plan, same("source", "source_of")).drop("source_of").withColumn("block", block).withColumn("o", F.xxhash64(F.lit(seed), "source", "block"))


def limits(narrow: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The plan with the last place (o, block, h, t) that a source draws once more than its passes; null where it draws none."""
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy("source", *by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = placed(narrow, plan, seed).groupBy("source", "block", "o", "cut").agg(F.sum("n_tokens").alias("b_tokens")).withColumn("part", F.shiftright("o", 54))
    parts = sums.groupBy("source", "part").agg(F.sum("b_tokens").alias("u"))
    parts = parts.select(F.col("source").alias("s2"), F.col("part").alias("k2"), before("u", ["part"]).alias("base"))
    spots = sums.withColumn("inside", before("b_tokens", "part", ["o", "block"])).join(parts, same("source", "s2") & (F.col("part") == F.col("k2")))
    spots = spots.withColumn("room", F.col("cut") - F.col("base") - F.col("inside")).where("room > 0")
    spots = saved(spots.select("source", "o", "block", "room", "b_tokens"), "spots")
    full = spots.where("room >= b_tokens").groupBy(F.col("source").alias("s3")).agg(F.max(F.struct("o", "block")).alias("x"))
    full = full.select("s3", F.struct("x.o", "x.block", F.lit((1 << 63) - 1).alias("h"), F.lit((1 << 63) - 1).alias("t")).alias("upto"))
    edge = spots.where("room < b_tokens").select(F.col("source").alias("s4"), F.col("block").alias("k4"), "room")  # one block per source at most
    inner = placed(narrow, plan, seed).join(edge, same("source", "s4") & (F.col("block") == F.col("k4")))
    inner = inner.groupBy("source", "o", "block", "h", "t", "room").agg(F.sum("n_tokens").alias("n"))
    spent = F.sum("n").over(Window.partitionBy("source").orderBy("h", "t").rowsBetween(Window.unboundedPreceding, 0))  # documents of one block
    inner = inner.withColumn("spent", spent).where("spent <= room").groupBy(F.col("source").alias("s3")).agg(F.max(F.struct("o", "block", "h", "t")).alias("upto"))
    upto = full.unionByName(inner).groupBy("s3").agg(F.max("upto").alias("upto"))
    return plan.join(upto, same("source_of", "s3"), "left").drop("s3")


DEFAULTS = {"budget_share": 1.0, "target_entropy": 0.98, "max_repeats": 4.0, "block_tokens": 200_000, "seed": 17}


def draw(rows: DataFrame, narrow: DataFrame, budget_share: float, target_entropy: float, max_repeats: float, block_tokens: int, seed: int) -> DataFrame:
    """rows once for each time the mixture draws them; narrow has their source, n_tokens and hashes."""
    plan = saved(planned(narrow, budget_share, target_entropy, max_repeats, block_tokens), "plan")
    drawn = placed(rows, saved(limits(narrow, plan, seed), "limits"), seed)
    copies = F.col("passes") + F.coalesce(F.struct("o", "block", "h", "t") <= F.col("upto"), F.lit(False)).cast("long")
    drawn = drawn.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return drawn.withColumn("mix_order", F.xxhash64(F.lit(seed), "epoch", "h", "t"))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """Rows of docs(doc_id, text, source, ...) with n_tokens, epoch (0, 1, ...), block and mix_order: a hash to sort the mixture by."""
    settings = DEFAULTS | settings
    rows = counted(docs, settings["seed"])
    narrow = saved(rows.select("source", "n_tokens", "h", "t"), "mix")
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    return draw(rows, narrow, **settings).select(*(F.col("row")[c].alias(c) for c in kept), *RESULT)


def mix_ids(docs: DataFrame, **settings) -> DataFrame:
    """The same draw without the texts: doc_id, source and the columns that mix_documents adds."""
    settings = DEFAULTS | settings
    narrow = saved(counted(docs.select("doc_id", "source", "text"), settings["seed"]).select(F.col("row.doc_id").alias("doc_id"), "source", "n_tokens", "h", "t"), "mix")
    return draw(narrow, narrow, **settings).select("doc_id", "source", *RESULT)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_ids(table(spark, sf_dir, "documents"))
