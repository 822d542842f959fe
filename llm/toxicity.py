"""Toxicity: class-conditional Kneser-Ney models of how words are spelled.

An expression is a word; its likelihood under a class is the product of its
letters' probabilities given the three letters before them (edges count as
letters).  The highest order is counted for each class by itself.  All lower
orders are shared: Kneser-Ney continuation counts over both classes together, so
that a rare expression, unseen in one class, falls back to the same
probabilities in both, and its ratio to the ratio of the two backoff weights.
Stems are caught as well as words, in any language, without word lists.

The evidence of a word is log P(word | toxic) - log P(word | ordinary).  Only
what exceeds `margin` nats counts, up to `ceiling`: small ratios, spread over
all words of a text, tell its language and subject rather than its tone, and one
odd word shouldn't convict a text.  The evidence of a text is the mean over its words, so length
cancels.  The cut between the classes is the one with most right decisions on
the training rows, each judged by models that never saw its fold (crc32 of the
id, 1 to 4); the score is e^2 / (e^2 + cut^2), 0.5 at the cut.

Words and letter runs are counted by Spark, and the smoothing is joins and
windows over the count tables.  `max_train_rows` labels (smallest hashes of
doc_id first) and `max_train_chars` letters of their texts bound the sample, and
so the table of ratios that all tasks hold; a text is used whole or not at all.
Scoring is a pass over the scan without a shuffle.

Edge cases: null and empty texts and texts without words have no evidence, score
0; without labels of both kinds the score is the share of label 1 (0 without
labels); null labels or ids don't teach; a null doc_id is scored and not held
out; repeated rows are scored each, and equal ids with unlike labels teach each;
texts of any length are scored whole.  Extra columns are kept; score and
predicted replace columns of these names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import saved, slices, table

WORD = re.compile(r"[^\W_]+")
ORDER = 4
EDGE, END = "^", "$"  # no word holds them


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Evidence(dict):
    """word -> evidence in nats, from 0 to `ceiling`; worked out once for a word."""

    def __init__(self, ratios: dict[str, float], margin: float, ceiling: float, remembered: int = 1 << 18):
        self.ratios, self.margin, self.ceiling, self.remembered = ratios, margin, ceiling, remembered

    def __missing__(self, word: str) -> float:
        padded, ratio = EDGE * (ORDER - 1) + word + END, self.ratios.get
        total = 0.0
        for i in range(len(word) + 1):
            gram = padded[i : i + ORDER]
            found = ratio(gram)
            total += ratio(gram[:-1], 0.0) if found is None else found
        out = min(max(total - self.margin, 0.0), self.ceiling)
        if len(self) < self.remembered and len(word) <= 64:
            self[word] = out
        return out

    def of(self, text: str | None) -> float:
        words = words_of(text)
        return sum(map(self.__getitem__, words)) / len(words) if words else 0.0


@dataclass
class Toxicity:
    """Ratios of the letter runs, the cut, or (without two classes) one score for all."""

    ratios: dict[str, float] = field(default_factory=dict)
    cut: float = 1.0
    margin: float = 1.5
    ceiling: float = 4.0
    constant: float | None = None


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fold, label, word, n of each text of rows (fold, label, text)."""
    for b in slices(batches):
        fold, label, text = (c.to_pylist() for c in b.columns)
        for f, y, t in zip(fold, label, text, strict=True):
            n = Counter(words_of(t))
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([f] * k, pa.int32()), pa.array([y] * k, pa.int32()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["fold", "label", "word", "n"])


def training_rows(docs: DataFrame, labels: DataFrame, max_train_rows: int, max_train_chars: int) -> DataFrame:
    """fold, label and text of the labelled rows that teach."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("label"))
    known = known.where("id IS NOT NULL AND label IN (0, 1)").withColumns({"fold": F.crc32(F.col("id").cast("string")) % 5, "h": F.xxhash64("id")}).where("fold <> 0")
    taught = known.orderBy("h", "id", "label").limit(max_train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = saved(texts.join(F.broadcast(taught), "id").select(F.col("fold").cast("int").alias("fold"), "label", "h", "text"), "toxicity-rows")  # max_train_rows labels at most
    sizes = sorted((r["h"], r["chars"]) for r in rows.groupBy("h").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars")).collect())  # an id at most for each label
    total = np.cumsum([c for _, c in sizes])
    fits = int(np.searchsorted(total, max_train_chars, side="right"))
    if fits < len(sizes):
        rows = rows.where(F.col("h") < sizes[fits][0])
    return rows.select("fold", "label", "text")


def gram_counts(rows: DataFrame) -> DataFrame:
    """without, gram, toxic, ordinary: counts of letter runs over all folds but `without` (0: over all)."""
    words = rows.mapInArrow(count_words, "fold int, label int, word string, n long").groupBy("fold", "label", "word").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit(EDGE * (ORDER - 1)), "word", F.lit(END))
    runs = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))
    grams = words.select("fold", "label", F.explode(runs).alias("gram"), "n").groupBy("fold", "label", "gram").agg(F.sum("n").alias("n"))
    others = F.filter(F.array(*(F.lit(i) for i in range(5))), lambda i: i != F.col("fold"))
    count = lambda y: F.coalesce(F.sum(F.when(F.col("label") == y, F.col("n"))), F.lit(0))
    return grams.select(F.explode(others).alias("without"), "gram", "label", "n").groupBy("without", "gram").agg(count(1).alias("toxic"), count(0).alias("ordinary"))


def tail(gram: Column | str) -> Column:
    return F.expr(f"substring({gram}, 2)")


def head(gram: str) -> Column:
    return F.expr(f"left({gram}, length({gram}) - 1)")


def shared_probabilities(grams: DataFrame, discount: float) -> DataFrame:
    """without, gram (a letter shorter), p: Kneser-Ney over both classes, from continuation counts at every order."""
    orders, now = [], grams
    for _ in range(ORDER - 1):
        now = now.select("without", tail("gram").alias("gram")).groupBy("without", "gram").agg(F.count(F.lit(1)).alias("n"))
        orders.append(now)
    lower = None
    for counts in reversed(orders):
        context = Window.partitionBy("without", head("gram"))
        own = counts.select("*", F.sum("n").over(context).alias("total"), F.count(F.lit(1)).over(context).alias("kinds"))
        if lower is None:  # single letters: the rest goes to all letters alike, and one unknown
            below = own.withColumn("below", 1 / (F.col("kinds") + 1))
        else:
            below = own.withColumn("rest", tail("gram")).join(lower.select("without", F.col("gram").alias("rest"), F.col("p").alias("below")), ["without", "rest"])
        p = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total") + discount * F.col("kinds") / F.col("total") * F.col("below")
        lower = below.select("without", "gram", p.alias("p"))
    return lower


def log_ratios(grams: DataFrame, discount: float = 0.75) -> DataFrame:
    """without, key, ratio: log P(last letter | toxic) - log P(last letter | ordinary) of letter runs, and the ratio of backoff weights of their contexts."""
    shared = shared_probabilities(grams, discount).select("without", F.col("gram").alias("rest"), "p")
    context = Window.partitionBy("without", "context")
    rows = grams.select("*", tail("gram").alias("rest"), head("gram").alias("context")).join(shared, ["without", "rest"])
    for c in ("toxic", "ordinary"):
        total, kinds = F.sum(c).over(context), F.count_if(F.col(c) > 0).over(context)
        weight = F.when(total > 0, discount * kinds / total).otherwise(1.0)
        seen = F.when(total > 0, F.greatest(F.col(c) - discount, F.lit(0.0)) / total).otherwise(0.0)
        rows = rows.withColumns({f"w_{c}": weight, f"p_{c}": seen + weight * F.col("p")})
    own = rows.select("without", F.col("gram").alias("key"), F.log(F.col("p_toxic") / F.col("p_ordinary")).alias("ratio"))
    back = rows.groupBy("without", F.col("context").alias("key")).agg(F.log(F.first("w_toxic") / F.first("w_ordinary")).alias("ratio"))
    return own.unionByName(back)


def best_cut(evidence: np.ndarray, label: np.ndarray) -> float:
    """The bound with most right decisions, between two values that occur."""
    order = np.argsort(evidence, kind="stable")
    e, y = evidence[order], label[order]
    below = np.concatenate([[0], np.cumsum(y == 0)])
    above = np.concatenate([np.cumsum((y == 1)[::-1])[::-1], [0]])
    right = below + above
    right[1:-1][e[1:] == e[:-1]] = -1
    k = int(right.argmax())
    low, high = (e[k - 1] if k else 0.0), (e[k] if k < len(e) else 2 * e[-1] + 1e-6)
    return max((low + high) / 2, 1e-9)


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, max_train_chars: int = 64_000_000, margin: float = 1.5, ceiling: float = 4.0) -> Toxicity:
    """Learn from rows of docs(doc_id, text) that labels(doc_id, toxic) names and that aren't held out."""
    rows = training_rows(docs, labels, max_train_rows, max_train_chars)
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return Toxicity(constant=float(next(iter(seen), 0)))
    ratios = saved(log_ratios(saved(gram_counts(rows), "toxicity-grams")), "toxicity-ratios").toPandas()  # bounded by max_train_chars
    by_fold = {int(k): dict(zip(g["key"], g["ratio"], strict=True)) for k, g in ratios.groupby("without")}
    sent = rows.sparkSession.sparkContext.broadcast(by_fold)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {k: Evidence(r, margin, ceiling) for k, r in sent.value.items()}
        for b in slices(batches):
            fold, label, text = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array([models[f].of(t) if f in models else 0.0 for f, t in zip(fold, text, strict=True)], pa.float64()), pa.array(label, pa.int32())], names=["evidence", "label"])

    known = rows.mapInArrow(judged, "evidence double, label int").toPandas()
    return Toxicity(by_fold[0], best_cut(known["evidence"].to_numpy(), known["label"].to_numpy()), margin, ceiling)


def classify(docs: DataFrame, model: Toxicity, threshold: float = 0.5) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold), which replace columns of these names."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    if model.constant is not None:
        score = F.lit(model.constant)
    else:
        sent = docs.sparkSession.sparkContext.broadcast(model)

        @F.pandas_udf("double")
        def evidence(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            m = sent.value
            known = Evidence(m.ratios, m.margin, m.ceiling)
            for some in texts:
                yield some.map(known.of).astype("float64")

        e = F.coalesce(evidence(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(0.0))
        score = e * e / (e * e + model.cut**2)
    return docs.select(*kept, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
