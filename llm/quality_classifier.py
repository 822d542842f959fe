"""Quality classifier: a sparse rule ensemble compiled into column expressions.

Statistics of a text are native column expressions.  A random forest is grown
on a bounded sample of labelled rows; every path from a root to a node is a
conjunctive rule over the statistics.  A logistic regression with a lasso
penalty weighs the rules, most of them by nothing, and what is left is one
Spark column expression: the sigmoid of a sum of CASE terms.  Scoring is a
projection of the scan.

Only rows with crc32(doc_id as text) mod 5 <> 0 teach; labels, lang, source and
doc_id are no inputs.  ``max_train_rows`` bounds the sample (smallest hashes of
doc_id first).  Edge cases: a null or empty text has the statistics of an empty
one; without labels of both kinds the score is the share of label 1 (0.5 with no
label); null labels or ids don't teach; a null doc_id is scored and not held
out; repeated rows are scored each, equal ids with unlike labels teach each; a
text of any length is scored whole; ties between scores do not matter.  Extra
columns are kept; score and predicted replace columns of these names in classify.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import let, saved, table
from llm.quality_rules import words

#: a rule is a tuple of (statistic, whether it is greater, threshold)
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text; none of them looks at anything but the text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    w = let(words(text), lambda x: F.struct(F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("d"), F.length(F.array_join(x, "")).cast("double").alias("c")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0), lambda x: F.struct(F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("d")))
    return {"w": w, "l": lines, "symbols": count(r"[#*$%&|<>]"), "upper": count(r"[A-Z]"), "digits": count(r"[0-9]"), "marks": count(r"[!?]"), "stops": count(r"[.,;:]")}


def with_statistics(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs(text, ...) with one struct column __s of statistics, and the names of its fields."""
    raw = docs.withColumn("__raw", F.struct(*(c.alias(k) for k, c in statistics(F.col("text")).items())))
    r = F.col("__raw")
    n, chars, lines = F.greatest(r["w"]["n"], F.lit(1.0)), F.greatest(r["w"]["c"], F.lit(1.0)), F.greatest(r["l"]["n"], F.lit(1.0))
    stats = {
        "log_words": F.log1p(r["w"]["n"]), "word_length": r["w"]["c"] / n, "distinct_words": r["w"]["d"] / n, "distinct_log": F.log1p(r["w"]["d"]) / F.greatest(F.log1p(r["w"]["n"]), F.lit(1e-9)), "symbols_per_word": r["symbols"] / n,
        "upper_share": r["upper"] / chars, "digit_share": r["digits"] / chars, "marks_per_word": r["marks"] / n, "stops_per_word": r["stops"] / n,
        "distinct_lines": r["l"]["d"] / lines, "words_per_line": r["w"]["n"] / lines,
    }
    return raw.withColumn("__s", F.struct(*(c.alias(k) for k, c in stats.items()))).drop("__raw"), list(stats)


def tree_rules(node, names: list[str], path: Rule = ()) -> list[Rule]:
    """The conjunction at every node below a root of a Spark tree."""
    out = [path] if path else []
    if node.numDescendants():
        split = node.split()
        name, cut = names[split.featureIndex()], split.threshold()
        out += tree_rules(node.leftChild(), names, (*path, (name, False, cut))) + tree_rules(node.rightChild(), names, (*path, (name, True, cut)))
    return out


def simplified(rule: Rule) -> Rule:
    """One bound of each kind for a statistic, the tightest, in a fixed order."""
    best: dict[tuple[str, bool], float] = {}
    for name, greater, cut in rule:
        now = best.get((name, greater), cut)
        best[name, greater] = max(now, cut) if greater else min(now, cut)
    return tuple((name, greater, cut) for (name, greater), cut in sorted(best.items()))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, greater, cut in rule:
        value = F.col("__s")[name]
        out = out & (value > cut if greater else value <= cut)
    return out


class RuleEnsemble:
    """Intercept and weighted rules."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        """Probability of label 1 as an expression over the struct __s."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = 20_000, trees: int = 12, depth: int = 3, lasso: float = 0.002, seed: int = 11) -> RuleEnsemble:
    """Learn from rows of docs(doc_id, text) that labels(doc_id, quality) names and that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("double").alias("label")).where("id IS NOT NULL AND label IN (0.0, 1.0) AND crc32(CAST(CAST(id AS STRING) AS BINARY)) % 5 <> 0")
    taught = known.orderBy(F.xxhash64("id"), "id", "label").limit(max_train_rows)
    rows, names = with_statistics(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(taught), "id"))  # max_train_rows ids and labels at most
    rows = saved(rows.select("label", "__s"), "rules").select("label", "__s.*")  # at most max_train_rows narrow rows
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = next(iter(counts), 0.5)
        return RuleEnsemble({0.0: -20.0, 1.0: 20.0, 0.5: 0.0}[share], [])
    rows = rows.coalesce(1).sortWithinPartitions(*names, "label")  # one order, whatever the layout of the files
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64, subsamplingRate=1.0).fit(vectors)
    found = [simplified(x) for t in forest.trees for x in tree_rules(t._call_java("rootNode"), names)]
    rules = list(dict.fromkeys(found))
    hot = rows.select("label", F.struct(*names).alias("__s")).select("label", *(holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    hot = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(hot).select("label", "features").cache()
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(hot)
    hot.unpersist()
    return RuleEnsemble(model.intercept, [(r, w) for r, w in zip(rules, model.coefficients.toArray().tolist(), strict=True) if abs(w) > 1e-6])


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """row (a struct of all columns of docs) and its score: names of docs can't clash with those used inside."""
    rows, _ = with_statistics(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").alias("text")))
    return rows.select("row", model.score().alias("score"))


def classify(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold), which replace columns of these names."""
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("score", "predicted")]
    return scored(docs, model).select(*kept, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleEnsemble, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns."""
    return scored(docs, model).where(F.col("score") >= threshold).select("row.*")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
