"""Quality statistics against Python, the classifier on held-out labels."""

import math
import random
import zlib
from collections import Counter

from llm import quality_classifier as qc
from llm import quality_rules as qr

SF = "/root/testdata/sf0.01"


def base(text):
    w = [x.decode() for x in (text or "").encode().split()]  # bytes: ASCII spaces only
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if twice[g] > 1:
            hit.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_statistics(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("a b c dd é# <|>".split()) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [None, "", "  \n\n", "x\nx\n y\nx", "one two three four five " * 40, "w" * 5000, " a b"]
    rows = [(i % 30, t, rng.choice(["en", None]), rng.choice(["s", None]), 1) for i, t in enumerate(texts)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.quality_rules(df).collect()), key=str)
    assert got == sorted(((r[0], *base(r[1])) for r in rows), key=str)
    assert all(not r.kept for r in qr.quality_rules(df).collect() if r.base_failed)
    assert qr.quality_rules(df.where("false")).count() == 0


def test_thresholds_follow_the_group(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"word{rng.randint(0, 9**6)}" for _ in range(n))
    rows = [(i, say(40), "en", "a") for i in range(150)] + [(200 + i, say(40).replace(" ", " # ", 12), "en", "b") for i in range(150)]
    rows += [(900, say(40).replace(" ", " ### ", 30), "en", "a")]
    kept = {r.doc_id: r.kept for r in qr.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[900] and sum(kept.values()) == 300


def test_held_out_accuracy_and_rules(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = qc.fit(docs, labels)
    assert 0 < len(model.rules) < 200
    rows = qc.classify(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9


def test_edges(spark):
    text = "string"
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "a b", 0.5), (2, "", 0.5), (4, "x" * 50_000, 0.5)], f"doc_id long, text {text}, score double")
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    for labels in (one, one.where("false")):
        out = qc.classify(docs.drop("score"), qc.fit(docs, labels)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert qc.classify(docs.drop("score").where("false"), qc.fit(docs, one)).count() == 0


def test_compiled_rules_against_a_plain_evaluation(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.limit(400).select("doc_id", "text")
    model = qc.fit(docs, labels)
    stats = {r["doc_id"]: r["__s"].asDict() for r in qc.with_statistics(docs)[0].collect()}
    for r in qc.classify(docs, model).collect():
        z = model.intercept + sum(w for rule, w in model.rules if all((stats[r.doc_id][n] > cut) == greater for n, greater, cut in rule))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.3)


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * i, -5.0, "s", "r", 7) for i in range(20)], "doc_id long, text string, score double, __s string, row string, __raw int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model = qc.fit(docs, labels)
    assert all(tuple(r)[2:] == (-5.0, "s", "r", 7) for r in qc.accepted(docs, model, -1.0).collect()) and qc.accepted(docs, model, -1.0).columns == docs.columns
    assert {r["__raw"] for r in qc.classify(docs, model).collect()} == {7} and all(0 <= r.score <= 1 for r in qc.classify(docs, model).collect())


def test_fences_of_large_groups_are_close_in_rank(spark):
    """Groups beyond what a sketch holds exactly: the ranks of its quartiles are off by less than one percent."""
    rng = random.Random(8)
    values = [rng.random() ** 3 for _ in range(60_000)]
    stats = spark.createDataFrame([("en", "a", 10, v, 0.0, 0.0, 5.0) for v in values], "lang string, source string, n_words long, symbol_ratio double, dup_line_ratio double, repeat_ratio double, word_length double")
    row, n = qr.thresholds(stats, sketch_k=200).first(), len(values)
    values.sort()
    at = lambda q: values[int(q * n)]
    highest = at(0.76) + 3 * (at(0.76) - at(0.24)) + 0.25
    lowest = at(0.74) + 3 * (at(0.74) - at(0.26)) + 0.25
    assert lowest <= row.hi_symbol_ratio <= highest
