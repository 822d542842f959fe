"""Toxicity: smoothing against a plain version, held-out accuracy, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm import toxicity

D = 0.75


def plain_ratio(rows):
    """P(letter | context, class) by the recursion itself; rows are (label, word, n)."""
    full = [Counter(), Counter()]
    for y, w, n in rows:
        s = "^^^" + w + "$"
        for i in range(len(w) + 1):
            full[y][s[i : i + 4]] += n
    orders = {}
    now = set(full[0]) | set(full[1])
    for k in (3, 2, 1):
        orders[k] = Counter(g[1:] for g in now)
        now = set(orders[k])

    def shared(g):
        c = orders[len(g)]
        same = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        below = shared(g[1:]) if len(g) > 1 else 1 / (len(same) + 1)
        return max(c[g] - D, 0) / sum(same.values()) + D * len(same) / sum(same.values()) * below

    def p(g, y):
        same = {x: n for x, n in full[y].items() if x[:-1] == g[:-1]}
        if not same:
            return shared(g[1:])
        return max(full[y][g] - D, 0) / sum(same.values()) + D * len(same) / sum(same.values()) * shared(g[1:])

    return {g: math.log(p(g, 1) / p(g, 0)) for g in set(full[0]) | set(full[1])}


def test_ratios_match_the_recursion(spark):
    rows = [(1, "idiot", 5), (1, "the", 9), (0, "the", 30), (0, "house", 4), (0, "ideal", 3), (1, "ideal", 1), (0, "été", 2)]
    frame = spark.createDataFrame([(1 + i % 4, y, " ".join([w] * n)) for i, (y, w, n) in enumerate(rows)], "fold int, label int, text string")
    found = toxicity.log_ratios(toxicity.gram_counts(frame)).where("without = 0").collect()
    got = {r["key"]: r["ratio"] for r in found}
    want = plain_ratio(rows)
    assert {k for k in got if len(k) == 4} == set(want)
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    for fold in (1, 2):
        left = plain_ratio([r for i, r in enumerate(rows) if 1 + i % 4 != fold])
        got = {r["key"]: r["ratio"] for r in toxicity.log_ratios(toxicity.gram_counts(frame)).where(f"without = {fold}").collect()}
        assert all(abs(got[k] - v) < 1e-9 for k, v in left.items())


def test_probabilities_sum_to_one(spark):
    frame = spark.createDataFrame([(1, 1, "idiot idiotic the"), (1, 0, "the then there idea ideal"), (2, 0, "été")], "fold int, label int, text string")
    shared = toxicity.shared_probabilities(toxicity.gram_counts(frame).where("without = 0"), D).collect()
    letters = {r["gram"][-1] for r in shared}
    total = Counter()
    for r in shared:
        total[r["gram"][:-1]] += r["p"]
    assert letters and all(t <= 1 + 1e-9 for t in total.values())


@pytest.mark.parametrize("seed", range(5))
def test_cut_is_the_best_one(seed):
    r = np.random.default_rng(seed)
    e, y = r.integers(0, 8, 60) / 4, r.integers(0, 2, 60)
    cut = toxicity.best_cut(e, y)
    right = lambda c: ((e >= c) == (y == 1)).sum()
    assert right(cut) == max(right(c) for c in [*np.unique(e), 1e9, 1e-9])


def invented(n, seed):
    r = random.Random(seed)
    good = ["river", "stone", "walking", "morning", "letter", "garden", "window", "people", "nation", "answer"]
    bad = ["grobnik", "grobber", "vilest", "vilely"]
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.25
        w = [r.choice(good) for _ in range(r.randint(30, 120))]
        if toxic:
            for _ in range(r.randint(3, 6)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = invented(500, 3)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = toxicity.classify(frame, toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    truth = dict(labels)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    stems = spark.createDataFrame([(1, "the grobnikest river people vilestly grobbers")], "doc_id long, text string")
    assert toxicity.classify(stems, toxicity.fit(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))).first()["predicted"] == 1


def test_held_out_labels_teach_nothing(spark):
    docs, labels = invented(200, 4)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = []
    for flip in (0, 1):
        turned = [(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
        model = toxicity.fit(frame, spark.createDataFrame(turned, "doc_id long, toxic int"))
        out.append({r["doc_id"]: r["score"] for r in toxicity.classify(frame, model).collect()})
    assert out[0] == out[1]


def test_odd_rows(spark):
    docs, labels = invented(120, 5)
    docs += [(None, "vilest grobnik"), (None, None), (500, ""), (501, "--- ..."), (502, "river " * 200_000), (503, "vilest " * 30_000), (3, docs[3][1]), (3, docs[3][1])]
    frame = spark.createDataFrame([(*d, "keep", 7.0) for d in docs], "doc_id long, text string, `a.b` string, score double")
    known = spark.createDataFrame([*labels, (None, 1), (500, None), (1, 1), (1, 0), (9999, 1)], "doc_id long, toxic int")
    out = toxicity.classify(frame, toxicity.fit(frame, known))
    assert set(out.columns) == {"doc_id", "text", "a.b", "score", "predicted"}
    rows = out.collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if not (r["text"] or "").strip("-. ")} == {0.0}
    assert {r["predicted"] for r in rows if r["doc_id"] in (503,) or (r["doc_id"] is None and r["text"])} == {1}
    assert {r["predicted"] for r in rows if r["doc_id"] == 502} == {0}
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(1, 1), (2, 1), (3, 1), (4, 1)], 1.0), ([(1, 0), (2, 0), (3, 0), (4, 0)], 0.0)])
def test_without_two_classes(spark, labels, score):
    docs = spark.createDataFrame([(i, "some text") for i in range(6)], "doc_id long, text string")
    out = toxicity.classify(docs, toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()
    assert [r["score"] for r in out] == [score] * 6
    assert toxicity.classify(docs.limit(0), toxicity.fit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int"))).count() == 0


def test_sample_bound_takes_whole_texts(spark):
    docs, labels = invented(60, 6)
    rows = toxicity.training_rows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), 20_000, 5_000).collect()
    whole = {t for _, t in docs}
    assert rows and sum(len(r["text"]) for r in rows) <= 5_000 and all(r["text"] in whole for r in rows)


def test_query_on_the_tables(spark):
    import os

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    out = {r["doc_id"]: r for r in toxicity.op11_toxicity(spark, sf).collect()}
    known = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [(out[r["doc_id"]]["predicted"], r["toxic"]) for r in known if out[r["doc_id"]]["held_out"]]
    assert sum(p == t for p, t in held) / len(held) > 0.9
