"""Removal spans against a dictionary of all windows."""

import hashlib
import random
import time

import numpy as np
import pytest
from llm.substring_dedup import parse, substring_dedup


def plain(rows, window):
    first = {}
    for doc, text in rows:
        w = (text or "").split()
        for i in range(len(w) - window + 1):
            if doc is not None:
                g = tuple(w[i : i + window])
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in rows:
        w, gone = (text or "").split(), set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def world(seed, window):
    rng = random.Random(seed)
    say = lambda n: " ".join(f"v{rng.randint(0, 400)}" for _ in range(n))
    passages = [say(rng.choice((window, window + 1, 3 * window))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [say(rng.randint(0, 2 * window))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), say(rng.randint(0, 9))]
        rows.append((rng.randint(0, 45), " ".join(parts)))
    loop = " ".join(["x y"] * 3 * window)
    return [*rows, rows[0], rows[0], (3, None), (4, ""), (None, rows[1][1]), (99, rows[1][1]), (50, loop), (51, loop), (52, say(2000)), (53, "é\t" + passages[0] + "\n")]


@pytest.mark.parametrize(("seed", "window", "anchor", "hot"), [(1, 12, 5, 5000), (2, 50, 20, 5000), (3, 7, 3, 5000), (4, 12, 5, 2), (5, 9, 2, 4)])
def test_matches_all_windows(spark, seed, window, anchor, hot):
    rows = world(seed, window)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, spans int, anchor int").repartition(3)
    got = substring_dedup(df, window, anchor, hot_blocks=hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, window)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_rows_and_copies_take_time_in_proportion(spark):
    text = " ".join(f"v{i}" for i in range(2000))
    for n in (500, 3000):
        rows = [(0, text), *[(1, text)] * n, *[(2 + i, text + f" end{i}") for i in range(200)]]
        began = time.time()
        got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("doc_id").agg({"n_removed": "sum"}).collect()
        took = time.time() - began
        assert {r[0]: r[1] for r in got} == {0: 0, 1: 2000 * n} | {2 + i: 2000 for i in range(200)}
        assert took < 60


def test_passages_in_many_surroundings(spark):
    """A passage longer than a minimiser but of few windows, in many unlike surroundings."""
    rng = random.Random(9)
    say = lambda n: " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(n))
    passage = say(14)
    rows = [(i, f"{say(10)} {passage} {say(10)}") for i in range(300)]
    for hot in (5000, 10):
        got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 12, 5, hot_blocks=hot).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == plain(rows, 12)


def test_factors_are_the_longest_and_go_on_at_their_boundary():
    words = np.array([1, 2, 3, 4, 5, 9, 9, 1, 2, 3, 4, 8, 2, 3, 4, 5])  # reference 0:7, block 7:16
    key = lambda i: hash(tuple(words[i : i + 3].tolist()))
    index = {key(i): (i, 7) for i in range(5)}
    assert parse(words, 7, 16, [key(i) for i in range(7, 14)], index, 3) == [(0, 1), (5, 6)]
