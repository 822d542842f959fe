"""Components against all pairs; the search against all pairs of sets."""

import random

import numpy as np
import pytest
from llm import jaccard_join as jj


def sets_of(rows):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().decode().split() if (text or "").isascii() else (text or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain(rows):
    s, up = sets_of(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(s[i]), least.get(root(i)) if s[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def world(seed):
    rng = random.Random(seed)
    say = lambda n: [f"v{rng.randint(0, 60)}" for _ in range(n)]
    rows, doc = [], 0
    common = say(30)
    for _ in range(12):
        base = say(rng.choice((1, 3, 4, 5, 6, 12, 40, 90)))
        if rng.random() < 0.4:
            base = base + common
        for _ in range(rng.choice((1, 2, 9, 25))):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"u{rng.randint(0, 999)}"
            rows.append((doc, " ".join(w).upper() if rng.random() < 0.3 else "  ".join(w)))
            doc += 1
    rng.shuffle(rows)
    return [*rows, rows[0], (rows[1][0], rows[2][1]), (None, rows[0][1]), (None, "lonely words stand here in a row"), (None, None), (doc, None), (doc + 1, ""), (doc + 2, " \n")]


@pytest.mark.parametrize(("seed", "family"), [(1, 512), (2, 512), (3, 4), (4, 4)])
def test_components(spark, seed, family):
    rows = world(seed)
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, node int, n int").repartition(3)
    got = jj.jaccard_components(df, family_rows=family, group_words=200).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)


def test_star_of_unlike_rays(spark):
    """Rays that are alike only by way of the centre: every one of them is found in a hot family."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = [(500, " ".join(base))]
    for i in range(30):
        w = list(base)
        for k in rng.sample(range(0, 100, 6), 3):
            w[k] = f"r{i}_{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jj.jaccard_components(df, family_rows=5).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("seed", range(6))
def test_divide_skip(seed):
    rng = random.Random(seed)
    base = list(range(40))
    sets = [sorted({*rng.sample(base, rng.randint(30, 40)), *(rng.randint(100, 130) for _ in range(rng.randint(0, 6)))}) for _ in range(25)]
    links = jj.divide_skip([len(s) for s in sets], [np.array(s) for s in sets], [True] * 25, [True] * 25, [False] * 25, 80)
    rows = [set(s) for s in sets]

    def groups(pairs):
        up = list(range(25))
        for a, b in pairs:
            a, b = jj._root(up, a), jj._root(up, b)
            up[a] = b
        return {frozenset(i for i in range(25) if jj._root(up, i) == jj._root(up, j)) for j in range(25)}

    like = [(i, j) for i in range(25) for j in range(i) if 100 * len(rows[i] & rows[j]) >= 80 * len(rows[i] | rows[j])]
    assert all(100 * len(rows[i] & rows[j]) >= 80 * len(rows[i] | rows[j]) for i, j in links)
    assert groups(links) == groups(like)


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "x y"), (3, "x y"), (4, None), (5, None), (6, "other words"), (None, "q r s")]
    out = jj.one_of_each(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, __n int")).collect()
    assert sorted((str(r.doc_id), r.text) for r in out if r.text) == [("1", "a b c d e f"), ("3", "x y"), ("6", "other words"), ("None", "q r s")]
    assert sum(r.text is None for r in out) == 2


def test_empty(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
