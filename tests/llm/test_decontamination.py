"""FM-index search against a plain search, in one and in several passes."""

import hashlib
import random

import numpy as np
import pytest
from llm import decontamination as dec


def plain(docs, bench, window=10):
    phrases = {}
    for item, text in bench:
        w = dec.words_of(text)
        for i in range(max(0, len(w) - window) + 1 if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, items = dec.words_of(text), set(), set()
        for p, ids in phrases.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    items |= ids
        names = ",".join(sorted(str(x) for x in items if x is not None))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def world(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Über", "x'y"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, say(rng.choice((3, 9, 10, 14)))) for i in range(12)] + [(20, None), (21, ""), (None, say(12)), (22, "only here")]
    docs = [(i, say(rng.choice((0, 4, 60, 200)))) for i in range(40)]
    docs += [(100 + i, f"{say(5)} {t.upper()}; {say(5)}") for i, (_, t) in enumerate(bench) if t] + [(7, None), (7, ""), (None, "Only, here!"), (9, say(30) + " only here"), (9, say(30))]
    return docs, bench


@pytest.mark.parametrize(("seed", "chunk", "shard"), [(1, 200_000, 250_000), (2, 30, 50)])
def test_matches_plain_search(spark, seed, chunk, shard):
    docs, bench = world(seed)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, spans int").coalesce(2)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = dec.contamination(d, b, chunk_windows=chunk, shard_words=shard).drop("spans").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(docs, bench), key=str)


@pytest.mark.parametrize("chunk", [200_000, 30])
def test_removal(spark, chunk):
    docs, bench = world(3)
    d = spark.createDataFrame([(a, t, len(t or ""), "s") for a, t in docs], "doc_id long, text string, n_chars long, source string")
    out = dec.remove_contamination(d, spark.createDataFrame(bench, "item_id long, text string"), chunk_windows=chunk).collect()
    hit = {(x[0], t): x for x, (_, t) in zip(plain(docs, bench), docs, strict=True)}
    gone = sum(x[2] == x[1] > 0 for x in hit.values())
    assert len(out) == len(docs) - gone
    clean = {(a, t) for (a, t), x in hit.items() if not x[5]}
    assert clean <= {(r.doc_id, r.text) for r in out}
    assert sum(len(dec.words_of(r.text)) for r in out) == sum(x[1] - x[2] for x in plain(docs, bench))
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dec.contamination(none, bench).count() == 0
    r = dec.contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench.where("false")).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (2, 0, 0, False)


def test_suffix_array_and_locate():
    rng = np.random.default_rng(0)
    t = np.append(rng.integers(1, 4, 300), 0)
    order = dec.suffix_array(t)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    index = dec.FMIndex(t, 4)
    low, high = index.search(np.array([[1, 2]]), np.array([2]))
    want = [i for i in range(299) if t[i] == 1 and t[i + 1] == 2]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def test_any_other_columns_and_long_texts(spark):
    docs, bench = world(5)
    names = ["row", "left", "items", "spans", "__spans", "__items", "n_words", "chunk", "x.y"]
    docs.append((500, " ".join(["w1 w2 w3"] * 20_000)))
    d = spark.createDataFrame([(a, t, *range(len(names))) for a, t in docs], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    b = spark.createDataFrame(bench, "item_id long, text string")
    for chunk in (200_000, 40):
        got = dec.contamination(d, b, chunk_windows=chunk, shard_words=1000).drop("spans").collect()
        assert sorted(map(tuple, got), key=str) == sorted(plain(docs, bench), key=str)
        out = dec.remove_contamination(d, b, chunk_windows=chunk)
        assert out.columns == d.columns and all(tuple(r)[2:] == tuple(range(len(names))) for r in out.collect())


def test_a_chunk_never_holds_more_windows(spark):
    bench = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(500))), (2, "a1 a2 a3")], "item_id long, text string")
    assert max(map(len, dec.in_chunks(bench, 10, 37))) == 37
