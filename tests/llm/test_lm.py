"""Stupid backoff against a plain implementation."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm import lm_score


def plain(texts, order, min_count, backoff):
    """Sums of log scores; contexts at the beginning of a text are padded."""
    counts, padded = Counter(), []
    for w in texts:
        p = ["\0"] * (order - 1) + w
        padded.append(p)
        for i in range(order - 1, len(p)):
            counts.update(tuple(p[i - n + 1 : i + 1]) for n in range(1, order + 1))
        if w:
            counts.update(("\0",) * n for n in range(1, order))
    total, out = sum(map(len, texts)), []
    for p in padded:
        s = 0.0
        for i in range(order - 1, len(p)):
            for n in range(order, 0, -1):
                c = counts[tuple(p[i - n + 1 : i + 1])]
                if n == 1 or c >= min_count:
                    s += (order - n) * math.log(backoff) + math.log(c / (total if n == 1 else counts[tuple(p[i - n + 1 : i])]))
                    break
        out.append(s)
    return out


def compared(spark, rows, order=3, min_count=2, parts=3):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, shard int, words string").repartition(parts)
    df.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/lm-{random.random()}")
    got = lm_score.lm_scores(spark.read.parquet(path), order, min_count).collect()
    texts = [[x.decode() for x in (t or "").encode().split()] for _, t in rows]
    want = plain(texts, order, min_count, 0.4)
    got_rows = sorted((str(r.doc_id), r.n_tokens, r.log_score) for r in got)
    want_rows = sorted((str(i), len(w), s) for (i, _), w, s in zip(rows, texts, want, strict=True))
    assert [r[:2] for r in got_rows] == [r[:2] for r in want_rows]
    assert [r[2] for r in got_rows] == pytest.approx([r[2] for r in want_rows], rel=1e-9, abs=1e-9)
    assert all((r.mean_log_score is None) == (r.n_tokens == 0) and (not r.n_tokens or abs(r.mean_log_score * r.n_tokens - r.log_score) < 1e-6 * abs(r.log_score) + 1e-9) for r in got)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(spark, order):
    compared(spark, [(1, "a b c a b"), (2, "a b c d"), (3, None), (4, ""), (5, "a b c a b"), (None, "x y a b"), (6, "q"), (1, "a b c a b"), (7, " a\tb " * 3000), (8, "é a\xa0b"), (None, None)], order)


def test_empty(spark):
    assert lm_score.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    compared(spark, [(1, None), (2, " ")])


@pytest.mark.parametrize(("min_count", "size"), [(2, 60), (3, 1000), (2, 10**6)])
def test_many_groups_and_shards(spark, monkeypatch, min_count, size):
    monkeypatch.setattr(lm_score, "MOST", size)
    monkeypatch.setattr(lm_score, "PER_SHARD", 300)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randint(1, 60)))) for i in range(300)]
    compared(spark, [*rows, (900, "u1 u2 u3 u4"), (901, "r s r s r s"), (902, "r r r"), (903, "w1 w2 " * 5000), *[(904, "same row")] * 40], 3, min_count)


def test_more_words_than_any_bound(spark):
    compared(spark, [(i, " ".join(f"x{i * 500 + j}" for j in range(500)) + " rare pair" * (i % 3)) for i in range(300)])


def test_shards_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PER_SHARD", 50)
    df = spark.createDataFrame([(i, f"a b c d{i}") for i in range(500)], "doc_id long, text string")
    assert lm_score._shards(df) > 15
    counts = lm_score.ngram_counts(df, 2).collect()
    grams = Counter()
    for i in range(500):
        w = ["a", "b", "c", f"d{i}"]
        grams.update([(x,) for x in w] + list(zip(["\0", *w], w, strict=False)) + ["begin"])
        grams["empty"] += 4
    assert sorted(r.n for r in counts) == sorted(grams.values())


def test_packing():
    rng = np.random.default_rng(1)
    for size in (0, 1, 511, 512, 5000):
        key = np.unique(rng.integers(0, 1 << 48, size).astype(np.uint64))
        assert (lm_score.unpack_keys(lm_score.pack_keys(key)) == key).all()
        n = rng.choice([1, 2, 254, 255, 256, 10**9], size)
        assert (lm_score.unpack_counts(lm_score.pack_counts(n)) == n).all()


def test_an_order_that_changes_is_an_error():
    a = lm_score._table(lm_score.COUNTS, [{"group": 1, "ids": b"", "known": b"", "length": b"", "words": b""}, {"group": 1, "shard": 0, "n": b"", "many": b""}, {"group": 1, "shard": 1, "n": b"", "many": b""}]).to_pylist()
    with pytest.raises(ValueError, match="same order"):
        lm_score._scored(3, 2, 0.4)(pa.Table.from_batches([lm_score._table(lm_score.COUNTS, a[1:])]))
