"""Budgets of the mixture; the stages of the pipeline against brute force."""

import math

import corpus_pipeline
import pytest
from llm import decontamination, mixing, pii
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def weights_at(tokens, a):
    raw = [math.exp(a * (math.log(t) - math.log(max(tokens)))) for t in tokens]
    return [x / sum(raw) for x in raw]


def solved(tokens, target_entropy, max_repeats, share=1.0):
    """The exponent by plain bisection over all weights."""
    total, low, high = sum(tokens), 0.0, 1.0

    def good(a):
        w = weights_at(tokens, a)
        flat = -sum(x * math.log(x) for x in w) <= target_entropy * math.log(len(tokens)) + 1e-12
        return flat and all(x * share * total <= max_repeats * t for x, t in zip(w, tokens, strict=True))

    if good(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def moments_of(tokens):
    p = [t / sum(tokens) for t in tokens]
    return lambda exponents: [(sum(x**a for x in p), sum(x**a * math.log(x) for x in p)) for a in exponents]


@pytest.mark.parametrize("tokens", [[1e6, 1e4, 1e3], [5.0], [7.0, 7.0], [1e9, 3.0], [float(3**i) for i in range(20)]])
@pytest.mark.parametrize(("target", "repeats"), [(0.9, 1e9), (1.0, 4.0), (0.98, 4.0), (0.2, 1e9), (1.0, 1e9)])
def test_exponent(tokens, target, repeats):
    got = mixing.solve_exponent(moments_of(tokens), len(tokens), min(tokens) / sum(tokens), target, repeats, 1.0)
    assert got == pytest.approx(solved(tokens, target, repeats), abs=3e-9)


def plain_draw(rows, block_tokens, seed_of, share=1.0):
    """Copies of each (doc_id, source, text): whole passes, then a prefix of the order of blocks and of the documents in the last one.

    rows are (key, source, n_tokens, h, t); seed_of(source, block) is the place of a block.
    """
    have = {}
    for _, s, n, _, _ in rows:
        have[s] = have.get(s, 0) + n
    names = list(have)
    tokens = [float(have[s]) for s in names]
    weights = dict(zip(names, weights_at(tokens, math.ceil(solved(tokens, 0.98, 4.0, share) * 1e9) / 1e9), strict=True))
    out = {}
    for s in names:
        want = round(weights[s] * share * sum(tokens))
        blocks = max(1, math.ceil(have[s] / block_tokens))
        passes, room = divmod(want, have[s])
        order = sorted(((seed_of(s, h % blocks), h % blocks, h, t, n, key) for key, x, n, h, t in rows if x == s), key=lambda x: x[:4])
        going = True
        for _, _, _, _, n, key in order:  # blocks are whole or cut at a document: a prefix either way
            going = going and n <= room
            room -= n if going else 0
            out[key] = passes + going
    return {k: v for k, v in out.items() if v}


def test_draws_are_those_of_a_plain_loop(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), ["big", "big", "mid", None, "small"][i % 5 if i % 11 else 0], "x", 7) for i in range(1500)]
    rows += [(9000, None, "big", "x", 7), (9001, " ", "new", "x", 7), (None, "a b c", "big", "x", 7), (None, "d e", "mid", "x", 7), (9002, "long " * 30_000, "mid", "x", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, room string, cut int")
    keyed = [(r["row"]["doc_id"], r["row"]["text"], r["source"], r["n_tokens"], r["h"], r["t"]) for r in mixing.counted(df, 17).collect()]
    places = {(r["source"], r["block"]): r["o"] for r in spark.createDataFrame([(s, b) for s in ("big", "mid", None, "small") for b in range(200)], "source string, block long").withColumn("o", F.xxhash64(F.lit(17), "source", "block")).collect()}
    want = plain_draw([((d, x), s, n, h, t) for d, x, s, n, h, t in keyed], 500, lambda s, b: places[s, b])
    got = {}
    for r in mixing.mix_documents(df, block_tokens=500).collect():
        got[r.doc_id, r.text] = got.get((r.doc_id, r.text), 0) + 1
        assert (r.room, r.cut) == ("x", 7) and 0 <= r.epoch < 6
    assert got == want
    again = mixing.mix_ids(df.repartition(5), block_tokens=500).collect()
    assert len(again) == sum(want.values())


def test_clashing_names_and_repeated_rows(spark):
    names = ["row", "h", "t", "o", "cut", "room", "passes", "n_blocks", "b_tokens", "copies", "block", "epoch", "n_tokens", "mix_order", "source_of", "upto", "have", "want", "s2", "k2", "part"]
    rows = [(i % 40, "w " * 5, ["a", None][i % 2], *([i % 40] * len(names))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = mixing.mix_documents(df)
    assert set(out.columns) == set(df.columns) and len(out.columns) == len(df.columns)
    out = out.collect()
    assert sorted(r.doc_id for r in out) == sorted(list(range(40)) * 2) and all(r.room == r.doc_id == r.row for r in out)


def test_mixing_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_documents(none).count() == 0
    one = spark.createDataFrame([(1, "a b", "s"), (2, None, "s")], none.schema)
    assert [r.doc_id for r in mixing.mix_documents(one).collect()] == [1]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [dec for dec in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    phrases = {p for p, _ in decontamination.benchmark_windows([(b.item_id, b.text) for b in bench], 10)}
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in rows.collect()}
        out = stage(spark, rows, SF)
        if name != "mixing":
            assert out.columns == docs.columns
            out = out.cache()
            after = {r.doc_id: r.text for r in out.collect()}
            assert set(after) <= set(before) and len(after) == out.count()
        if name in ("quality_classifier", "jaccard_join"):
            assert all(after[d] == before[d] for d in after) and len(after) > 0.5 * len(before)
        if name == "jaccard_join":
            sets = {}
            for d, t in before.items():
                w = (t or "").lower().split()
                sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
            like = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
            kept = sorted(after)
            assert not any(like(sets[a], sets[b]) for a in kept for b in kept if a < b)
            assert all(any(like(sets[d], s) for e, s in sets.items() if e != d) for d in set(before) - set(after))
        if name == "decontamination":
            for d, t in before.items():
                w = decontamination.words_of(t)
                hit = any(tuple(w[i : i + 10]) in phrases for i in range(max(1, len(w) - 9)))
                if not hit:
                    assert after[d] == t
                elif d in after:
                    assert len(decontamination.words_of(after[d])) < len(w)
        if name == "pii":
            assert all(not pii.plain_spans(t or "") for t in after.values())
            assert all(after[d] == t for d, t in before.items() if pii.pii_spans(t or "") == ([], []))
        rows = out if name == "mixing" else spark.createDataFrame(out.collect(), docs.schema)
    assert rows.count() > 0 and rows.agg(F.max("epoch")).first()[0] <= 4


def test_stages_take_odd_rows_and_names(spark):
    names = ["score", "predicted", "row", "__s", "left", "spans", "items", "cut", "room", "id", "n", "g"]
    rows = [(i, f"{word} and some more plain words about the weather of day {i} and the harvest, as ever", "en", "a", 1) for i, word in enumerate(["rain", "sun", None, "snow"] * 5) if word]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (None, "rows without a name stand here too, with quite a few words in them", None, "b", 3), (102, "long words " * 30_000, "en", "b", 9), rows[0], (103, " \n\t ", "", "", 0)]
    docs = spark.createDataFrame([(*r, *[7] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for rows_now in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows_now, SF)
            if name != "mixing":
                assert out.columns == docs.columns
                rows_now = spark.createDataFrame(out.collect(), docs.schema)
                assert all(r[n] == 7 for r in rows_now.collect() for n in names)
            else:
                out.collect()
