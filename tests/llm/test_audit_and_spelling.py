"""Filter audit and spelling variants against brute force, with odd rows."""

import itertools
import re
import zlib

import pytest
from llm import filter_audit, spelling

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def audit_by_hand(docs, labels):
    fails = []
    for doc_id, text, lang in docs:
        t = text or ""
        w = GAP.findall(t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        f += "E" * any(i is not None and doc_id is not None and i < doc_id and (x or "") == t for i, x, _ in docs)
        own = [x for x in labels if x[0] is not None and x[0] == doc_id]
        fails.append((lang or "", set(f), any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    out = set()
    worth = {}
    rows = []
    for part in {x[0] for x in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in fails if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                cut = [x for x in left if f in x[1]]
                n = (len(left) - len(cut), len(cut), sum(f in x[1] for x in gone), sum(x[1] == {f} for x in fails if x[0] == part), sum(x[2] for x in cut), sum(x[3] for x in cut))
                left, gone = [x for x in left if f not in x[1]], gone + cut
                worth[part, f] = worth.get((part, f), 0) + len(cut)
                rows.append((part, "".join(order), step, *n))
    for r in rows:
        out.add((*r, worth[r[0], r[1][r[2] - 1]]))
    return out


def long(n, k, extra=""):
    return " ".join(f"w{i % k}" for i in range(n)) + extra


DOCS = [
    (1, long(250, 250), "en"), (2, long(250, 250), "en"), (2, long(250, 250), "en"), (3, long(250, 5), "en"), (4, long(199, 199, " #"), "de"), (5, "ABC", "de"),
    (6, None, None), (7, "", ""), (None, "", None), (None, None, "en"), (8, long(300, 10, " $ ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGH"), "fr"), (9, " \t\n", "fr"),
    (10, long(250, 250), "fr"), (11, long(200, 100), "en"), (11, long(201, 100), "en"), (12, "x" * 300_000, "fr"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, None), (None, 1, 1), (5, 1, 1), (99, 1, 1), (10, 1, 0), (8, 0, 1)]


def test_audit_matches_brute_force(spark):
    docs = spark.createDataFrame([(*d, "clash") for d in DOCS], "doc_id long, text string, lang string, mask string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.filter_audit(docs, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()]
    assert len(got) == 600 * 4 and set(got) == audit_by_hand(DOCS, LABELS)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0
    some = spark.createDataFrame(DOCS[:3], docs.schema)
    assert {r["good_lost"] for r in filter_audit.filter_audit(some, labels).collect()} == {0}


def variants_by_hand(docs, every=31):
    n = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] = n.get(run, 0) + 1
    n = {w: c for w, c in n.items() if c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        close = sorted((-n[x], x) for x in n if x != w and near(w, x))
        form[w] = close[0][1] if close and -close[0][0] >= 10 * n[w] else None
        out[w] = len(close)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


def test_variants_match_brute_force(spark):
    words = ["language"] * 3000 + ["languaje"] * 250 + ["languages"] * 20 + ["langage"] * 25 + ["laanguage"] * 2 + ["llanguage"] * 2 + ["languajes"] * 2
    words += ["aaaaaaa"] * 2 + ["aaaaaaaa"] * 2 + ["aaaaaaaaa"] * 20 + ["abababa"] * 3 + ["bababab"] * 3 + ["Übermut"] * 2 + ["übermut"] * 30 + ["übermüt"] * 3 + ["kurzes"] * 5
    words += ["zzzzzza"] * 4 + ["zzzzzzb"] * 4 + ["zzzzzzc"] * 4 + ["LANGUAGE"] * 5 + ["ÿxÿxÿxÿ"] * 2 + ["ÿxÿxÿx"] * 2
    docs = [(i, " ".join(words[i::40])) for i in range(40)] + [(None, "language übermut languaje"), (7, None), (8, ""), (9, "1234 --"), (9, "1234 --"), (50, "q" * 9000), (51, "q" * 9000), (52, "q" * 9001 + " " + "q" * 9001)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int").repartition(3)
    got = spelling.spelling_variants(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len({r["word"] for r in got})
    assert {tuple(r) for r in got} == variants_by_hand(docs)


@pytest.mark.parametrize("words", [["abcdefg", "abcdefgh", "bbbbbbbb", "é" * 8], ["x" * 3000]])
def test_keys_are_those_of_the_shortened_strings(words):
    import numpy as np

    key = np.concatenate([k for k, *_ in spelling.deletion_keys(words)])
    index = np.concatenate([i for _, i, *_ in spelling.deletion_keys(words)])
    at = np.concatenate([a for _, _, a, _ in spelling.deletion_keys(words)])
    short = [words[i] if a < 0 else words[i][:a] + words[i][a + 1 :] for i, a in zip(index, at, strict=True)]
    again = {}
    for k, s in zip(key.tolist(), short, strict=True):
        assert again.setdefault(s, k) == k
    assert len(set(again.values())) == len(again)


def test_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0
