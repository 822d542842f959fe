"""Spelling variants: words one edit apart, found by rolling-hash deletions.

Words are counted with native expressions.  Then every word gives one integer
key for each of its deletions: prefix and suffix polynomial hashes of all words
of one length are two NumPy matrices, and the hash of a word without letter i is
prefix(i) * B^(length - 1 - i) + suffix(i + 1).  Keys go to radix partitions by
their upper bits and are sorted there; only keys that two rows share go on.
Those get their words back by a join, and the shortened strings themselves, not
their hashes, decide who is near:

* words of one length that agree without letter i differ by a replacement there;
* a word that equals another one without letter i is a deletion of it.

No pairs are listed.  In each group the two most frequent words are enough: the
best neighbour of everybody is the first, that of the first the second, and the
number of neighbours is the size less one.  A group of replacements at one place
holds as many words as there are letters at most.  Partial results are summed
for each word.  Forms grow tenfold in count at each step, so roots take a few
rounds of pointer jumping.

The word rows of a key carry hashes and numbers only, so a run of many thousand
letters costs a row for each of its letters, not a copy of itself for each.

Edge cases: a null text has no words; a null doc_id is written as nothing in
the seed of the damage; repeated rows count each; ties between neighbours go to
the smallest word in code-point order; words without neighbours have n_near 0,
no form and are their own root; empty tables give no rows; other columns of docs
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import U, lean, mixed, saved, shuffle_partitions, slices, table, word_hashes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"
BASE = U(0x9E3779B97F4A7C15)  # odd
KEYS = "key long, h long, at int, first boolean, radix int"
NEAR = "word string, n_near long, near_n long, near string"


def damaged(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run, without one letter where the crc32 of `<doc_id>:<run>` is divisible by `every`."""
    seed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (seed % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(seed % every == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, every: int = 31, min_letters: int = 7, min_count: int = 2) -> DataFrame:
    """word and n of docs(doc_id, text)."""
    low = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_letters)  # damage only shortens
    words = runs.select(damaged(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.length("word") >= min_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


def deletion_keys(words: list[str], letters_at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """key, index of the word, place of the deleted letter (-1: none), whether it is the first of its run of equal letters."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(U)
    start = np.concatenate([[0], np.cumsum(size)])
    for n in np.unique(size).tolist():
        rows, power = np.flatnonzero(size == n), powers(n)
        for some in np.array_split(rows, len(rows) * n // letters_at_once + 1):
            m = letters[start[some][:, None] + np.arange(n)[None, :]] + U(1)
            prefix, suffix = np.zeros((len(some), n + 1), U), np.zeros((len(some), n + 1), U)
            for i in range(n):
                prefix[:, i + 1] = prefix[:, i] * BASE + m[:, i]
            for i in reversed(range(n)):
                suffix[:, i] = m[:, i] * power[n - 1 - i] + suffix[:, i + 1]
            cut = mixed(prefix[:, :n] * power[n - 1 :: -1][None, :n] + suffix[:, 1:] + U(n - 1))
            whole = mixed(prefix[:, n] + U(n))
            first = np.ones((len(some), n + 1), bool)
            first[:, 1:n] = m[:, 1:] != m[:, :-1]
            key = np.concatenate([cut, whole[:, None]], axis=1)
            at = np.tile(np.append(np.arange(n), -1), len(some))
            yield key.ravel(), np.repeat(some, n + 1), at, first.ravel()


def hashes(words: list[str]) -> np.ndarray:
    return word_hashes([w.encode() for w in words]).view(np.int64)


def keys_of(batches: Iterator[pa.RecordBatch], radices: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 4096):
        words = b.column(0).to_pylist()
        h = hashes(words)
        for key, index, at, first in deletion_keys(words):
            radix = ((key >> U(32)) * U(radices)) >> U(32)
            data = [key.view(np.int64), h[index], at.astype(np.int32), first, radix.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in data], names=["key", "h", "at", "first", "radix"])


def with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 4096):
        yield pa.RecordBatch.from_arrays([pa.array(hashes(b.column(0).to_pylist())), *b.columns], names=["h", "word", "n"])


def shared_keys(t: pa.Table) -> pa.Table:
    """Rows of a radix partition whose key others have too."""
    key = t.column("key").to_numpy()
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return t.take(pa.array(np.sort(order[shared])))


def best_others(group: np.ndarray, n: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of groups of two or more: row, size of the group less one, row of the best other."""
    order = np.lexsort((word, -n, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.concatenate([start, [len(g)]]))
    head, many = np.repeat(start, size), np.repeat(size, size)
    keep = many > 1
    place = np.arange(len(g))
    other = np.where(place == head, np.minimum(head + 1, len(g) - 1), head)
    return order[keep], many[keep] - 1, order[other[keep]]


def near_words(t: pa.Table) -> pa.Table:
    """Partial neighbours of the words of a radix partition: equal shortened strings, not equal hashes."""
    word = np.array(t.column("word").to_pylist(), object)
    n, at, first = t.column("n").to_numpy(), t.column("at").to_numpy(), t.column("first").to_numpy(zero_copy_only=False)
    short = [w if i < 0 else w[:i] + w[i + 1 :] for w, i in zip(word, at.tolist(), strict=True)]
    code = pd.factorize(np.array(short, object))[0] if short else np.empty(0, np.int64)
    rank = np.empty(len(word), np.int64)  # code-point order
    rank[np.argsort(word, kind="stable")] = np.arange(len(word))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cut = np.flatnonzero(at >= 0)
    if len(cut):
        row, many, other = best_others(code[cut] * (int(at.max()) + 1) + at[cut], n[cut], rank[cut])
        out.append((cut[row], many, cut[other]))
    owner = np.full(int(code.max(initial=-1)) + 1, -1)
    owner[code[at < 0]] = np.flatnonzero(at < 0)  # words are distinct: one whole word for a string at most
    longer = np.flatnonzero((at >= 0) & first)
    longer = longer[owner[code[longer]] >= 0]
    if len(longer):
        mine = owner[code[longer]]
        out.append((longer, np.ones(len(longer), np.int64), mine))
        order = np.lexsort((rank[longer], -n[longer], mine))
        start = np.flatnonzero(np.concatenate([[True], mine[order][1:] != mine[order][:-1]]))
        out.append((mine[order][start], np.diff(np.concatenate([start, [len(order)]])), longer[order][start]))
    row, many, other = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
    return pa.table({"word": pa.array(word[row], pa.string()), "n_near": pa.array(many, pa.int64()), "near_n": pa.array(n[other], pa.int64()), "near": pa.array(word[other], pa.string())})


def neighbours(words: DataFrame, rows_per_task: int = 400_000) -> DataFrame:
    """n_near, near_n and near of the words(word, n) that have a neighbour."""
    letters = words.agg(F.sum(F.length("word").cast("long") + 1)).first()[0] or 0
    radices = max(shuffle_partitions(words.sparkSession), math.ceil(letters / rows_per_task))
    keys = words.select("word").mapInArrow(lambda batches: keys_of(batches, radices), KEYS)
    shared = keys.groupBy("radix").applyInArrow(lean(shared_keys), KEYS)
    named = words.mapInArrow(with_hash, "h long, word string, n long")
    rows = shared.join(named, "h").select("radix", "word", "n", "at", "first")
    near = rows.groupBy("radix").applyInArrow(lean(near_words), NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.minus")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms(word, form): pointer jumping, each round twice as far."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = saved(now.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, every: int = 31, min_letters: int = 7, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of docs(doc_id, text)."""
    words = saved(word_counts(docs, every, min_letters, min_count), "words")
    near = neighbours(words)
    known = words.join(near, "word", "left")
    form = F.col("near_n") >= ratio * F.col("n")
    known = saved(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")), "forms")
    last = roots(known.where("form IS NOT NULL"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE step0 AS (SELECT x, x AS c, 0 AS k FROM range(256) AS r(x)
  UNION ALL SELECT x, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM step0 WHERE k < 8),
crc AS (SELECT list(c ORDER BY x) AS t FROM step0 WHERE k = 8),
lowered AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
runs AS (SELECT doc, run, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM lowered) WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, n, list_concat([4294967295], flatten(list_transform(string_split(doc || ':' || run, ''), lambda c:
                   CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))) AS b FROM runs),
seeds AS (SELECT run, n, xor(4294967295, list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM bytes, crc),
words AS (SELECT word, sum(n)::BIGINT AS n
          FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM seeds)
          WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS short FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.short = b.word
          UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.short = b.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM pairs),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
          FROM words w LEFT JOIN best b ON w.word = b.word AND k = 1),
chain AS (SELECT word, form AS root, 1 AS depth FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, form, coalesce((SELECT arg_max(root, depth) FROM chain c WHERE c.word = f.word), word) AS root, n, n_near, form_n FROM forms f
"""
