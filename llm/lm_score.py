"""Stupid-backoff language-model scores over the whole corpus.

Every token of every text is scored by the longest n-gram that ends in it and is
frequent enough, of ``order`` words at most:

    score(w | u v) = c(u v w) / c(u v)        if c(u v w) >= min_count
                   = backoff * score(w | v)   otherwise;  score(w) = c(w) / N

Three relations, all packed, since a row for each token and order would be many
times the text:

* exploded n-grams: each group of documents has the distinct hashes of its
  n-grams of all orders, sorted, with their counts; contexts at the beginning of
  a text and the empty n-gram (whose count is N) are n-grams like others.  A row
  is a group's part of one hash range (``shard``).
* n-gram count tables, partitioned by hash: a shard holds all n-grams of its
  range.  It counts them and is joined there to the exploded n-grams that it was
  counted from, so each group gets the corpus counts of its own n-grams, in order.
* groups of documents with their texts, compressed: joined to the counts by
  group, where each document's tokens are scored and summed.

``ngram_counts`` gives the count tables as plain rows.  A frequent n-gram is one
entry for each group, whatever its share.  Shards are added with the size of the
texts, so that one counts about ``PER_SHARD`` tokens; a group has ``MOST`` words
at most (or one document).  Nothing is broadcast or sent to the driver but the
length of all texts.  A hash is cut to 48 bits inside its shard: 53 bits and more
in all, and more with more shards.

The texts are read twice, for n-grams and for groups, and must come in the same
order both times, as those of files do; otherwise a group misses its counts and
the job fails.  Write docs first where that is in doubt.

Edge cases: null and empty texts have 0 tokens, log_score 0 and no mean; repeated
rows are counted and scored each; a null doc_id is scored; a very long text is a
group of its own; ties can't arise; an empty table gives no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import U, as_bytes, lean, mixed, shuffle_partitions, slices, table, word_hashes

#: words of a group of documents: so many for each shard, within bounds of memory
PER_PART, LEAST, MOST = 20_000, 500_000, 1_500_000
#: tokens of the corpus for each shard, about
PER_SHARD = 1_000_000
KEY_BITS = 48
PACKED = "shard int, group long, top binary, low binary, n binary, many binary"
COUNTS = "shard int, group long, n binary, many binary, ids binary, known binary, length binary, words binary"
SCORES = "doc_id long, n_tokens long, log_score double, mean_log_score double"


def _table(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], names=[x[0] for x in fields])


def pack_counts(n: np.ndarray) -> dict[str, bytes]:
    """A byte for each count; those of 255 and more besides, in order."""
    return {"n": np.minimum(n, 255).astype(np.uint8).tobytes(), "many": n[n >= 255].astype(np.int64).tobytes()}


def unpack_counts(row: dict) -> np.ndarray:
    n = np.frombuffer(row["n"], np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(row["many"], np.int64)
    return n


def pack_keys(key: np.ndarray) -> dict[str, bytes]:
    """Sorted keys of 48 bits: how many there are of each first byte (if there are many keys), and the other bytes."""
    raw = key.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(key) < 512:
        return {"top": b"", "low": raw[:, :6].tobytes()}
    return {"top": np.bincount(raw[:, 5], minlength=256).astype(np.uint32).tobytes(), "low": raw[:, :5].tobytes()}


def unpack_keys(row: dict) -> np.ndarray:
    top, width = np.frombuffer(row["top"], np.uint32), 5 if row["top"] else 6
    low = np.frombuffer(row["low"], np.uint8).reshape(-1, width)
    raw = np.zeros((len(low), 8), np.uint8)
    raw[:, :width] = low
    if len(top):
        raw[:, 5] = np.repeat(np.arange(256, dtype=np.uint8), top)
    return raw.view("<u8").reshape(-1).astype(U)


def longer(prefix: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that continue prefixes of n - 1 words by a word."""
    return mixed(prefix * U(0x9E3779B97F4A7C15) + word + U(n))


#: the empty n-gram, and beginnings of a text as contexts of 1, 2, ... words
EMPTY = word_hashes([b"\x01"])[0]


def begins(order: int) -> np.ndarray:
    return word_hashes([b"\x02 %d" % n for n in range(1, order)])


def grams_of(h: np.ndarray, length: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the hash of the n-gram that ends in each token (h: hashes of the words), and the places of first tokens."""
    first = (np.cumsum(length) - length)[length > 0]
    out, begin = [h], begins(order)
    for n in range(2, order + 1):
        prefix = np.empty_like(h)
        prefix[1:] = out[-1][:-1]
        prefix[first] = begin[n - 2]
        out.append(longer(prefix, h, n))
    return out, first


def distinct(grams: list[np.ndarray], texts: int, order: int, inverse: bool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """All hashes of a group, sorted, their counts, for each order which one a token has (before sorting), and the order of sorting."""
    hashes, counts, places, at = [], [], [], 0
    for g in grams:
        u, *more = np.unique(g, return_inverse=inverse, return_counts=True)
        hashes.append(u)
        counts.append(more[-1])
        if inverse:
            places.append((more[0] + at).astype(np.int32))
        at += len(u)
    hashes += [begins(order), np.array([EMPTY])]
    counts += [np.full(order - 1, texts), np.array([len(grams[0])])]
    every = np.concatenate(hashes)
    by = np.argsort(every, kind="stable")
    return every[by], np.concatenate(counts)[by], places, by


def grouped(batches: Iterator[pa.RecordBatch], size: int, take: Callable) -> Iterator[tuple[list, list, np.ndarray, int]]:
    """(doc_ids, what take makes of the words of each document, their numbers, group) of groups of documents of about size words."""
    ids, taken, length, n = [], [], [], 0
    mark = xxhash.xxh3_64()

    def group() -> tuple:
        mark.update(repr(ids).encode())
        return ids, taken, np.array(length, np.int64), int(np.array(mark.intdigest(), U).astype(np.int64))  # the same when a task runs again

    for b in slices(batches):
        for doc, text in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text")), strict=True):
            w = text.split()
            if ids and n + len(w) > size:
                yield group()
                ids, taken, length, n = [], [], [], 0
                mark = xxhash.xxh3_64()
            ids.append(doc)
            taken.append(take(w))
            length.append(len(w))
            n += len(w)
            mark.update(text)
    if ids:
        yield group()


def runs_of(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of the runs of a sorted array: the work grows with what a group holds, not with the number of shards."""
    start = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.empty(0, np.int64)
    return list(zip(shard[start].tolist(), start.tolist(), [*start[1:].tolist(), len(shard)], strict=True)) if len(start) else []


def _exploded(order: int, shards: int, size: int):
    width = -(-(1 << 64) // shards)  # hashes of one shard
    shift = U(max(0, (width - 1).bit_length() - KEY_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, length, group in grouped(batches, size, word_hashes):
            grams, first = grams_of(np.concatenate(hashes), length, order)
            hashes.clear()
            key, n, _, _ = distinct(grams, len(first), order, inverse=False)
            grams.clear()
            rows, held = [], 0
            for s, a, b in runs_of(key // U(width) if shards > 1 else np.zeros(len(key), U)):
                rows.append({"shard": s, "group": group} | pack_keys((key[a:b] - U(s * width)) >> shift) | pack_counts(n[a:b]))
                held += b - a
                if held > 400_000:
                    yield _table(PACKED, rows)
                    rows, held = [], 0
            if rows:
                yield _table(PACKED, rows)

    return run


def _counted(t: pa.Table) -> pa.Table:
    """The count table of one shard, joined to the n-grams of each group there."""
    rows = t.to_pylist()
    keys = [unpack_keys(r) for r in rows]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(place, weights=np.concatenate([unpack_counts(r) for r in rows])).astype(np.int64)
    edge = np.cumsum([0, *map(len, keys)])
    return pa.Table.from_batches([_table(COUNTS, [{"shard": r["shard"], "group": r["group"]} | pack_counts(n[place[a:b]]) for r, a, b in zip(rows, edge[:-1], edge[1:], strict=True)])])


def _groups(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, length, group in grouped(batches, size, b" ".join):
            known = np.array([x is not None for x in ids])
            row = {"group": group, "ids": np.array([x or 0 for x in ids], np.int64).tobytes(), "known": np.packbits(known).tobytes(), "length": length.tobytes()}
            yield _table(COUNTS, [row | {"words": zstandard.ZstdCompressor(level=5).compress(b"\n".join(words))}])

    return run


def _scored(order: int, min_count: int, backoff: float):
    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        heads, parts = [r for r in rows if r["words"] is not None], sorted((r for r in rows if r["words"] is None), key=lambda r: r["shard"])
        if len(heads) * len({r["shard"] for r in parts}) != len(parts) or not heads:
            raise ValueError("n-grams and groups of documents differ: docs must give its rows in the same order when it is read again; write it to a table first")
        length = np.frombuffer(heads[0]["length"], np.int64)
        texts = zstandard.ZstdDecompressor().decompress(heads[0]["words"]).split(b"\n")  # no word holds a line break
        grams, first = grams_of(np.concatenate([word_hashes(x.split()) for x in texts]), length, order)
        del texts
        key, _, places, by = distinct(grams, len(first), order, inverse=True)
        grams.clear()
        counts = np.concatenate([unpack_counts(r) for r in parts[:: len(heads)]])  # equal groups get equal counts
        if len(counts) != len(key):
            raise ValueError("a group of documents misses counts: write docs to a table first")
        log = np.empty(len(key))
        log[by] = np.log(counts)
        begin, total = log[len(key) - order : -1], log[-1]
        score = np.log(backoff) * (order - 1) + log[places[0]] - total
        for n in range(2, order + 1):  # a longer n-gram that is frequent enough overrules
            context = np.empty_like(score)
            context[1:] = log[places[n - 2][:-1]]
            context[first] = begin[n - 2]
            value = log[places[n - 1]]
            score = np.where(value > np.log(min_count) - 1e-9, np.log(backoff) * (order - n) + value - context, score)
        sums = np.zeros(len(length))
        if len(first):
            sums[length > 0] = np.add.reduceat(score, first)
        mean = np.divide(sums, length, out=np.zeros(len(length)), where=length > 0)
        out = []
        for h in heads:
            ids, known = np.frombuffer(h["ids"], np.int64), np.unpackbits(np.frombuffer(h["known"], np.uint8), count=len(length)).astype(bool)
            columns = [pa.array(ids, mask=~known), pa.array(length), pa.array(sums), pa.array(mean, mask=length == 0)]
            out.append(pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORES.split(", ")]))
        return pa.Table.from_batches(out)

    return run


def _shards(rows: DataFrame) -> int:
    words = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    return max(shuffle_partitions(rows.sparkSession), words // PER_SHARD + 1)


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def lm_scores(docs: DataFrame, order: int = 3, min_count: int = 2, backoff: float = 0.4) -> DataFrame:
    """doc_id, n_tokens, log_score (sum of natural logs) and mean_log_score of every row of docs(doc_id, text)."""
    rows = _narrow(docs)
    shards = _shards(rows)
    size = min(max(LEAST, shards * PER_PART), MOST)
    counts = rows.mapInArrow(_exploded(order, shards, size), PACKED).groupBy("shard").applyInArrow(lean(_counted), COUNTS)
    return counts.unionByName(rows.mapInArrow(_groups(size), COUNTS)).groupBy("group").applyInArrow(lean(_scored(order, min_count, backoff)), SCORES)


def ngram_counts(docs: DataFrame, order: int = 3) -> DataFrame:
    """The count tables as rows: shard, gram (hash inside its shard) and n, for n-grams of 1 to order words."""
    rows = _narrow(docs)
    shards = _shards(rows)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                key = unpack_keys(r).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), r["shard"], np.int32)), pa.array(key), pa.array(unpack_counts(r))], names=["shard", "gram", "n"])

    exploded = rows.mapInArrow(_exploded(order, shards, min(max(LEAST, shards * PER_PART), MOST)), PACKED)
    return exploded.mapInArrow(plain, "shard int, gram long, n long").groupBy("shard", "gram").agg(F.sum("n").alias("n"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
