"""Benchmark decontamination with an FM-index per training shard.

A task gathers documents into shards of about ``shard_words`` words and builds
an FM-index of each: the word sequence (words that no benchmark item has become
one symbol), its suffix array, the Burrows-Wheeler transform in a wavelet tree,
and every ``sample``-th text position.  All benchmark windows are searched
backwards at once; the wavelet tree's ranks narrow their suffix intervals, the
rows of non-empty intervals walk back to a sampled position, and the located
occurrences are merged into removal spans per document.

The benchmark streams through the driver in chunks of ``chunk_windows`` distinct
windows; each chunk is one pass over the rows, added to what the passes before
have found and written to the shared folder before the next chunk is read.  So
driver and tasks hold one chunk at a time.  A usual benchmark is one pass.

Edge cases: a null text has no words; an item without words has no window; an
item with fewer than ``window`` words is one window; an empty benchmark hits
nothing; equal items count each under its id; a null item_id counts but has no
name in the digest; repeated documents are searched each; other columns, whatever
their names, are ignored or kept as they are; a text longer than a shard is a
shard of its own; occurrences that touch or overlap are one span.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from llm.common import as_bytes, give_back, merge_spans, saved, table

#: A-Z to a-z; what is no part of a word to a space
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(FOLD).split()


def benchmark_windows(items: list[tuple], window: int) -> list[tuple[tuple[bytes, ...], list]]:
    """Distinct windows with the ids of the items that have them."""
    out: dict[tuple[bytes, ...], dict] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(0, len(w) - window) + 1 if w else 0):
            out.setdefault(tuple(w[i : i + window]), {})[item] = None
    return [(k, list(v)) for k, v in out.items()]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; only suffixes that are not yet told apart are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.concatenate(([True], text[order][1:] != text[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    k = 1
    while True:
        single = head & np.append(head[1:], True)
        open_rows = np.flatnonzero(~single)
        if not len(open_rows):
            return order
        pos = order[open_rows]
        ahead = pos + k
        following = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        key = rank[pos] * np.int64(n + 1) + following + 1
        by = np.argsort(key, kind="stable")
        order[open_rows] = pos[by]
        key = key[by]
        head[open_rows] = np.concatenate(([True], key[1:] != key[:-1]))
        starts = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order[open_rows]] = starts[open_rows]
        k *= 2


class FMIndex:
    """Count and locate over a sequence of symbols 0..symbols-1; the sequence ends in its only 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 16):
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros, at = [], [], bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (at >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(n - self.ones[-1][-1]))
            at = np.concatenate((at[bit == 0], at[bit == 1]))
        self.bwt, self.sample = bwt, sample
        kept = order % sample == 0
        self.kept, self.kept_rank, self.kept_at = kept, np.cumsum(kept) - 1, order[kept]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        low = np.zeros(len(row), np.int64)
        high = row.astype(np.int64)
        for i in range(self.levels):
            bit = (symbol >> (self.levels - 1 - i)) & 1
            ones, zeros = self.ones[i], self.zeros[i]
            a, b = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low = np.where(bit == 1, zeros + a, low - a)
            high = np.where(bit == 1, zeros + b, high - b)
        return high - low

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of phrases (rows are right-aligned) by backward search."""
        low, high = np.zeros(len(length), np.int64), np.full(len(length), len(self.bwt), np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((length > step) & (low < high))
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - step]
            low[live], high[live] = self.first[c] + self.rank(c, low[live]), self.first[c] + self.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one."""
        out, steps, at, todo = np.empty(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(todo):
            hit = self.kept[at]
            out[todo[hit]] = self.kept_at[self.kept_rank[at[hit]]] + steps
            at, todo = at[~hit], todo[~hit]
            c = self.bwt[at]
            at = self.first[c] + self.rank(c, at)
            steps += 1
        return out


def shard_hits(texts: list[list[bytes]], vocabulary: dict[bytes, int], phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, phrase) of every occurrence in a shard."""
    sizes = np.array([len(t) for t in texts])
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.ones(at[-1], np.int64)  # 1 parts documents and is any word that no item has; 0 ends the shard
    for t, a in zip(texts, at, strict=False):
        text[a : a + len(t)] = np.fromiter(map(vocabulary.get, t, repeat(1)), np.int64, len(t))
    # an occurrence lies within a run of item words that is no shorter than the shortest phrase: one 1 stands for all between such runs
    edge = np.diff(np.concatenate(([0], (text > 1).astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= length.min()
    mark = np.zeros(len(text) + 1, np.int8)
    mark[begin[long]] += 1
    mark[end[long]] -= 1
    keep = np.cumsum(mark[:-1]) > 0
    keep[end[long][end[long] < len(text)]] = True
    where = np.flatnonzero(keep)
    if not len(where):
        return where, where, where
    index = FMIndex(np.append(text[keep], 0), len(vocabulary) + 2)
    low, high = index.search(phrases, length)
    found = np.flatnonzero(low < high)
    counts = high[found] - low[found]
    rows = np.repeat(low[found] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum()) if len(found) else np.empty(0, np.int64)
    pos = where[index.locate(rows)] if len(rows) else rows
    doc = np.searchsorted(at, pos, side="right") - 1
    return doc, pos - at[doc], np.repeat(found, counts)


Windows = list[tuple[tuple[bytes, ...], list]]
FOUND = "spans array<struct<start:int,end:int>>, items array<string>"
_SPANS, _ITEMS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())


def in_chunks(benchmark: DataFrame, window: int, chunk_windows: int) -> Iterator[Windows]:
    """The distinct windows of the benchmark, some at a time; at least one chunk.  An item may begin in one and end in another."""
    out: dict[tuple[bytes, ...], dict] = {}
    for r in benchmark.select("item_id", "text").toLocalIterator():
        w = words_of(r["text"])
        for i in range(max(0, len(w) - window) + 1 if w else 0):
            out.setdefault(tuple(w[i : i + window]), {})[r["item_id"]] = None
            if len(out) >= chunk_windows:
                yield [(k, list(v)) for k, v in out.items()]
                out = {}
    yield [(k, list(v)) for k, v in out.items()]


def _shards(batches: Iterator[pa.RecordBatch], windows: Windows, shard_words: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[list], list[list]]]:
    """Rows of a shard with their words, merged spans and item names, added to those of an earlier chunk."""
    vocabulary: dict[bytes, int] = {}
    for phrase, _ in windows:
        for w in phrase:
            vocabulary.setdefault(w, len(vocabulary) + 2)
    wide = max((len(p) for p, _ in windows), default=0)
    phrases, length = np.zeros((len(windows), wide), np.int64), np.array([len(p) for p, _ in windows])
    for i, (p, _) in enumerate(windows):
        phrases[i, wide - len(p) :] = [vocabulary[w] for w in p]
    ids = [[None if x is None else str(x) for x in names] for _, names in windows]

    def judged(b: pa.RecordBatch, texts: list[list[bytes]]) -> tuple:
        old = "spans" in b.schema.names
        spans = [[(x["start"], x["end"]) for x in s] for s in b.column("spans").to_pylist()] if old else [[] for _ in texts]
        items = [set(x) for x in b.column("items").to_pylist()] if old else [set() for _ in texts]
        if windows:
            for d, first, p in zip(*(x.tolist() for x in shard_hits(texts, vocabulary, phrases, length)), strict=True):
                spans[d].append((first, first + int(length[p])))
                items[d].update(ids[p])
        return b, texts, [[{"start": a, "end": e} for a, e in merge_spans(s)] for s in spans], [sorted(x, key=lambda y: (y is None, y)) for x in items]

    for b in batches:
        texts, n, start = [], 0, 0
        for at, part in ((i, b.column("text").slice(i, 256)) for i in range(0, b.num_rows, 256)):
            for k, raw in enumerate(as_bytes(part)):
                w = words_of(raw)
                if texts and n + len(w) > shard_words:
                    yield judged(b.slice(start, at + k - start), texts)
                    texts, n, start = [], 0, at + k
                texts.append(w)
                n += len(w)
        if texts:
            yield judged(b.slice(start), texts)
    give_back()


def _more(b: pa.RecordBatch, words: list[list[bytes]], spans: list[list], items: list[list]) -> pa.RecordBatch:
    """What the next pass needs."""
    return pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(spans, _SPANS), pa.array(items, _ITEMS)], names=["row", "text", "spans", "items"])


def _judged(b: pa.RecordBatch, words: list[list[bytes]], spans: list[list], items: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("row"), pa.array(map(len, words), pa.int64()), pa.array(spans, _SPANS), pa.array(items, _ITEMS)], names=["row", "n_words", "spans", "items"])


def _cut(b: pa.RecordBatch, words: list[list[bytes]], spans: list[list], items: list[list]) -> pa.RecordBatch:
    text = [without_words(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(b.column("text").to_pylist(), spans, strict=True)]
    left = [not s or sum(x["end"] - x["start"] for x in s) < len(w) for s, w in zip(spans, words, strict=True)]
    return pa.RecordBatch.from_arrays([b.column("row"), pa.array(text, pa.string()), pa.array(left)], names=["row", "text", "left"])


def passes(rows: DataFrame, benchmark: DataFrame, window: int, chunk_windows: int, shard_words: int, finish, result: str) -> DataFrame:
    """finish over all shards of rows(row, text) once all chunks of the benchmark are searched: row and the columns of result."""

    def step(chunk: Windows, end):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in _shards(batches, chunk, shard_words):
                yield end(*shard)

        return run

    schema = lambda ddl: StructType([rows.schema["row"], *DataType.fromDDL(ddl).fields])
    chunk: Windows | None = None
    for following in in_chunks(benchmark, window, chunk_windows):
        if chunk is not None:
            rows = saved(rows.mapInArrow(step(chunk, _more), schema(f"text string, {FOUND}")), "searched")
        chunk = following
    return rows.mapInArrow(step(chunk, finish), schema(result))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, chunk_windows: int = 200_000, shard_words: int = 250_000) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256, contaminated and removal spans (word offsets) of every row of docs(doc_id, text)."""
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), F.col("text").cast("string").alias("text"))
    found = passes(rows, benchmark, window, chunk_windows, shard_words, _judged, f"n_words long, {FOUND}")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.filter("items", lambda x: x.isNotNull())), ",")
    return found.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the word intervals, cut from the first byte of the first word to the last byte of the last."""
    raw = text.encode()
    folded, place, at = raw.translate(FOLD), [], 0
    for w in folded.split():
        at = folded.index(w, at)
        place.append((at, at + len(w)))
        at += len(w)
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : place[a][0]])
        at = place[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, chunk_windows: int = 200_000, shard_words: int = 250_000) -> DataFrame:
    """docs with the removal spans cut out of text and n_chars made to fit; a contaminated row with no word left goes.  Rows keep their other columns."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), F.col("text").cast("string").alias("text"))
    out = passes(rows, benchmark, window, chunk_windows, shard_words, _cut, "text string, left boolean").where("left")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


ORACLE = r"""
WITH low AS (SELECT doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, 0 AS item FROM documents
             UNION ALL SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 1 FROM benchmark),
w AS (SELECT id, item, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
p AS (SELECT DISTINCT id, array_to_string(w[i:i + n - 1], ' ') AS g, n FROM (SELECT id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM w WHERE item = 1 AND len(w) > 0)),
n AS (SELECT DISTINCT n FROM p),
g AS (SELECT id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, n WHERE item = 0 AND len(w) >= n)),
h AS (SELECT g.id, g.i, g.n, p.id AS item_id FROM g JOIN p USING (g, n)),
c AS (SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY id),
m AS (SELECT id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT id, item_id FROM h) GROUP BY id)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON w.id = c.id LEFT JOIN m ON w.id = m.id WHERE item = 0
"""
