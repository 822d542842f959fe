"""Substring dedup by Relative Lempel-Ziv parsing over a sharded reference.

The reference of a document is the text of all documents with smaller ids.  It
is cut into content-defined blocks: every window of ``window`` words is
assigned to its minimiser (the smallest ``anchor``-word hash in it), and the
consecutive windows of one minimiser form one block of at most
``2 * window - anchor`` words.  Equal passages are cut alike wherever they
stand, and equal windows lie in blocks of one minimiser, so blocks and documents
meet by that hash alone.

Parsing is greedy.  A block that an earlier document holds in full is one
factor, however many copies exist: the index of blocks is a plain aggregate,
block hash -> smallest document id.  Any other block whose minimiser several
block texts share is parsed against all reference blocks of that minimiser that
begin in earlier documents: the window at the current place is looked up, the
match is extended word by word to the longest one in its reference block, a
factor of ``window`` words or more becomes a duplicate span, and the parse goes
on at the factor's boundary, with the first window that it doesn't hold.
Adjoining factors merge, across blocks too.  Every window is inside a factor or
was looked up itself, so none is missed.

Minimisers with more than ``hot_blocks`` block texts aren't parsed in one group:
the windows of their blocks are joined to an index of windows, which is an
aggregate.  Blocks and minimisers that more than one in ``HOT`` rows has (so at
most ``HOT`` of each) are broadcast instead of being joined by a shuffle.

Edge cases: null, empty and short (fewer than ``window`` words) texts have no
windows; a null doc_id neither removes words nor is a source; rows with equal
doc_id never remove words of each other; equal rows get equal spans, gathered
once; of equal blocks the smallest doc_id is the source; a text of any length is
cut in pieces of PIECE windows; other columns of the input are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import U, as_bytes, keyed, merge_spans, mixed, ngrams, saved, shuffle_partitions, slices, table, word_hashes

#: windows handled at once within one text; positions must fit in 24 bits
PIECE = 1 << 20
#: a key that more than one in HOT rows has is hot
HOT = 10_000
#: blocks that are parsed in one call, about
PER_CALL = 20_000


def blocks_of(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Block hash, minimiser hash, first and last window of every block of a text, given its word hashes."""
    a, w = ngrams(h, anchor), ngrams(h, window)
    span, parts = window - anchor + 1, []
    for at in range(0, len(w), PIECE):
        n = min(PIECE, len(w) - at)
        low = (a[at : at + n + span - 1] & ~U(0xFFFFFF)) | np.arange(n + span - 1, dtype=U)
        width = 1
        while width * 2 <= span:  # minimum over runs of length width
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: n + width - width], low[span - width :][:n])
        low = low[:n]
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        last = np.append(first[1:], n) - 1
        place = (low[first] & U(0xFFFFFF)).astype(np.int64) + at
        first, last = first + at, last + at
        key = mixed(w[first] * U(0x9FB21C651E98DF25) + w[last] * U(0xD6E8FEB86659FD93) + (last - first).astype(U))
        parts.append((key, a[place], first, last))
    if not parts:
        none = np.empty(0, np.int64)
        return none.astype(U), none.astype(U), none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _cut(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, (doc, k2, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("k2").to_pylist(), as_bytes(b.column("text")), strict=True)):
                if doc is None or len(text) < 2 * window - 1:
                    continue
                block, low, first, last = blocks_of(word_hashes(text.split()), window, anchor)
                k = len(block)
                for c, x in zip(cols, (np.full(k, doc), np.full(k, k2), block.view(np.int64), low.view(np.int64), first.astype(np.int32), last.astype(np.int32)), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["doc_id", "k2", "block", "anchor", "first", "last"])

    return run


def _windows(window: int):
    """Hash of every window of the listed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for doc, k2, text, at in zip(b.column("doc_id").to_pylist(), b.column("k2").to_pylist(), as_bytes(b.column("text")), b.column("at").to_pylist(), strict=True):
                w = ngrams(word_hashes(text.split()), window)
                pos = np.unique(np.concatenate([np.arange(x["first"], x["last"] + 1) for x in at]))
                out.append((np.full(len(pos), doc), np.full(len(pos), k2), w[pos].view(np.int64), pos.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["doc_id", "k2", "window", "pos"])

    return run


def _spelled(window: int):
    """The word hashes of the listed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows: list[tuple] = []
            words: list[np.ndarray] = []
            for doc, k2, text, at in zip(b.column("doc_id").to_pylist(), b.column("k2").to_pylist(), as_bytes(b.column("text")), b.column("at").to_pylist(), strict=True):
                h = word_hashes(text.split())
                for x in at:
                    rows.append((x["anchor"], doc, k2, x["first"]))
                    words.append(h[x["first"] : x["last"] + window])
            if rows:
                offsets = np.cumsum([0, *map(len, words)], dtype=np.int32)
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(words).view(np.int64)))], names=["anchor", "doc_id", "k2", "first", "words"])

    return run


def parse(words: np.ndarray, start: int, end: int, keys: list[int], index: dict[int, tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Greedy factors [first window, last window] of the block words[start:end] whose windows have keys; index: window -> where it stands in a reference block, and where that ends."""
    out, at = [], 0
    while at < len(keys):
        found = index.get(keys[at])
        if found is None:
            at += 1
            continue
        here, there = start + at + window, found[0] + window
        room = min(end - here, found[1] - there)
        unlike = np.flatnonzero(words[here : here + room] != words[there : there + room])
        more = int(unlike[0]) if len(unlike) else room
        out.append((at, at + more))
        at += more + 1  # the factor's boundary: the next window that it doesn't hold
    return out


def _factored(window: int):
    """Factors of all blocks of some minimisers against the blocks of earlier documents."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        anchor, doc, k2, first = (t.column(c).to_numpy() for c in ("anchor", "doc_id", "k2", "first"))
        lists = t.column("words").chunk(0)
        words, edge = lists.values.to_numpy(), lists.offsets.to_numpy()
        hashes = ngrams(words.view(U), window).view(np.int64)
        out: list[tuple] = []
        index: dict[int, tuple[int, int]] = {}
        waiting: list[tuple[int, int, list[int]]] = []  # blocks of the document at hand: no reference of its own
        before = (None, None)
        for i in np.lexsort((first, k2, doc, anchor)).tolist():
            now = (anchor[i], doc[i])
            if now != before:
                if now[0] != before[0]:
                    index = {}
                else:
                    for a, e, keys in waiting:
                        for n, key in enumerate(keys):
                            index.setdefault(key, (a + n, e))
                waiting, before = [], now
            a, e = int(edge[i]), int(edge[i + 1])
            keys = hashes[a : e - window + 1].tolist()
            out += [(doc[i], k2[i], first[i] + x, first[i] + y) for x, y in parse(words, a, e, keys, index, window)]
            waiting.append((a, e, keys))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "k2", "first", "last"])

    return run


def _assemble(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, text, at in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text")), b.column("at").to_pylist(), strict=True):
                words = text.split()
                spans = merge_spans([(x["first"], x["last"] + window) for x in at or ()])
                kept, end = [], 0
                for s, e in spans:
                    kept += words[end:s]
                    end = e
                kept = kept + words[end:] if spans else words
                body = b" ".join(kept)
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), [{"start": s, "end": e} for s, e in spans], *([body.decode()] if with_text else [])))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"][: len(cols)])

    return run


def matched(rows: DataFrame, index: DataFrame, key: str, limit: int) -> DataFrame:
    """rows joined to index(of, n, ...) on key = of; keys with n > limit are broadcast: fewer than all rows / limit."""
    hot = F.broadcast(index.where(F.col("n") > limit))
    cold = rows.join(F.broadcast(index.where(F.col("n") > limit).select("of")), F.col(key) == F.col("of"), "left_anti")
    return rows.join(hot, F.col(key) == F.col("of")).unionByName(cold.join(index.where(F.col("n") <= limit), F.col(key) == F.col("of")))


def substring_dedup(docs: DataFrame, window: int = 50, anchor: int = 20, with_text: bool = False, hot_blocks: int = 5000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (word offsets) of every row of docs(doc_id, text); kept_text on request."""
    rows = keyed(docs)
    texts = rows.repartition("k1", "k2")  # one exchange of the texts, used by the joins below
    blocks = saved(rows.select("doc_id", "k2", "text").mapInArrow(_cut(window, anchor), "doc_id long, k2 long, block long, anchor long, first int, last int"), "blocks")
    limit = max(1, blocks.count() // HOT)

    # a minimiser that only one document has can give no factor: most blocks go here
    met = saved(blocks.groupBy(F.col("anchor").alias("of")).agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.count("*").alias("n")).where("d0 < d1").select("of", "n"), "met")
    blocks = saved(matched(blocks, met, "anchor", limit).drop("of", "n"), "shared-blocks")
    owner = blocks.groupBy("block").agg(F.min("doc_id").alias("owner"), F.min("anchor").alias("anchor"), F.count("*").alias("n"))
    texts_of = owner.groupBy("anchor").agg(F.count("*").alias("texts")).where("texts > 1").select(F.col("anchor").alias("shared"), "texts")
    index = saved(owner.join(texts_of, F.col("anchor") == F.col("shared"), "left").select(F.col("block").alias("of"), "owner", "texts", "n"), "index")
    parsed = matched(blocks, index, "block", limit).where("owner < doc_id OR texts > 1")
    parsed = saved(parsed.select("doc_id", "k2", "anchor", "first", "last", (F.col("owner") < F.col("doc_id")).alias("whole"), (F.col("texts") > hot_blocks).alias("hot")).distinct(), "parsed")

    def at(which: DataFrame) -> DataFrame:
        """The texts with the blocks of which: as many as the text has at most."""
        lists = which.groupBy("doc_id", "k2").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("at"))
        lists = lists.select(F.col("doc_id").alias("d1"), F.col("k2").alias("d2"), "at")
        once = texts.where("doc_id IS NOT NULL").join(lists, (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2")))
        return once.select("doc_id", "k2", "text", "at")

    unlike = parsed.where("NOT whole AND NOT hot")
    calls = max(shuffle_partitions(docs.sparkSession), unlike.count() // PER_CALL + 1)
    spelled = at(unlike).mapInArrow(_spelled(window), "anchor long, doc_id long, k2 long, first int, words array<long>").withColumn("call", F.pmod(F.xxhash64("anchor"), F.lit(calls)))
    factors = spelled.groupBy("call").applyInArrow(_factored(window), "doc_id long, k2 long, first int, last int")
    spans = parsed.where("whole").select("doc_id", "k2", "first", "last").unionByName(factors)

    very = parsed.where("NOT whole AND hot")
    if not very.isEmpty():
        looked = saved(at(very).mapInArrow(_windows(window), "doc_id long, k2 long, window long, pos int"), "windows")
        twice = saved(looked.groupBy(F.col("window").alias("of")).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("owner < most").drop("most"), "twice")
        found = matched(looked, twice, "window", max(1, looked.count() // HOT)).where("owner < doc_id")
        spans = spans.unionByName(found.select("doc_id", "k2", F.col("pos").alias("first"), F.col("pos").alias("last")))

    spans = spans.groupBy(F.col("doc_id").alias("d1"), F.col("k2").alias("d2")).agg(F.collect_set(F.struct("first", "last")).alias("at"))
    joined = texts.join(spans, (F.col("k1") == F.col("d1")) & (F.col("k2") == F.col("d2")), "left").select("doc_id", "text", "at")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"
    return joined.mapInArrow(_assemble(window, with_text), schema + (", kept_text string" if with_text else ""))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE first < doc_id),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM m),
r AS (SELECT doc_id, list(pos) AS gone FROM p GROUP BY doc_id),
t AS (SELECT doc_id, pos, w[pos] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d)),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.pos) AS body FROM t LEFT JOIN p ON t.doc_id = p.doc_id AND t.pos = p.pos WHERE p.pos IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
