"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its word shingles; documents with equal sets are one
class.  Shingles are counted over all classes in shards of an inverted index:
a list that only one class is on can match nothing and ends there.  A class
orders its other shingles by the length of their lists; it can only have a
partner if one of its ``n // 5 + 1`` shortest lists (at the default 80 percent)
is shared, since a partner is on at least ceil(0.8 n) of the n lists.

The classes on a short list form a family named after one of them.  Inside a
family the T-occurrence search runs: the short lists of a query are heap-merged,
classes that reach the count still needed there are binary-probed on the long
lists (DivideSkip), and those that reach the overlap are linked.  Classes that
are linked already are not searched again, so a family gives a spanning forest
of its links, never its pairs.  A family of more than ``family_rows`` classes is
first compared with its name-giver; only classes that are not linked to it
remain queries, and queries and members are dealt out in pieces of
``family_rows``.  Connected components come from alternating star contraction.

Shingles and index entries are 64-bit hashes.  Edge cases: null, empty and
wordless texts have an empty set and link with nothing; fewer words than a
shingle are one shingle; a text of any length is one set, held by one task; lists
of equal length are ordered by their hash; equal rows are of one component; a
null doc_id counts as larger than all ids (component_id is null if no other id is
reachable); an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import U, as_bytes, lean, mixed, ngrams, saved, shuffle_partitions, slices, table, word_hashes

#: stands for a null doc_id; real ids are smaller
NO_ID = 1 << 62
POSTINGS = "group long, shard int, key binary, at binary, doc_id binary, doc_node binary, doc_n binary"
SHARED = "group long, shard int, key binary, at binary, level binary, doc_id binary, doc_node binary, doc_n binary"


def shingles(text: bytes, k: int) -> np.ndarray:
    """Hashes of the distinct k-word shingles of a text, sorted."""
    h = word_hashes(text.lower().split())  # bytes: A-Z and ASCII spaces only
    return np.unique(ngrams(h, min(k, len(h)))) if len(h) else np.empty(0, U)


def class_of(s: np.ndarray) -> int:
    """A hash of the set, whatever the order."""
    with np.errstate(over="ignore"):
        return int(mixed(np.array([mixed(s).sum(dtype=U) + U(len(s))]))[0].astype(np.int64))


def _batch(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds, fields = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}, [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], names=[x[0] for x in fields])


def _postings(k: int, shards: int, group_words: int):
    """Per group of documents and shard the entries of the inverted index, ten bytes each; and once the documents of the group (key is null)."""

    def packed(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        doc, node, n = np.array(ids, np.int64), np.array([class_of(s) if len(s) else 0 for s in sets], np.int64), np.array([len(s) for s in sets], np.uint32)
        group = int(np.array(xxhash.xxh3_64_intdigest(doc.tobytes() + node.tobytes()), U).astype(np.int64))  # the same when a task runs again
        rows = [{"group": group, "shard": group % shards, "doc_id": doc.tobytes(), "doc_node": node.tobytes(), "doc_n": n.tobytes()}]
        _, first = np.unique(node, return_index=True)  # copies in the group count once
        first = np.sort(first[n[first] > 0])
        if len(first):
            h, at = np.concatenate([sets[i] for i in first]), np.repeat(first, n[first]).astype(np.uint16)
            shard = ((h >> U(32)) * U(shards)) >> U(32)
            by = np.argsort(shard.astype(np.uint16 if shards <= 1 << 16 else np.int64), kind="stable")
            key, at = h[by], at[by]
            held, first = np.unique(shard[by], return_index=True)  # only shards that the group has entries for
            rows += [{"group": group, "shard": s, "key": key[a:b].tobytes(), "at": at[a:b].tobytes()} for s, a, b in zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(key)], strict=True)]
        return _batch(POSTINGS, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, words = [], [], 0
        for b in slices(batches):
            for doc, text in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text")), strict=True):
                ids.append(doc)
                sets.append(shingles(text, k))
                words += len(sets[-1])
                if words >= group_words or len(ids) >= 50_000:  # a place in a group is two bytes
                    yield packed(ids, sets)
                    ids, sets, words = [], [], 0
        if ids:
            yield packed(ids, sets)

    return run


def _count(t: pa.Table) -> pa.Table:
    """One shard of the index: entries whose list holds two classes or more, with the length of the list.

    A class that stands in several groups is counted in each: lengths only give an order that all classes share.
    """
    rows = t.to_pylist()
    out, rows = [r for r in rows if r["key"] is None], [r for r in rows if r["key"] is not None]
    if rows:
        key = np.concatenate([np.frombuffer(r["key"], U) for r in rows])
        _, place, length = np.unique(key, return_inverse=True, return_counts=True)
        length = length[place]
        level = np.where(length <= 200, length, 200 + np.log2(length).astype(np.int64)).astype(np.uint8)
        edge = np.cumsum([0] + [len(r["key"]) // 8 for r in rows])
        for r, a, b in zip(rows, edge[:-1], edge[1:], strict=True):
            keep = length[a:b] > 1
            if keep.any():
                out.append({"group": r["group"], "shard": r["shard"], "key": key[a:b][keep].tobytes(), "at": np.frombuffer(r["at"], np.uint16)[keep].tobytes(), "level": level[a:b][keep].tobytes()})
    return pa.Table.from_batches([_batch(SHARED, out)])


SETS = "group long, node long, n int, short int, keys array<long>, doc_id binary, doc_node binary, doc_n binary"


def _sets(percent: int):
    """The classes of a group that can have a partner: their index entries by length of list, and how many of the first are short lists; and the documents."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        heads, rows = [r for r in rows if r["key"] is None], [r for r in rows if r["key"] is not None]
        node, size = np.frombuffer(heads[0]["doc_node"], np.int64), np.frombuffer(heads[0]["doc_n"], np.uint32).astype(np.int64)
        read = lambda name, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(r[name], kind) for r in rows)])
        key, at, level = read("key", np.int64), read("at", np.uint16).astype(np.int64), read("level", np.uint8)
        if len(heads) > 1:  # groups of the very same documents
            _, once = np.unique(np.stack((at, key)), axis=1, return_index=True)
            at, key, level = at[once], key[once], level[once]
        shared = np.bincount(at, minlength=len(node))
        short = size - (size * percent + 99) // 100 + 1 - (size - shared)  # lists of one class are the shortest
        live = short[at] > 0
        at, key, level = at[live], key[live], level[live]
        by, who = np.lexsort((key, level, at)), np.flatnonzero((short > 0) & (shared > 0))
        offsets = np.concatenate(([0], np.cumsum(shared[who])))
        n, h = len(who), len(heads)
        keys = pa.ListArray.from_arrays(pa.array(np.concatenate((offsets, np.full(h, offsets[-1]))), pa.int32()), pa.array(key[by]))
        pad = lambda x, kind: pa.array([*x.tolist(), *[None] * h], kind)
        head = lambda c: pa.array([None] * n + [r[c] for r in heads], pa.binary())
        return pa.Table.from_arrays([pa.array([heads[0]["group"]] * (n + h), pa.int64()), pad(node[who], pa.int64()), pad(size[who], pa.int32()), pad(short[who], pa.int32()), keys, *map(head, ("doc_id", "doc_node", "doc_n"))], names=[x.split()[0] for x in SETS.split(", ")])

    return run


def _root(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def divide_skip(n: list[int], keys: list[np.ndarray], indexed: list[bool], query: list[bool], linked: list[bool], percent: int, mu: float = 0.0085) -> list[tuple[int, int]]:
    """Links (i, j) that join the sets into their components; sets with linked are of one component from the start."""
    size, up = np.array(n), list(range(len(n)))
    known = [i for i, x in enumerate(linked) if x]
    for i in known[1:]:
        up[i] = known[0]
    parts, links = len(n) - max(0, len(known) - 1), []
    docs = np.flatnonzero(indexed)
    if not len(docs):  # a piece of a hot family can be empty
        return links
    word, place = np.unique(np.concatenate([keys[i] for i in docs]), return_inverse=True)
    member = np.repeat(docs, [len(keys[i]) for i in docs])
    by = np.argsort(place, kind="stable")  # members of a list are in ascending order
    entry, member = place[by] * len(n) + member[by], member[by]
    edge = np.searchsorted(place[by], np.arange(len(word) + 1))
    for q in sorted(np.flatnonzero(query), key=lambda i: -n[i]):
        if parts == 1:
            break
        need = (n[q] * percent + 99) // 100  # a partner is on as many lists of the query at least
        own = np.searchsorted(word, keys[q])
        own = own[word[np.minimum(own, len(word) - 1)] == keys[q]]
        if len(own) < need:
            continue
        length = edge[own + 1] - edge[own]
        n_long = min(need - 1, int(need / (mu * np.log2(max(2, length.max())) + 1)))
        own = own[np.argsort(length, kind="stable")]
        short, long = own[: len(own) - n_long], own[len(own) - n_long :]
        seen = {c: sum(1 for _ in g) for c, g in groupby(heapq.merge(*(member[edge[w] : edge[w + 1]].tolist() for w in short)))}
        mine = _root(up, q)
        found = np.array([c for c, times in seen.items() if times >= need - n_long and _root(up, c) != mine], np.int64)
        found = found[(size[found] * 100 >= size[q] * percent) & (size[q] * 100 >= size[found] * percent)]
        for i in range(0, len(found), 512):
            some = found[i : i + 512]
            probe = long[None, :] * len(n) + some[:, None]
            at = np.minimum(np.searchsorted(entry, probe), len(entry) - 1)
            overlap = (entry[at] == probe).sum(1) + np.array([seen[c] for c in some.tolist()])
            for c in some[overlap * (100 + percent) >= percent * (size[some] + size[q])].tolist():
                a, b = _root(up, q), _root(up, c)
                if a != b:
                    up[a] = b
                    parts -= 1
                    links.append((int(q), c))
    return links


def _search(percent: int):
    def run(t: pa.Table) -> pa.Table:
        keys = [np.asarray(x.values) for x in t.column("keys")]
        links = divide_skip(t.column("n").to_pylist(), keys, t.column("indexed").to_pylist(), t.column("query").to_pylist(), t.column("linked").to_pylist(), percent)
        node = t.column("node").to_pylist()
        return pa.Table.from_arrays([pa.array([node[i] for i, _ in links], pa.int64()), pa.array([node[j] for _, j in links], pa.int64())], names=["a", "b"])

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for group, ids, node, n in zip(*(b.column(c).to_pylist() for c in ("group", "doc_id", "doc_node", "doc_n")), strict=True):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.frombuffer(node, np.int64)), pa.array(np.frombuffer(n, np.uint32).astype(np.int64)), pa.array(np.full(len(ids), group))], names=["id", "node", "n_shingles", "group"])


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for the nodes of edges(a long, b long): alternating large and small stars."""
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now = state(e)
    while now[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("k")).agg(F.least("k", F.min("b")).alias("m"))
        large = both.join(low, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = saved(small.where("a <> b").distinct(), "edges")
        before, now = now, state(e)
        if now == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("label"))


def class_links(sets: DataFrame, percent: int, family_rows: int) -> DataFrame:
    """Links a, b between classes of sets(node, n, short, keys) that join them into their components."""
    spark = sets.sparkSession
    lists = sets.select("node", F.explode(F.slice("keys", 1, F.col("short"))).alias("x"))
    named = lists.groupBy(F.col("x").alias("k")).agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("family")))["family"].alias("family")).where("c > 1")
    members = saved(lists.join(named, F.col("x") == F.col("k")).select("family", "node").distinct(), "families")
    size = members.groupBy(F.col("family").alias("f")).agg(F.count("*").alias("rows")).where("rows > 1")
    members = members.join(size, F.col("family") == F.col("f")).select("family", "node", "rows")
    whole = saved(members.join(sets.select(F.col("node").alias("id"), "n", "keys"), F.col("node") == F.col("id")).drop("id"), "members")  # the sets move once

    # a hot family: against the one that names it first
    many = whole.where(f"rows > {family_rows}")
    head = many.where("family = node").select(F.col("family").alias("f"), F.col("n").alias("n0"), F.col("keys").alias("keys0"))
    overlap = F.size(F.array_intersect("keys", "keys0"))
    hot = many.join(head, F.col("family") == F.col("f")).select("family", "node", (overlap * (100 + percent) >= percent * (F.col("n") + F.col("n0"))).alias("linked"))
    hot = saved(hot, "hot")
    strays = hot.where("NOT linked").groupBy(F.col("family").alias("f")).agg(F.count("*").alias("strays"))
    pieces = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / family_rows)).cast("int")
    dealt = hot.join(strays, F.col("family") == F.col("f")).join(size.select(F.col("f").alias("g"), "rows"), F.col("family") == F.col("g"))
    dealt = dealt.withColumns({"qs": pieces("strays"), "ds": pieces("rows")}).withColumns({"q": F.pmod(F.xxhash64(F.lit(1), "node"), F.col("qs")).cast("int"), "d": F.pmod(F.xxhash64(F.lit(2), "node"), F.col("ds")).cast("int")})
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    as_doc = dealt.select("family", "node", "linked", every("qs").alias("q"), "d", F.lit(True).alias("indexed"), F.lit(False).alias("query"))
    as_query = dealt.where("NOT linked").select("family", "node", "linked", "q", every("ds").alias("d"), F.lit(False).alias("indexed"), F.lit(True).alias("query"))
    tasks = as_doc.unionByName(as_query).groupBy("family", "q", "d", "node").agg(F.max("linked").alias("linked"), F.max("indexed").alias("indexed"), F.max("query").alias("query"))
    tasks = tasks.join(many.select(F.col("family").alias("f"), F.col("node").alias("id"), "n", "keys"), (F.col("family") == F.col("f")) & (F.col("node") == F.col("id"))).drop("f", "id")
    small = whole.where(f"rows <= {family_rows}").select("family", F.lit(0).alias("q"), F.lit(0).alias("d"), "node", F.lit(False).alias("linked"), F.lit(True).alias("indexed"), F.lit(True).alias("query"), "n", "keys")
    searched = small.unionByName(tasks.select(small.columns)).repartition(4 * shuffle_partitions(spark), "family", "q", "d")  # work isn't in proportion to bytes
    found = searched.groupBy("family", "q", "d").applyInArrow(lean(_search(percent)), "a long, b long")
    return saved(found.unionByName(hot.where("linked AND family <> node").select(F.col("family").alias("a"), F.col("node").alias("b"))), "links")


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, shard_words: int = 1_000_000, group_words: int = 600_000, family_rows: int = 512) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text); rows link when 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string"))
    words = (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // 6
    shards = max(shuffle_partitions(spark), words // shard_words + 1)
    index = rows.mapInArrow(_postings(shingle, shards, group_words), POSTINGS).groupBy("shard").applyInArrow(lean(_count), SHARED)
    index = saved(index.groupBy("group").applyInArrow(lean(_sets(percent)), SETS), "index")
    documents = index.where("doc_id IS NOT NULL").select("group", "doc_id", "doc_node", "doc_n").mapInArrow(_documents, "id long, node long, n_shingles long, group long")
    classes = saved(documents.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("least"), F.min("group").alias("owner"), F.max("group").alias("last")), "classes")
    copies = classes.where("owner < last").select(F.col("node").alias("of"), "owner")  # of a class that stands in several groups one counts
    sets = index.where("node IS NOT NULL").select("group", "node", "n", "short", "keys")
    sets = saved(sets.join(copies, (F.col("node") == F.col("of")) & (F.col("group") != F.col("owner")), "left_anti").drop("group"), "sets")
    links = class_links(sets, percent, family_rows)
    label = components(links).withColumnRenamed("node", "member")
    group = classes.join(label, F.col("node") == F.col("member"), "left").select(F.col("node").alias("of"), F.coalesce("label", "node").alias("group"), "least")
    group = saved(group, "groups")
    lowest = group.groupBy(F.col("group").alias("g")).agg(F.min("least").alias("lowest"))
    group = group.join(lowest, F.col("group") == F.col("g")).select("of", "lowest")
    found = F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("id"))
    shown = lambda c: F.when(c != NO_ID, c)
    return documents.join(group, (F.col("node") == F.col("of")) & (F.col("n_shingles") > 0), "left").select(shown(F.col("id")).alias("doc_id"), "n_shingles", shown(found).alias("component_id"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """docs without near duplicates, with all columns: of each component the row with the smallest doc_id stays.

    Repeated rows (equal doc_id and text) become one; rows without a doc_id fall to nothing else.
    """
    found = jaccard_components(docs, **settings)
    gone = saved(found.where("n_shingles > 0 AND doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.id"))
    kept = docs.alias("d").join(gone.alias("g"), same, "left_anti")
    twice = saved(docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if twice.isEmpty():
        return kept
    once, more = (kept.alias("d").join(twice.alias("g"), same, how) for how in ("left_anti", "left_semi"))
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id
"""
