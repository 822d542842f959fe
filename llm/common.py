"""Helpers that several operators share: shared folders, row keys, word hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_M = U(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set to a temporary one only where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="llm-shared-")  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(where)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text and a row key (k1, k2) that is never null; rows with equal keys have equal id and text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("k1"),
        F.xxhash64("text").alias("k2"),
        *extra,
    )


def let(value: Column, body) -> Column:
    """Bind an expression to a lambda variable so that it is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def give_back() -> None:
    """Free memory of a Python worker goes back to the machine: workers wait for the next stage beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f over groups, giving memory back after large ones."""

    @functools.wraps(f)
    def run(t: pa.Table) -> pa.Table:
        large = t.nbytes > 1 << 22
        out = f(t)
        if large:
            del t
            give_back()
        return out

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most; when they end, memory is given back."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that their order is as good as random."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, by doubling."""
    if len(h) < k:
        return np.empty(0, U)
    out, done, power, step, a = None, 0, h, 1, int(_M)
    while True:
        m = U(a)
        if k & step:
            if out is None:
                out, done = power, step
            else:
                n = min(len(out), len(power) - done)
                out, done = out[:n] * m + power[done : done + n], done + step
        if done == k:
            return mixed(out + U(k))
        power = power[:-step] * m + power[step:]
        a = (a * a + 2 * step) % (1 << 64) | 1
        step *= 2


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of [start, end) intervals."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out
