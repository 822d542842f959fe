"""Linear recurrences over long series: exponential averages and digital filters as affine maps.

One step of such a series is an affine map of its state, and maps compose: a
stretch of a series is one map.  Rows are dealt by range of (series, order), so
a series of any length is many stretches and many short series share a task.
Each stretch is folded from rest by doubling (log2 n array operations, no step
for each sample), the maps of the stretches of a series are chained (one small
row for each stretch), and the stretches are then run from their true starts.

Rows without a value are left out.  Ties of order go by value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxlake.operators.scan import written


def numbered(df: DataFrame, key: str, order: str, value: str, rows_per_stretch: int = 100_000) -> DataFrame:
    """k, o, v, t, n and part: series, order, value, place from 0, length, and the stretch that holds the row."""
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / rows_per_stretch))
    laid = written(rows.repartitionByRange(parts, "k", "o").withColumn("part", F.spark_partition_id()))
    sizes = laid.groupBy("k", "part").agg(F.count("*").alias("c"))
    series = Window.partitionBy("k")  # one row for each stretch
    before = sizes.select("k", "part", F.coalesce(F.sum("c").over(series.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("c").over(series).alias("n"))
    place = F.row_number().over(Window.partitionBy("k", "part").orderBy("o", "v"))
    here = (laid.k.eqNullSafe(F.col("k2"))) & (laid.part == F.col("part2"))
    out = laid.withColumn("i", place).join(before.toDF("k2", "part2", "base", "n"), here)
    return out.select("k", "o", "v", (F.col("base") + F.col("i") - 1).alias("t"), "n", "part")


def chained(rows: DataFrame, summary: Callable[[pd.DataFrame], dict], chain: Callable[[list[dict]], list[np.ndarray]], run: Callable[[pd.DataFrame, np.ndarray], np.ndarray], backwards: bool = False) -> DataFrame:
    """rows(k, t, part, ...) with y: summary folds a stretch from rest, chain gives the starting states of all stretches of a series, run gives y of a stretch from its start."""
    kind = dict(rows.dtypes)["k"]
    up = not backwards

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t", ascending=up)
        s = summary(g)
        return pd.DataFrame({"k": [g["k"].iloc[0]], "part": [g["part"].iloc[0]], "n": [len(g)], "first": [s["first"]], "factor": [s.get("factor", 0.0)], "state": [np.asarray(s["state"], float)]})

    def carry(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part", ascending=up)
        return pd.DataFrame({"k": g["k"], "part": g["part"], "start": chain(g.to_dict("records"))})

    def play(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t", ascending=up)
        return g.assign(y=run(g, np.asarray(g["start"].iloc[0], float)))[[*names, "y"]]

    names = rows.columns
    maps = rows.groupBy("k", "part").applyInPandas(fold, f"k {kind}, part int, n long, first double, factor double, state array<double>")
    starts = maps.groupBy("k").applyInPandas(carry, f"k {kind}, part int, start array<double>").toDF("k2", "part2", "start")
    placed = rows.join(starts, rows.k.eqNullSafe(F.col("k2")) & (rows.part == F.col("part2"))).drop("k2", "part2")
    return placed.groupBy("k", "part").applyInPandas(play, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", y double")


def scan(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of the maps x -> a x + b from the first to each: factor and offset."""
    a, b = a.astype(float).copy(), b.astype(float).copy()
    step = 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]
        a[step:] *= a[:-step].copy()
        step *= 2
    return a, b


def running_ema(df: DataFrame, key: str, order: str, value: str, decay: float = 0.9999, tau: float = 2000.0) -> DataFrame:
    """key, order, place (from 0) and ema, which starts from 0: the decay is ramped up by 1 - exp(-t / tau) at the t-th row of a series."""

    def maps(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        d = decay * (1 - np.exp(-(g["t"].to_numpy(float) + 1) / tau))
        return scan(d, g["v"].to_numpy(float) * (1 - d))

    def summary(g: pd.DataFrame) -> dict:
        a, b = maps(g)
        return {"first": 0.0, "factor": a[-1], "state": [b[-1]]}

    def chain(parts: list[dict]) -> list[np.ndarray]:
        out, s = [], 0.0
        for p in parts:
            out.append(np.array([s]))
            s = p["factor"] * s + p["state"][0]
        return out

    def run(g: pd.DataFrame, start: np.ndarray) -> np.ndarray:
        a, b = maps(g)
        return a * start[0] + b

    rows = numbered(df, key, order, value).select("k", "o", "v", "t", "part")
    return chained(rows, summary, chain, run).select(F.col("k").alias(key), F.col("o").alias(order), F.col("t").alias("place"), F.col("y").alias("ema"))


def butterworth(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients b, a of a digital low-pass; cutoff is a share of the Nyquist frequency.  Poles on a circle, bilinear transform."""
    edge = 4 * np.tan(np.pi * cutoff / 2)
    poles = edge * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    a = np.real(np.poly((4 + poles) / (4 - poles)))
    b = np.poly(-np.ones(order)) * np.real(edge**order / np.prod(4 - poles))
    return b, a


class Filter:
    """A digital filter b, a (a[0] = 1) as a map of its delays: state -> matrix state + gain x, output b[0] x + state[0]."""

    def __init__(self, b: np.ndarray, a: np.ndarray):
        n = len(a) - 1
        self.b0 = float(b[0])
        self.matrix = np.eye(n, k=1)
        self.matrix[:, 0] -= a[1:]
        self.gain = b[1:] - a[1:] * b[0]
        self.rest = np.linalg.solve(np.eye(n) - self.matrix, self.gain)  # delays after 1 has come in for ever

    def states(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Delays after each sample."""
        s = np.outer(x, self.gain)
        s[0] += self.matrix @ start
        power, step = self.matrix, 1
        while step < len(s):
            s[step:] += s[:-step].copy() @ power.T
            power, step = power @ power, 2 * step
        return s

    def output(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        s = self.states(x, start)
        return self.b0 * x + np.concatenate([[start[0]], s[:-1, 0]])


def once(rows: DataFrame, f: Filter, backwards: bool = False) -> DataFrame:
    """rows(k, t, v, part) with y: v through the filter, as if its first value had always been there."""

    def summary(g: pd.DataFrame) -> dict:
        x = g["v"].to_numpy(float)
        return {"first": x[0], "state": f.states(x, np.zeros(len(f.gain)))[-1]}

    def chain(parts: list[dict]) -> list[np.ndarray]:
        out, s = [], f.rest * parts[0]["first"]
        for p in parts:
            out.append(s)
            s = np.linalg.matrix_power(f.matrix, int(p["n"])) @ s + np.asarray(p["state"], float)
        return out

    def run(g: pd.DataFrame, start: np.ndarray) -> np.ndarray:
        return f.output(g["v"].to_numpy(float), start)

    return chained(rows, summary, chain, run, backwards)


def both_ways(df: DataFrame, key: str, order: str, value: str, f: Filter, pad: int) -> DataFrame:
    """key, order, smooth: each series forward and backward through a filter, so that nothing is shifted.

    pad values beyond each end (or one less than the series has) mirror the
    series in its end points; they join the stretches of those ends.
    """
    rows = written(numbered(df, key, order, value))
    ends = rows.groupBy("k").agg(F.min_by("v", "t").alias("v0"), F.max_by("v", "t").alias("v1"), F.min("part").alias("p0"), F.max("part").alias("p1"))
    ends = ends.withColumnRenamed("k", "k2")
    reach = F.least(F.lit(pad), F.col("n") - 1)
    near = rows.where((F.col("t") <= reach) | (F.col("t") >= F.col("n") - 1 - reach)).join(ends, F.col("k").eqNullSafe(F.col("k2")))
    last = F.col("n") - 1
    head = near.where((F.col("t") >= 1) & (F.col("t") <= reach)).select("k", (-F.col("t")).alias("t"), (2 * F.col("v0") - F.col("v")).alias("v"), F.col("p0").alias("part"))
    tail = near.where((F.col("t") < last) & (F.col("t") >= last - reach)).select("k", (2 * last - F.col("t")).alias("t"), (2 * F.col("v1") - F.col("v")).alias("v"), F.col("p1").alias("part"))
    wide = rows.select("k", "t", "v", "part", "o", F.lit(True).alias("real"))
    for extra in (head, tail):
        wide = wide.unionByName(extra.withColumn("real", F.lit(False)), allowMissingColumns=True)
    there = written(once(wide, f).drop("v").withColumnRenamed("y", "v"))
    back = once(there, f, backwards=True).where("real")
    return back.select(F.col("k").alias(key), F.col("o").alias(order), F.col("y").alias("smooth"))


def shaped(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)))


def smooth_series(df: DataFrame, key: str, order: str, value: str, schema: str, strength: float = 0.2) -> DataFrame:
    """Forward and backward first-order low-pass of each series, so that nothing is shifted."""
    f = Filter(np.array([strength, 0.0]), np.array([1.0, strength - 1.0]))
    return shaped(both_ways(df, key, order, value, f, 0), schema)


def lowpass_series(df: DataFrame, key: str, order: str, value: str, schema: str, cutoff: float = 0.06, poles: int = 5) -> DataFrame:
    """Each series through a Butterworth low-pass forward and backward; the ends are mirrored in their points."""
    return shaped(both_ways(df, key, order, value, Filter(*butterworth(poles, cutoff)), 3 * (poles + 1)), schema)
