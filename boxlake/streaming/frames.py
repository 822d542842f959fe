"""Streams of frames: the latest frame per stream, strides, caps, timers, stateful averages.

Each function takes a batch or a streaming DataFrame unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_per_stream(frames: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The newest row of each stream: an update-mode aggregate with one row of state per stream."""
    newest = F.max_by(F.struct(*columns), order)
    return frames.groupBy(key).agg(F.max(order).alias(order), newest.alias("__r")).select(key, order, "__r.*")


def every_nth(frames: DataFrame, number: str, stride: int) -> DataFrame:
    """Frames whose number is a multiple of the stride."""
    return frames.where(F.col(number) % stride == 0)


def same_shape(frames: DataFrame) -> DataFrame:
    """Whether all streams have one shape: n_shapes, rectangular; frames hold width, height."""
    return frames.agg(F.count_distinct("width", "height").alias("n_shapes"), (F.count_distinct("width", "height") == 1).alias("rectangular"))


def capped_per_epoch(frames: DataFrame, epoch: str, key: str, cap: int = 16) -> DataFrame:
    """The first cap distinct keys of each epoch (batch): each task keeps cap rows before the shuffle."""
    w = Window.partitionBy(epoch).orderBy(key)
    return frames.select(epoch, key).distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def stage_timers(times: DataFrame) -> DataFrame:
    """Per stage number of images and mean and total time of times(stage, ms)."""
    return times.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.sum("ms"), 6).alias("total_ms"))


def windowed_counts(frames: DataFrame, time: str, key: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """An extension: rows per key and tumbling window, with a watermark that bounds the state of a stream."""
    return frames.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def stateful_mean(frames: DataFrame, key: str, value: str) -> DataFrame:
    """Running count and mean per key over micro-batches (streaming only)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [total / n if n else None]})

    kind = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, mean double", "n long, total double", "update", GroupStateTimeout.NoTimeout)
