"""Stateful processors over streams of frames: the latest frame, running folds, sessions that end by timer.

Rows of a stream arrive in order between micro-batches; inside one they are put
in order of time and frame.  A processor's state is one row for each stream.

Frames don't go to the processors as rows: the task that reads them packs those
of a stream that it has at hand into one row, with lists in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def by_stream(batches: Iterator[pa.RecordBatch], order: list[str], one: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch in order of stream and what else is named, handed to one with the row numbers at which a stream begins and, last, the number of rows."""
    for b in batches:
        if len(b):
            rows = pa.Table.from_batches([b]).sort_by([(c, "ascending") for c in ("stream", *order)]).combine_chunks()
            kind = rows.column("stream").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            yield one(rows, np.array([0, *(np.flatnonzero(np.diff(kind)) + 1), len(kind)]))


def packs(frames: DataFrame, order: list[str], lists: dict[str, str]) -> DataFrame:
    """A row with the columns of lists (name: type, times as microseconds) as lists, for the frames of a stream in each batch of a task."""

    def one(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(at, pa.int32())
        columns = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks().cast(pa.int64() if t == "long" else pa.float64())) for c, t in lists.items()]
        return pa.RecordBatch.from_arrays([rows.column("stream").combine_chunks().take(pa.array(at[:-1])), *columns], names=["stream", *lists])

    schema = ", ".join(["stream string", *(f"{c} array<{t}>" for c, t in lists.items())])
    return frames.select("stream", *dict.fromkeys([*order, *lists])).mapInArrow(lambda batches: by_stream(batches, order, one), schema)


class Latest(StatefulProcessor):
    """The newest frame of a stream and how many came: a frame overwrites the one before, wherever the reader is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "seen long, frame long, ts timestamp_ntz, brightness double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        new = [(r["ts"], r["frame"], r["brightness"], r["n"]) for r in rows]
        before = self.state.get()
        seen = (before[0] if before else 0) + sum(n for *_, n in new)
        ts, frame, brightness, _ = max(new, key=lambda r: r[:2])
        self.state.update((seen, frame, ts, brightness))
        yield Row(stream=key[0], seen=seen, frame=frame, brightness=brightness)

    def close(self) -> None:
        pass


class Folds(StatefulProcessor):
    """Count, mean, exponential average, best value and whether it has been too long since: the folds of a training loop, frame by frame."""

    def __init__(self, decay: float = 0.9999, tau: float = 50.0, patience: int = 10):
        self.decay, self.tau, self.patience = decay, tau, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("folds", "n long, total double, ema double, best double, best_at long, stopped_at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        n, total, ema, best, best_at, stopped_at = self.state.get() or (0, 0.0, 0.0, -math.inf, 0, None)
        for _, _, v in sorted((x for r in rows for x in zip(r["ts"], r["frame"], r["brightness"], strict=True)), key=lambda x: x[:2]):
            n, total = n + 1, total + v
            d = self.decay * (1 - math.exp(-n / self.tau))
            ema = ema * d + v * (1 - d)
            if v >= best:
                best, best_at = v, n
            if stopped_at is None and n - best_at >= self.patience:
                stopped_at = n
        self.state.update((n, total, ema, best, best_at, stopped_at))
        yield Row(stream=key[0], n=n, mean=total / n, ema=ema, best=best, best_at=best_at, stopped_at=stopped_at)

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """Runs of frames without a pause: a run ends when a later frame comes or, by timer, when the watermark has passed the pause."""

    def __init__(self, pause_ms: int):
        self.pause_ms = pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "first_us long, last_us long, frames long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        first, last, n = self.state.get() or (None, None, 0)
        for at in sorted(us for r in rows for us in r["us"]):
            if n and at - last > self.pause_ms * 1000:
                yield Row(stream=key[0], first_us=first, last_us=last, frames=n)
                n = 0
            first, last, n = (first if n else at), at, n + 1
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-last // 1000) + self.pause_ms)
        self.state.update((first, last, n))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802
        if self.state.exists():
            first, last, n = self.state.get()
            self.state.clear()
            yield Row(stream=key[0], first_us=first, last_us=last, frames=n)

    def close(self) -> None:
        pass


LATEST = "stream string, seen long, frame long, brightness double"
FOLDS = "stream string, n long, mean double, ema double, best double, best_at long, stopped_at long"
#: what Latest and Folds read: pixels don't have to come along
USED = ("stream", "frame", "ts", "brightness")
SESSIONS = "stream string, first_us long, last_us long, frames long"


def latest(frames: DataFrame) -> DataFrame:
    """Tasks send the newest frame of a stream in each batch and how many there were."""

    def one(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        last = rows.take(pa.array(at[1:] - 1)).combine_chunks()
        return last.append_column("n", pa.array(np.diff(at))).to_batches()[0]

    sent = frames.select(*USED).mapInArrow(lambda batches: by_stream(batches, ["ts", "frame"], one), "stream string, frame long, ts timestamp_ntz, brightness double, n long")
    return sent.groupBy("stream").transformWithState(Latest(), LATEST, "Update", "None")


def folds(frames: DataFrame, **settings: float) -> DataFrame:
    packed = packs(frames, ["ts", "frame"], {"ts": "long", "frame": "long", "brightness": "double"})
    return packed.groupBy("stream").transformWithState(Folds(**settings), FOLDS, "Update", "None")


def sessions(frames: DataFrame, pause_ms: int, lateness: str = "0 seconds") -> DataFrame:
    """frames carry us, their time in microseconds; the watermark follows the newest frame of a pack, so a pack is late only as a whole."""
    packed = packs(frames, ["us"], {"us": "long"})
    marked = packed.withColumn("time", F.timestamp_micros(F.element_at("us", -1))).withWatermark("time", lateness)
    return marked.groupBy("stream").transformWithState(Sessions(pause_ms), SESSIONS, "Append", "EventTime")


def run_to_end(frames: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that the source has now, into Parquet, and the timers that the watermark then has passed; rows of an update carry what they replace in their own count.

    A source without a limit for each batch would run as one batch under
    availableNow, without the batch that fires timers; so the query runs until
    nothing is left and is stopped.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    query = frames.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
