"""Frames of video streams as a Spark data source, in batches and as a stream.

A clip is a run of frames of one stream in an Arrow file with a record batch for
each frame, so any frame can be read without those before it.  Clips lie one
after the other in reels, with an index at the end of each reel.  The name of a
reel says how many clips it holds and of which time:
``<number>_<digest>_<clips>_<first time>_<last time>.reel`` (microseconds since
1970).  So the driver lists reels, of which a call of `write_clips` leaves REELS
at most, and tasks read which clips are in them.  The number of a reel follows
from a clip's stream and first frame: clips that were written twice are in reels
of one number, where the newest counts.  Decoding of video containers is left to
whoever writes clips.

``spark.read.format("clips")`` reads every stride-th frame of each stream (frame
numbers start at 1); the stride picks record batches, others aren't read.
``spark.readStream.format("clips")`` has the time as its offset: a micro-batch is
what all streams recorded after the last offset, up to the newest clip or the
option `until`, and a restarted query goes on where its checkpoint says.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

REELS = 1024
SCHEMA = "stream string, frame long, ts timestamp_ntz, height int, width int, channels int, pixels binary"
ARROW = pa.schema([("stream", pa.string()), ("frame", pa.int64()), ("ts", pa.timestamp("us")), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary())])


INDEX = pa.schema([("stream", pa.string()), *((c, pa.int64()) for c in ("first", "frames", "start", "end", "bytes", "offset"))])


@dataclass(frozen=True)
class Clip:
    path: str
    stream: str
    first: int
    frames: int
    start: int
    end: int
    bytes: int
    offset: int


@dataclass(frozen=True)
class Reel:
    path: str
    number: str
    clips: int
    start: int
    end: int
    bytes: int
    written: int


class Clips(InputPartition):
    """Clips of one task, and the time that is asked for: after low, up to high."""

    def __init__(self, clips: list[Clip], low: int | None = None, high: int | None = None):
        self.clips, self.low, self.high = clips, low, high


class Reels(InputPartition):
    """Reels of one task, all of a number together, or a piece of the clips of one number; the task looks up the clips."""

    def __init__(self, reels: list[Reel], low: int | None = None, high: int | None = None, piece: int = 0, pieces: int = 1):
        self.reels, self.low, self.high, self.piece, self.pieces = reels, low, high, piece, pieces

    def clips(self, path: str) -> Clips:
        store, _ = fs.FileSystem.from_uri(path)
        out: list[Clip] = []
        for _, same in groupby(self.reels, lambda r: r.number):
            found = clips_in(store, list(same))
            out += found[self.piece * len(found) // self.pieces : (self.piece + 1) * len(found) // self.pieces]
        return Clips([c for c in out if asked_for(c, self.low, self.high)], self.low, self.high)


def asked_for(c: Clip | Reel, low: int | None, high: int | None) -> bool:
    return (low is None or c.end > low) and (high is None or c.start <= high)


def reels(path: str) -> list[Reel]:
    """The reels of a folder, by number."""
    store, root = fs.FileSystem.from_uri(path)
    out = []
    for f in store.get_file_info(fs.FileSelector(root)):
        if f.type == fs.FileType.File and f.base_name.endswith(".reel"):
            number, _, clips, start, end = f.base_name[: -len(".reel")].split("_")
            out.append(Reel(f.path, number, int(clips), int(start), int(end), f.size, f.mtime_ns or 0))
    return sorted(out, key=lambda r: (r.number, r.written, r.path))


def clips_in(store: fs.FileSystem, same: list[Reel]) -> list[Clip]:
    """Clips of the reels of one number, by stream and frame; of equal ones the newest."""
    newest = {}
    for r in same:
        with store.open_input_file(r.path) as file:
            (length,) = np.frombuffer(file.read_at(8, r.bytes - 8), "<i8")
            index = pa.ipc.open_stream(file.read_at(int(length), r.bytes - 8 - int(length))).read_all()
        for row in index.to_pylist():
            c = Clip(r.path, **row)
            newest[c.stream, c.first, c.frames, c.start, c.end] = c
    return [newest[k] for k in sorted(newest)]


def listed(path: str) -> list[Clip]:
    """All clips of a folder, by stream and frame; for small folders, as sources leave this to their tasks."""
    store, _ = fs.FileSystem.from_uri(path)
    found = [c for _, same in groupby(reels(path), lambda r: r.number) for c in clips_in(store, list(same))]
    return sorted(found, key=lambda c: (c.stream, c.first))


def dealt(known: list[Reel], low: int | None, high: int | None, most: int) -> list[Reels]:
    """Reels packed into tasks of about so many bytes; larger ones are dealt out in pieces."""
    out: list[Reels] = []
    open_: list[Reel] = []
    for _, group in groupby((r for r in known if asked_for(r, low, high)), lambda r: r.number):
        same = list(group)
        size = sum(r.bytes for r in same)
        if size > most:
            pieces = min(-(-size // most), sum(r.clips for r in same))
            out += [Reels(same, low, high, i, pieces) for i in range(pieces)]
            continue
        if sum(r.bytes for r in open_) + size > most:
            out.append(Reels(open_, low, high))
            open_ = []
        open_ = open_ + same
    return [*out, Reels(open_, low, high)] if open_ else out


class Section:
    """A clip in its reel as a file."""

    closed = False

    def __init__(self, file: pa.NativeFile, clip: Clip):
        self.file, self.clip, self.at = file, clip, 0

    def read(self, n: int = -1) -> bytes:
        n = self.clip.bytes - self.at if n < 0 else min(n, self.clip.bytes - self.at)
        out = self.file.read_at(n, self.clip.offset + self.at)
        self.at += len(out)
        return out

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = to + (0, self.at, self.clip.bytes)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def close(self) -> None:
        pass


def frames_of(part: Clips, path: str, stride: int, bytes_at_once: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The frames of a task; those of several clips go into one batch, as Spark takes each batch by itself."""
    store, _ = fs.FileSystem.from_uri(path)
    held: list[pa.RecordBatch] = []
    size = 0
    for reel, clips in groupby(part.clips, lambda c: c.path):
        with store.open_input_file(reel) as file:
            for c in clips:
                whole = stride == 1 and c.bytes <= bytes_at_once
                source = pa.BufferReader(file.read_at(c.bytes, c.offset)) if whole else pa.PythonFile(Section(file, c), mode="r")
                with pa.ipc.open_file(source) as clip:
                    for n in range(-(-c.first // stride) * stride, c.first + c.frames, stride):
                        held += clip.read_all().to_batches() if whole else [clip.get_batch(n - c.first)]
                        size += c.bytes if whole else held[-1].nbytes
                        if size >= bytes_at_once:
                            yield from asked(held, part)
                            held, size = [], 0
                        if whole:
                            break
    yield from asked(held, part)


def asked(frames: list[pa.RecordBatch], part: Clips) -> list[pa.RecordBatch]:
    """Frames in the time of a task, as one batch."""
    if not frames:
        return []
    rows = pa.Table.from_batches(frames).combine_chunks()  # first: what follows takes its time for each chunk
    at = rows.column("ts").cast(pa.int64())
    for limit, holds in ((part.low, pc.greater), (part.high, pc.less_equal)):
        if limit is not None:
            keep = holds(at, limit)
            rows, at = rows.filter(keep), at.filter(keep)
    return rows.combine_chunks().to_batches()


class ClipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.stride, self.most = options["path"], int(options.get("stride", 1)), int(options.get("maxpartitionbytes", 16 << 20))

    def partitions(self) -> list[Reels]:
        return dealt(reels(self.path), None, None, self.most) or [Reels([])]

    def read(self, partition: Reels) -> Iterator[pa.RecordBatch]:
        return frames_of(partition.clips(self.path), self.path, self.stride)


class ClipStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.stride, self.most = options["path"], int(options.get("stride", 1)), int(options.get("maxpartitionbytes", 16 << 20))
        self.until = int(options["until"]) if "until" in options else None

    def initialOffset(self) -> dict:
        return {"time": -(1 << 62)}

    def latestOffset(self) -> dict:
        newest = max((r.end for r in reels(self.path)), default=-(1 << 62))
        return {"time": newest if self.until is None else min(newest, self.until)}

    def partitions(self, start: dict, end: dict) -> list[Reels]:
        return dealt(reels(self.path), start["time"], end["time"], self.most) or [Reels([])]

    def read(self, partition: Reels) -> Iterator[pa.RecordBatch]:
        return frames_of(partition.clips(self.path), self.path, self.stride)

    def commit(self, end: dict) -> None:
        """Clips stay where they are."""


class ClipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clips"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ClipReader:
        return ClipReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> ClipStreamReader:
        return ClipStreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ClipSource)


class ReelWriter:
    """One reel being written; it gets its name when it is whole."""

    def __init__(self, store: fs.FileSystem, root: str, number: int):
        self.store, self.root, self.number, self.index = store, root, number, []
        store.create_dir(root)
        self.part = f"{root}/.{uuid.uuid4().hex}"
        self.file = store.open_output_stream(self.part)

    def put(self, held: list[pa.RecordBatch]) -> None:
        at = np.concatenate([b.column("ts").cast(pa.int64()).to_numpy() for b in held])
        number = np.concatenate([b.column("frame").to_numpy() for b in held])
        stream = str(held[0].column("stream")[0].as_py())
        if (np.diff(number) != 1).any():
            raise ValueError(f"frames of stream {stream} aren't numbered without gaps")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, ARROW) as clip:
            for b in held:
                clip.write_table(pa.Table.from_batches([b]), max_chunksize=1)
        data = sink.getvalue()
        self.index.append((stream, int(number[0]), len(number), int(at.min()), int(at.max()), data.size, self.file.tell()))
        self.file.write(data)

    def close(self) -> None:
        columns = list(zip(*self.index, strict=True))
        table = pa.table([pa.array(c, f.type) for c, f in zip(columns, INDEX, strict=True)], schema=INDEX)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, INDEX) as out:
            out.write_table(table)
        data = sink.getvalue()
        self.file.write(data)
        self.file.write(np.array([data.size], "<i8").tobytes())
        self.file.close()
        digest = hashlib.sha256(repr([row[:5] for row in self.index]).encode()).hexdigest()[:20]
        self.store.move(self.part, f"{self.root}/{self.number:04d}_{digest}_{len(self.index)}_{min(columns[3])}_{max(columns[4])}.reel")


def write_clips(frames: DataFrame, path: str, frames_per_clip: int = 512) -> int:
    """Clips of frames(stream, frame, ts, height, width, channels, pixels), and how many frames they hold.

    Frames of a stream are numbered from 1 without gaps.  A task writes its reels
    one after the other and holds the frames of one clip; a reel gets its name
    when it is whole, so a repeated task only replaces it.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        held: list[pa.RecordBatch] = []
        reel: ReelWriter | None = None
        now, n = None, 0

        def flush(following: int | None) -> None:
            """The clip is whole; so is its reel, if the next clip is in another one."""
            nonlocal reel
            if held:
                reel = reel or ReelWriter(store, root, now[0])
                reel.put(held)
                held.clear()
                if following != now[0]:
                    reel.close()
                    reel = None

        for b in batches:
            if not len(b):
                continue
            number, stream, clip = b.column("__reel").to_numpy(), b.column("stream"), b.column("__clip").to_numpy()
            kind = stream.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero((np.diff(kind, prepend=kind[0]) != 0) | (np.diff(clip, prepend=clip[0]) != 0))
            rows = pa.RecordBatch.from_arrays([b.column(c).cast(ARROW.field(c).type) for c in ARROW.names], schema=ARROW)
            for i, k in zip([0, *begins], [*begins, len(b)], strict=True):
                if (key := (int(number[i]), stream[i].as_py(), clip[i])) != now:
                    flush(key[0])
                    now = key
                held.append(rows.slice(i, k - i))
            n += len(b)
        flush(None)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    clip = F.floor((F.col("frame") - 1) / frames_per_clip).alias("__clip")
    # by first frame, as clips of another length are other clips
    reel = F.pmod(F.xxhash64("stream", F.col("__clip") * frames_per_clip + 1), F.lit(REELS)).cast("long").alias("__reel")
    sorted_ = frames.select(*ARROW.names, clip).select("*", reel).repartition("__reel").sortWithinPartitions("__reel", "stream", "frame")
    return sorted_.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
