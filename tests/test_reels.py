"""Clips in reels: what the driver sees of them, and clips that are written again; frames of a stream in one row."""

import datetime as dt
import os
import pickle

from boxlake.sources import clips
from boxlake.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


def frames(spark, spec, start=T0):
    rows = [(s, i, start + dt.timedelta(minutes=i), 1, 2, 1, bytes([i % 256, 7])) for s, n in spec.items() for i in range(1, n + 1)]
    return spark.createDataFrame(rows, clips.SCHEMA)


def test_driver_sees_reels_and_not_clips(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clips, "REELS", 8)
    path = str(tmp_path / "clips")
    assert clips.write_clips(frames(spark, {f"s{i}": 12 for i in range(150)}), path, 2) == 1800
    assert len(clips.listed(path)) == 900 and len(os.listdir(path)) <= 8 + sum(f.endswith(".crc") for f in os.listdir(path))
    stream = clips.ClipStreamReader({"path": path})
    assert stream.latestOffset() == {"time": max(c.end for c in clips.listed(path))}
    for parts in (clips.ClipReader({"path": path}).partitions(), stream.partitions(stream.initialOffset(), stream.latestOffset())):
        assert len(pickle.dumps(parts)) < 8 * 400
        assert sum(c.frames for p in parts for c in p.clips(path).clips) == 1800
    pieces = clips.ClipReader({"path": path, "maxpartitionbytes": "10000"}).partitions()
    assert len(pieces) > 8 and sorted((c.stream, c.first) for p in pieces for c in p.clips(path).clips) == [(c.stream, c.first) for c in clips.listed(path)]


def test_clips_written_again_among_others_count_once(spark, tmp_path):
    clips.register(spark)
    path = str(tmp_path / "clips")
    for spec in ({"a": 8, "b": 4}, {"a": 8, "b": 4, "c": 6, "d": 2}):
        clips.write_clips(frames(spark, spec).repartition(5), path, 4)
    got = [(r.stream, r.frame) for r in spark.read.format("clips").load(path).collect()]
    assert sorted(got) == [(s, i) for s, n in {"a": 8, "b": 4, "c": 6, "d": 2}.items() for i in range(1, n + 1)]


def test_times_before_1970(spark, tmp_path):
    clips.register(spark)
    path = str(tmp_path / "clips")
    clips.write_clips(frames(spark, {"a": 5}, dt.datetime(1969, 5, 1)), path, 2)
    assert sorted(r.ts for r in spark.read.format("clips").load(path).collect()) == [dt.datetime(1969, 5, 1, 0, i) for i in range(1, 6)]


def test_frames_of_a_stream_go_to_its_state_in_one_row(spark):
    rows = [(s, dt.datetime(1970, 1, 1, microsecond=us), f, f / 2) for us, f in ((3, 4), (1, 2), (1, 1), (2, 3)) for s in ("b", None, "a")]
    df = spark.createDataFrame(rows, "stream string, ts timestamp_ntz, frame long, brightness double").coalesce(1)
    packed = stateful.packs(df, ["ts", "frame"], {"ts": "long", "frame": "long", "brightness": "double"}).collect()
    assert {r.stream: (r.ts, r.frame, r.brightness) for r in packed} == {s: ([1, 1, 2, 3], [1, 2, 3, 4], [0.5, 1.0, 1.5, 2.0]) for s in ("a", "b", None)} and len(packed) == 3


class Kept:
    """State and timers of one stream."""

    def __init__(self):
        self.value, self.timers = None, []

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


def test_sessions_go_on_over_packs(spark):
    p = stateful.Sessions(1)
    p.state = p.handle = Kept()
    out = list(p.handleInputRows(("s",), iter([{"us": [5000, 5500]}, {"us": [1000, 1900, 2800]}]), None))
    assert [tuple(r) for r in out] == [("s", 1000, 2800, 3)] and (p.state.value, p.state.timers) == ((5000, 5500, 2), [7])
    assert list(p.handleInputRows(("s",), iter([{"us": [6001]}]), None)) == [] and (p.state.value, p.state.timers) == ((5000, 6001, 3), [8])


def test_folds_go_on_over_packs(spark):
    p = stateful.Folds(patience=2)
    p.state = Kept()
    packs = [{"ts": [3, 4], "frame": [3, 4], "brightness": [7.0, 1.0]}, {"ts": [1, 1], "frame": [1, 2], "brightness": [2.0, 7.0]}]
    (r,) = p.handleInputRows(("s",), iter(packs), None)
    assert (r.n, r.mean, r.best, r.best_at, r.stopped_at) == (4, 4.25, 7.0, 3, None)
    (r,) = p.handleInputRows(("s",), iter([{"ts": [5], "frame": [5], "brightness": [6.0]}]), None)
    assert (r.n, r.best_at, r.stopped_at) == (5, 3, 5)
