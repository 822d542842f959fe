"""Clips as a source, and stateful processors over restarts."""

import datetime as dt

import pandas as pd
import pyarrow as pa
import pytest
from boxlake.plans import streams
from boxlake.sources import clips
from boxlake.streaming import stateful
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def frames(spark, spec):
    """stream -> times in minutes."""
    rows = [(s, i, T0 + dt.timedelta(minutes=m), 1, 2, 1, bytes([i % 256, 7])) for s, times in spec.items() for i, m in enumerate(times, 1)]
    return spark.createDataFrame(rows, clips.SCHEMA)


@pytest.fixture
def recorded(spark, tmp_path):
    clips.register(spark)
    path = str(tmp_path / "clips")
    assert clips.write_clips(frames(spark, {"a/b ü": range(0, 100), "c": range(50, 57)}), path, 16) == 107
    return path


def test_batches(spark, recorded):
    rows = spark.read.format("clips").load(recorded).collect()
    assert len(rows) == 107 and {r.stream for r in rows} == {"a/b ü", "c"}
    third = spark.read.format("clips").option("stride", 3).load(recorded).collect()
    assert sorted(r.frame for r in third if r.stream == "a/b ü") == list(range(3, 100, 3)) and sorted(r.frame for r in third if r.stream == "c") == [3, 6]
    assert all(r.pixels == bytes([r.frame, 7]) for r in third)
    spread = spark.read.format("clips").option("maxPartitionBytes", 1).load(recorded)
    assert spread.rdd.getNumPartitions() == len(clips.listed(recorded)) == 8


def test_stride_skips_record_batches(recorded, monkeypatch):
    read = []
    opened = pa.ipc.open_file

    class Counting:
        def __init__(self, file):
            self.clip = opened(file)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def get_batch(self, i):
            read.append(i)
            return self.clip.get_batch(i)

    monkeypatch.setattr(pa.ipc, "open_file", Counting)
    part = clips.Clips([c for c in clips.listed(recorded) if c.stream == "c"])
    assert [b.column("frame")[0].as_py() for b in clips.frames_of(part, recorded, 4)] == [4] and read == [3]


def test_gaps_are_errors_and_writing_again_replaces(spark, tmp_path):
    good = frames(spark, {"s": range(5)})
    with pytest.raises(Exception, match="without gaps"):
        clips.write_clips(good.where("frame <> 3"), str(tmp_path / "bad"))
    for _ in range(2):
        clips.write_clips(good, str(tmp_path / "good"))
    clips.register(spark)
    assert spark.read.format("clips").load(str(tmp_path / "good")).count() == 5


def test_no_clips(spark, tmp_path):
    (tmp_path / "none").mkdir()
    clips.register(spark)
    assert spark.read.format("clips").load(str(tmp_path / "none")).count() == 0


def run(spark, path, where, fold, mode, *untils):
    for until in untils:
        reader = spark.readStream.format("clips")
        source = (reader if until is None else reader.option("until", until)).load(path)
        stateful.run_to_end(fold(source), str(where / "out"), str(where / "state"), mode)


def micros(minutes):
    return int((T0 - dt.datetime(1970, 1, 1)).total_seconds() + 60 * minutes) * 1_000_000


def test_stream_resumes_by_offset(spark, recorded, tmp_path):
    run(spark, recorded, tmp_path, lambda s: s.select("stream", "frame"), "append", micros(29), micros(29), micros(52), None)
    got = pd.DataFrame([tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("stream", "frame", "batch").collect()], columns=["stream", "frame", "batch"])
    assert len(got) == 107 and not got.duplicated(["stream", "frame"]).any()
    assert got[got.stream == "a/b ü"].groupby("batch").size().tolist() == [30, 23, 47]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, streams.ROCKS)
    yield
    spark.conf.unset(name)


def test_latest_and_folds_go_on_after_a_restart(spark, recorded, tmp_path, rocks):
    bright = lambda s: s.withColumn("brightness", F.pmod("frame", F.lit(10)).cast("double"))
    for name, fold in (("latest", stateful.latest), ("folds", lambda s: stateful.folds(s, patience=7))):
        (tmp_path / name).mkdir()
        run(spark, recorded, tmp_path / name, lambda s, fold=fold: fold(bright(s)), "update", micros(40), None)
    newest = {r.stream: r for r in spark.read.parquet(str(tmp_path / "latest/out")).orderBy("seen").collect()}
    assert (newest["a/b ü"].seen, newest["a/b ü"].frame, newest["c"].seen) == (100, 100, 7)
    last = {r.stream: r for r in spark.read.parquet(str(tmp_path / "folds/out")).orderBy("n").collect()}
    assert (last["a/b ü"].n, last["a/b ü"].best, last["a/b ü"].best_at, last["a/b ü"].stopped_at) == (100, 9.0, 99, 7 + 9)
    assert (last["c"].best_at, last["c"].stopped_at) == (7, None)


def test_sessions_end_by_a_later_frame_or_a_timer(spark, tmp_path, rocks):
    path = str(tmp_path / "clips")
    clips.register(spark)
    clips.write_clips(frames(spark, {"a": [0, 1, 2, 30, 31], "b": [0, 5, 9], "c": [58, 60]}), path, 2)

    def runs(s):
        return stateful.sessions(s.withColumns({"us": F.expr("unix_micros(CAST(ts AS TIMESTAMP))"), "time": F.col("ts").cast("timestamp")}), 10 * 60_000)

    run(spark, path, tmp_path, runs, "append", micros(15), None)
    got = {(r.stream, (r.first_us - micros(0)) // 60_000_000, (r.last_us - micros(0)) // 60_000_000, r.frames) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0, 2, 3), ("a", 30, 31, 2), ("b", 0, 9, 3)}


def test_frames_come_in_few_batches(spark, recorded):
    part = clips.Clips(clips.listed(recorded), micros(9), micros(55))
    batches = list(clips.frames_of(part, recorded, 1))
    assert len(batches) == 1 and len(batches[0]) == 46 + 6
    small = list(clips.frames_of(part, recorded, 1, 1))
    assert sum(map(len, small)) == 46 + 6 and pa.Table.from_batches(small).sort_by([("stream", "ascending"), ("frame", "ascending")]).equals(pa.Table.from_batches(batches).combine_chunks().sort_by([("stream", "ascending"), ("frame", "ascending")]))


def test_clips_are_whole_whatever_the_batches(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 5)
    try:
        many = {f"s{i}": range(3 + i) for i in range(12)}
        assert clips.write_clips(frames(spark, many).repartition(3), str(tmp_path / "c"), 4) == sum(3 + i for i in range(12))
    finally:
        spark.conf.set(name, before)
    got = {(c.stream, c.first, c.frames) for c in clips.listed(str(tmp_path / "c"))}
    assert got == {(s, k + 1, min(4, len(t) - k)) for s, t in many.items() for k in range(0, len(t), 4)}
