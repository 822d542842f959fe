"""Queries that write clips from the events, read them as a source or run a stream over them, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlake.fixtures import table
from boxlake.operators.scan import shared_path
from boxlake.sources import clips
from boxlake.streaming import stateful

STRIDE, PAUSE_MS = 3, 86_400_000
Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def recorded(spark: SparkSession, d: str) -> str:
    """A folder of clips: each user is a stream, each event a grey frame of 4 x 3 pixels."""
    e = table(spark, d, "events").where("ts IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pixel = [F.lpad(F.hex(F.pmod(F.col("event_id") * 7 + i * 13, F.lit(256))), 2, "0") for i in range(12)]
    frames = e.select(F.col("user_id").cast("string").alias("stream"), number.cast("long").alias("frame"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(3).alias("height"), F.lit(4).alias("width"), F.lit(1).alias("channels"), F.unhex(F.concat(*pixel)).alias("pixels"))
    path = shared_path(spark, "clips")
    clips.write_clips(frames, path, 64)
    clips.register(spark)
    return path


def brightness() -> Column:
    """Mean of twelve pixels: four bytes at a time as one whole number, of which the bytes are summed."""
    four = [F.conv(F.substring(F.hex("pixels"), 8 * i + 1, 8), 16, 10).cast("long") for i in range(3)]
    return sum((F.shiftright(v, 8 * j).bitwiseAND(255) for v in four for j in range(4)), F.lit(0).cast("long")).cast("double") / 12


_FRAMES = """fr AS (SELECT user_id::VARCHAR AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame, ts, event_id,
  list_sum(list_transform(range(12), lambda i: (event_id * 7 + i * 13) % 256)) / 12e0 AS brightness FROM events WHERE ts IS NOT NULL)"""


@query
def clip_frames(spark: SparkSession, d: str) -> DataFrame:
    """Every third frame of each stream, read from clips."""
    frames = spark.read.format("clips").option("stride", STRIDE).load(recorded(spark, d))
    return frames.select("stream", "frame", "ts", F.round(brightness(), 6).alias("brightness"))


SQL["clip_frames"] = f"WITH {_FRAMES} SELECT stream, frame, ts, round(brightness, 6) AS brightness FROM fr WHERE frame % {STRIDE} = 0"


def streamed(spark: SparkSession, d: str, fold, mode: str) -> DataFrame:
    """What fold gives over the stream of clips: run to the middle of the time, stopped, started again from its checkpoint, run to the end."""
    path, out, check = recorded(spark, d), shared_path(spark, "stream"), shared_path(spark, "stream-state")
    known = clips.reels(path)
    middle = (min(r.start for r in known) + max(r.end for r in known)) // 2 if known else 0
    for until in (middle, None):
        reader = spark.readStream.format("clips")
        frames = (reader if until is None else reader.option("until", until)).load(path)
        stateful.run_to_end(fold(frames.withColumn("brightness", brightness())), out, check, mode)
    return spark.read.parquet(out)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(f):
    """State of transformWithState lives in RocksDB; the setting of the session comes back afterwards."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        name = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(name, None)
        spark.conf.set(name, ROCKS)
        try:
            return f(spark, d)
        finally:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@query
@with_rocks
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest frame of each stream, and how many there were."""
    rows = streamed(spark, d, stateful.latest, "update")
    newest = F.max_by(F.struct("seen", "frame", "brightness"), "seen").alias("r")
    return rows.groupBy("stream").agg(newest).select("stream", "r.seen", "r.frame", F.round("r.brightness", 6).alias("brightness"))


SQL["stream_latest"] = f"WITH {_FRAMES} SELECT stream, count(*) AS seen, max(frame) AS frame, round(arg_max(brightness, frame), 6) AS brightness FROM fr GROUP BY stream"


@query
@with_rocks
def stream_folds(spark: SparkSession, d: str) -> DataFrame:
    """Mean, exponential average, best value and early stop of each stream, in the order of its frames."""
    rows = streamed(spark, d, stateful.folds, "update")
    last = F.max_by(F.struct("n", "mean", "ema", "best", "best_at", "stopped_at"), "n").alias("r")
    return rows.groupBy("stream").agg(last).select("stream", "r.n", *(F.round(f"r.{c}", 6).alias(c) for c in ("mean", "ema", "best")), "r.best_at", "r.stopped_at")


SQL["stream_folds"] = f"""WITH RECURSIVE {_FRAMES}, fm AS MATERIALIZED (SELECT * FROM fr),
f AS (SELECT stream, frame, brightness * (1 - 9999e-4 * (1 - exp(-1 / 50e0))) AS e FROM fm WHERE frame = 1
  UNION ALL SELECT n.stream, n.frame, f.e * 9999e-4 * (1 - exp(-n.frame / 50e0)) + n.brightness * (1 - 9999e-4 * (1 - exp(-n.frame / 50e0))) FROM f JOIN fm n ON n.stream = f.stream AND n.frame = f.frame + 1),
b AS (SELECT stream, frame, brightness, max(brightness) OVER w AS best FROM fm WINDOW w AS (PARTITION BY stream ORDER BY frame)),
c AS (SELECT *, max(CASE WHEN brightness >= best THEN frame END) OVER (PARTITION BY stream ORDER BY frame) AS best_at FROM b),
s AS (SELECT stream, count(*) AS n, avg(brightness) AS mean, max(brightness) AS best, arg_max(best_at, frame) AS best_at, min(frame) FILTER (WHERE frame - best_at >= 10) AS stopped_at FROM c GROUP BY stream)
SELECT s.stream, n, round(mean, 6) AS mean, round(e, 6) AS ema, round(best, 6) AS best, best_at, stopped_at FROM s JOIN f ON f.stream = s.stream AND f.frame = s.n"""


@query
@with_rocks
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of frames without a pause of a day that have ended by the last frame of all."""

    def runs(frames: DataFrame) -> DataFrame:
        return stateful.sessions(frames.withColumn("us", F.expr("unix_micros(CAST(ts AS TIMESTAMP))")), PAUSE_MS)

    return streamed(spark, d, runs, "append").select("stream", "first_us", "last_us", "frames")


SQL["stream_sessions"] = f"""WITH {_FRAMES}, u AS (SELECT stream, epoch_us(ts) AS us FROM fr),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY stream ORDER BY us) <= {PAUSE_MS * 1000} THEN 0 ELSE 1 END AS fresh FROM u),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY stream ORDER BY us ROWS UNBOUNDED PRECEDING) AS run FROM g),
r AS (SELECT stream, min(us) AS first_us, max(us) AS last_us, count(*) AS frames, run FROM k GROUP BY stream, run)
SELECT stream, first_us, last_us, frames FROM r WHERE EXISTS (SELECT 1 FROM r o WHERE o.stream = r.stream AND o.run > r.run) OR last_us + {PAUSE_MS * 1000} < (SELECT max(us) FROM u)"""
