"""Queries over pixels, with SQL twins: every embedding is taken as a small image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake.fixtures import table
from boxlake.operators import pixels

Q: dict = {}
SQL: dict[str, str] = {}


def query(f):
    Q[f.__name__] = f
    return f


def _images(spark: SparkSession, d: str, side: int, channels: int) -> DataFrame:
    """side x side images whose bytes are the 64 values of an embedding, scaled and clipped."""
    byte = lambda v: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 400 + 128))).cast("long")), 2, "0")
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("path"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(channels).alias("channels"), F.unhex(F.array_join(F.transform("embedding", byte), "")).alias("pixels"))


_BYTES = "px AS (SELECT vec_id, i, least(255, greatest(0, floor(embedding[i + 1]::DOUBLE * 400 + 128))) AS v FROM embeddings, range(64) g(i))"


@query
def channel_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Pixels per channel and value, over all images of four channels."""
    return pixels.channel_histogram(_images(spark, d, 4, 4))


SQL["channel_histogram"] = f"WITH {_BYTES}, n AS (SELECT (i % 4)::INTEGER AS channel, v::INTEGER AS value, count(*) AS n FROM px GROUP BY ALL) SELECT c::INTEGER AS channel, k::INTEGER AS value, coalesce(n.n, 0)::BIGINT AS n FROM range(4) a(c) CROSS JOIN range(256) b(k) LEFT JOIN n ON n.channel = c AND n.value = k"
