"""Running aggregates over long ordered groups without putting a group in one task.

A window over (key) sorts all rows of a key in one task; a class of detections
can hold a third of a table.  Here a key is cut into ordered chunks by a
monotone expression, chunk totals (keys x chunks rows) are scanned, and the rows
are scanned inside their chunk only.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def same_chunk(keys: list[str], null_keys: bool) -> Column:
    same = F.col("__chunk") == F.col("__c")
    for k in keys:
        same = same & (F.col(k).eqNullSafe(F.col(f"__k_{k}")) if null_keys else F.col(k) == F.col(f"__k_{k}"))
    return same


def running_sums(df: DataFrame, keys: list[str], chunk: Column, order: list[Column], sums: dict[str, str], many_chunks: bool = False, null_keys: bool = True) -> DataFrame:
    """df with one running sum for each output: input of sums; chunk, a whole number, rises with order.

    Without null_keys no key is null, so totals meet the rows as these were dealt out for
    the window; a join that takes nulls as equal would deal them out once more.

    With many_chunks (their number grows with the rows) the totals of chunks are
    scanned in the same way: by a thousand chunks, then over those.
    """
    df = df.withColumn("__chunk", chunk)
    totals = df.groupBy(*keys, "__chunk").agg(*(F.sum(c).alias(f"__t_{o}") for o, c in sums.items()))
    if many_chunks:
        scanned = running_sums(totals.withColumnRenamed("__chunk", "__x"), keys, F.floor(F.col("__x") / 1024), [F.asc("__x")], {f"__b_{o}": f"__t_{o}" for o in sums}, null_keys=null_keys).drop("__chunk")
        bases = scanned.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__x").alias("__c"), *((F.col(f"__b_{o}") - F.col(f"__t_{o}")).alias(f"__b_{o}") for o in sums))
    else:
        before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        bases = totals.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__chunk").alias("__c"), *(F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__b_{o}") for o in sums))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = same_chunk(keys, null_keys)
    local = df.withColumns({o: F.sum(c).over(inside) for o, c in sums.items()})
    out = local.join(bases, same)
    return out.withColumns({o: F.col(o) + F.col(f"__b_{o}") for o in sums}).drop("__c", *(f"__k_{k}" for k in keys), *(f"__b_{o}" for o in sums))


def maxima_from_here(df: DataFrame, keys: list[str], order: list[Column] | str, maxima: dict[str, str], null_keys: bool = True) -> DataFrame:
    """df, which has __chunk of running_sums, with the maximum of each value (output: input) over the row and all later rows of its key.

    order is that of running_sums, or the name of a column that numbers the rows
    in it.  Rows are scanned from the last to the first: one step for each row.
    """
    totals = df.groupBy(*keys, "__chunk").agg(*(F.max(v).alias(f"__m_{o}") for o, v in maxima.items()))
    after = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(1, Window.unboundedFollowing)
    tops = totals.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col("__chunk").alias("__c"), *(F.max(f"__m_{o}").over(after).alias(f"__top_{o}") for o in maxima))
    part = Window.partitionBy(*keys, "__chunk")
    number = order if isinstance(order, str) else "__number"
    if number != order:
        df = df.withColumn(number, F.row_number().over(part.orderBy(*order)))
    inside = part.orderBy(F.desc(number)).rowsBetween(Window.unboundedPreceding, 0)
    same = same_chunk(keys, null_keys)
    local = df.withColumns({o: F.max(v).over(inside) for o, v in maxima.items()})
    return local.join(tops, same).withColumns({o: F.greatest(o, f"__top_{o}") for o in maxima}).drop("__c", "__number", *(f"__top_{o}" for o in maxima), *(f"__k_{k}" for k in keys))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="boxlake-")  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(where)
    return f"{where}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df cut off from its lineage: written to the shared checkpoint folder and read back, so that it is computed once."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
