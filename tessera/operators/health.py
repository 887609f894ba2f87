"""Source health: failure streaks, outages, and a fixed-start rate limit."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def failure_streaks(df: DataFrame, source: str, order: list[str], failed: str, warn: int = 3, critical: int = 12) -> DataFrame:
    """For each outcome the number of failures in a row up to it, and its alert."""
    w = Window.partitionBy(source).orderBy(*order)
    runs = df.withColumn("_run", F.sum((~F.col(failed)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum(F.col(failed).cast("int")).over(Window.partitionBy(source, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    level = F.when(F.col("streak") >= critical, "critical").when(F.col("streak") >= warn, "warn")
    return runs.withColumn("streak", streak).withColumn("alert", level).drop("_run")


def outage(df: DataFrame, run: str, source: str, failed: str, least: int = 12) -> DataFrame:
    """For each run the sources, those that failed, and whether that is an outage: half of them and ``least``."""
    per = df.groupBy(run, source).agg(F.max(F.col(failed).cast("int")).alias("f"))
    counts = per.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("n_failed"))
    return counts.withColumn("is_outage", F.col("n_failed") >= F.greatest(F.lit(least), F.ceil(F.col("n") * 0.5)))


def rate_limit(df: DataFrame, key: str, ts: str, tie: str, window_s: int, limit: int) -> DataFrame:
    """Each request with its number in its window and whether it passes.

    A window begins with the first request after the one before has ended, so it depends on all earlier requests of
    the key: a fold over the key's times in order. Spark sorts the requests, and only a key's window is held.
    """
    rows = df.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_micros"), tie).repartition(key).sortWithinPartitions(key, "_micros", tie)
    schema = T.StructType([df.schema[key], df.schema[tie], T.StructField("in_window", T.IntegerType()), T.StructField("allowed", T.BooleanType())])
    return rows.mapInArrow(functools.partial(_numbered, window_s * 1_000_000, limit), schema)


def _numbered(width: int, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, start, n = object(), None, 0
    for batch in batches:
        counts = []
        for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != held:
                held, start, n = key, None, 0
            # a request without a time joins the window that is open
            if start is None or t is not None and t - start > width:
                start, n = t, 0
            n += 1
            counts.append(n)
        allowed = pa.array([c <= limit for c in counts], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int32()), allowed], [batch.schema.names[0], batch.schema.names[2], "in_window", "allowed"])
