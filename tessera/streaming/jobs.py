"""Streaming forms: restamped event times, duplicate links, rate limits and failure streaks with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tessera.sources.shared import shared_dir


def restamp(ts: Column, arrival: Column) -> Column:
    """An implausible time (over an hour ahead, over 180 days back, or none) becomes the minute of arrival."""
    fine = (ts <= arrival + F.expr("interval 1 hour")) & (ts >= arrival - F.expr("interval 180 days"))
    return F.when(fine, ts).otherwise(F.date_trunc("minute", arrival))


def first_by_link(stream: DataFrame, link: str, ts: str, delay: str = "7 days") -> DataFrame:
    """The first item of each link; a link is remembered for ``delay`` of event time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([link])


#: Rows of an answer that leave a worker together.
CHUNK = 10_000


def _in_order(batches: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """The columns of a key's rows of one batch by time and id, 8 bytes a value: nothing else of the rows is held."""
    held: list[list[np.ndarray]] = [[] for _ in columns]
    for rows in batches:
        for part, name in zip(held, columns, strict=True):
            part.append(rows[name].to_numpy())
    values = [np.concatenate(part) for part in held]
    order = np.lexsort((values[columns.index("id")], values[columns.index("micros")]))
    return [v[order] for v in values]


def _in_chunks(key: tuple, n: int, **columns) -> Iterator[pd.DataFrame]:
    for i in range(0, n, CHUNK):
        yield pd.DataFrame({"key": key[0], **{name: v[i : i + CHUNK] for name, v in columns.items()}})


def _limited(window_s: int, limit: int, evict: bool):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        micros, ids = _in_order(batches, "micros", "id")
        counts = np.empty(len(ids), np.int32)
        for i, t in enumerate(micros):
            if start is None or t - start > window_s * 1_000_000:
                start, n = int(t), 0
            n += 1
            counts[i] = n
        state.update((start, n))
        if evict:
            state.setTimeoutTimestamp(max(start // 1000 + window_s * 1000, state.getCurrentWatermarkMs()) + 1)
        yield from _in_chunks(key, len(ids), id=ids, in_window=counts, allowed=counts <= limit)

    return run


def rate_limit(stream: DataFrame, key: str, ts: str, id_col: str, window_s: int, limit: int, late: str | None = None) -> DataFrame:
    """Each request with its number in its key's window, which begins with the first request after the last one ended.

    State is one window for each key. With ``late``, how far requests may come out of order, a key whose window has ended that
    long ago has no state any more, so that state grows with the keys of a window and not with all that ever came."""
    time = F.col(ts).cast("timestamp")
    rows = stream.select(F.col(key).alias("key"), time.alias("ts"), F.unix_micros(time).alias("micros"), F.col(id_col).alias("id"))
    rows = rows.drop("ts") if late is None else rows.withWatermark("ts", late)
    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(_limited(window_s, limit, late is not None), "key long, id long, in_window int, allowed boolean", "start long, n int", "append", timeout)


def _streaks(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (n,) = state.get if state.exists else (0,)
    _, ids, failed = _in_order(batches, "micros", "id", "failed")
    streak = np.empty(len(ids), np.int64)
    for i, bad in enumerate(failed):
        n = n + 1 if bad else 0
        streak[i] = n
    if n:
        state.update((n,))
    elif state.exists:
        state.remove()
    yield from _in_chunks(key, len(ids), id=ids, streak=streak)


def failure_streaks(stream: DataFrame, key: str, ts: str, id_col: str, failed: Column) -> DataFrame:
    """Each outcome with the failures in a row up to it. State is one number for each key that is failing; the others have none."""
    rows = stream.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), F.col(id_col).alias("id"), failed.alias("failed"))
    return rows.groupBy("key").applyInPandasWithState(_streaks, "key long, id long, streak long", "n long", "append", GroupStateTimeout.NoTimeout)


def read_table(spark: SparkSession, sf_dir: str, name: str, schema: StructType) -> DataFrame:
    """A parquet table as a stream, whether it is a file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    one = spark.read.schema(schema).parquet(path).inputFiles()[0].rstrip("/").endswith(f"{name}.parquet")
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if one else reader.parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into the shared folder, and read what it wrote.

    In mode "update" that is every state a row has had after a batch."""
    import uuid

    out = f"{shared_dir(stream.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{out}/rows")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"))
    writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows").select(*stream.columns)
