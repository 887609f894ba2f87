"""Filters of bits that go to every task: sized by what they hold, and never more than a fixed number of bits.

A filter may hold more than was put in, never less, so it is used only where an exact step follows. What would fill the
largest filter gets none: the caller then joins instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mix64

#: Logarithm of the bits of the smallest and the largest filter, and of the bits for each value: ROOM values fit. Few values
#: get more bits each, so that few others pass.
SMALLEST, LARGEST, EACH, MORE = 16, 23, 3, 6
ROOM = 1 << (LARGEST - EACH)


def bit_table(hashes: DataFrame, n: int) -> np.ndarray | None:
    """The filter of a column h of ``n`` hashes, or None if more than ROOM; at most 2**LARGEST / 64 rows come to the driver."""
    if n > ROOM:
        return None
    bits = 1 << min(LARGEST, max(SMALLEST, (n << MORE).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    slots = hashes.select(F.shiftright(at, 6).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bits"))
    table = np.zeros(bits // 64, np.int64)
    for r in slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).collect():
        table[r.slot] = r.bits
    return table.view(np.uint64)


def holds(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    at = h.view(np.uint64) & np.uint64(64 * len(table) - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def id_hashes(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(np.uint64)).view(np.int64)


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"h": id_hashes(pdf.iloc[:, 0].to_numpy())})


def map_rows_of(df: DataFrame, ids: DataFrame, then: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``df.mapInPandas(then, schema)`` over the rows whose first column, a long that is not null, is among the distinct
    ``ids``, and perhaps over a few others: by a filter where the ids fit one, so that no row is shuffled, else by a
    semi-join. Filter and ``then`` run in one Python worker."""
    table = bit_table(ids.mapInPandas(_hashed, "h long"), ids.count())
    if table is None:
        return df.join(ids.toDF(df.columns[0]), df.columns[0], "left_semi").mapInPandas(then, schema)
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return then(pdf[holds(shared.value, id_hashes(pdf.iloc[:, 0].to_numpy(np.int64)))] for pdf in batches)

    return df.mapInPandas(run, schema)
