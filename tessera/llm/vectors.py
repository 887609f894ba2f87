"""What the two vector searches share: usable vectors as bytes, blocks of a query set against all rows, ranking."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import only

#: Rows of data, and queries, that one task compares at once.
BLOCK_ROWS, GROUP_QUERIES = 8192, 2048


def usable(df: DataFrame, id_col: str, vec_col: str, nonzero: bool = False) -> DataFrame:
    """vec_id, vec (array of double) of rows whose id and vector are whole: no null, no non-finite component."""
    v = F.col("vec")
    good = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = only(df, id_col, vec_col).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    found = found.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("vec") > 0) & good)
    return found.filter(F.exists("vec", lambda x: x != 0)) if nonzero else found


def stack(column: pd.Series) -> np.ndarray:
    """Rows of float64 bytes or arrays as a matrix."""
    if not len(column):
        return np.empty((0, 0))
    first = column.iloc[0]
    if isinstance(first, bytes | bytearray):
        return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)
    return np.stack([np.asarray(x, np.float64) for x in column])


def by_length(pdf: pd.DataFrame, column: str = "vec") -> list[tuple[int, pd.DataFrame]]:
    """Parts of a batch whose vectors are of one length."""
    if not len(pdf):
        return []
    return [(int(n), part) for n, part in pdf.groupby(pdf[column].map(len).to_numpy(), sort=True)]


def largest(scores: np.ndarray, k: int) -> np.ndarray:
    """Column indexes of each row's k largest scores, ties to the smaller column, in no order."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    top = float(np.abs(scores[np.isfinite(scores)]).max(initial=0))
    if top * n < 2**52 and np.all(scores[np.isfinite(scores)] == np.rint(scores[np.isfinite(scores)])):
        return np.argpartition(scores * n - np.arange(n), n - k, axis=1)[:, n - k :]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def meet(queries: DataFrame, data: DataFrame, keys: list[str], solve: Callable, schema: str) -> DataFrame:
    """Bring the queries and the data of each block together."""
    return data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(solve, schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query. Rows that share an id are one candidate, with the best of their scores."""
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
