"""Approximate nearest neighbours by collision counting.

Inner products become distances: rows are scaled by the largest norm and lengthened to the unit sphere, queries are
normalised. Each of ``N_PROJECTIONS`` random lines holds a block's rows in a sorted array. A query opens a window around
its own place in every array; a row that lies in the windows of enough lines collides often enough to be verified by its
true inner product. Windows widen by virtual rehashing (the radius grows by ``GROWTH``, the arrays stay) until k
verified rows lie within the radius, so no row is left out by a cap: in the end the windows hold the whole block. Only
rows between the old and the new ends of the windows are counted, one by one; windows that take in most of a block at
once are counted by comparing places instead, which costs less then and gives the same counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle
from tessera.llm.vectors import BLOCK_ROWS, GROUP_QUERIES, meet, ranked, stack, usable

#: Lines; half a window in units of the radius; growth of the radius; deviations below the mean that still collide.
N_PROJECTIONS, HALF_WIDTH, GROWTH, SLACK, SEED = 64, 1.5, 1.06, 1.0, 7
#: No two unit vectors are twice as far apart: a query that has not found enough by then is compared with every row.
FARTHEST = 4.0
#: Queries counted together, so that their counts stay in a processor's cache.
TOGETHER = 32
#: New rows are counted one by one while they are less than this share of the block's places on all lines.
SPARSE = 0.1


def _threshold() -> int:
    """Collisions that a row at the radius exceeds but for SLACK deviations."""
    p = math.erf(HALF_WIDTH / math.sqrt(2))
    return math.floor(N_PROJECTIONS * p - SLACK * math.sqrt(N_PROJECTIONS * p * (1 - p)))


class Index:
    """Sorted arrays of one block, and the place of each row in them."""

    def __init__(self, x: np.ndarray, norm: float):
        n, d = x.shape
        self.x = x
        unit = x / norm
        self.points = np.hstack([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))[:, None]])
        self.lines = np.random.default_rng(SEED).standard_normal((d + 1, N_PROJECTIONS))
        heights = (self.points @ self.lines).T
        self.order = order = np.argsort(heights, axis=1, kind="stable")
        self.sorted = np.take_along_axis(heights, order, axis=1)
        self.place = np.empty((N_PROJECTIONS, n), np.uint16 if n < 2**16 else np.uint32)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(n, dtype=self.place.dtype), order.shape), axis=1)
        self.sample = self.points[:: max(1, n // 512)]

    def search(self, queries: np.ndarray, k: int, own: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, verified rows and their inner products; its ``own`` rows are no candidates."""
        n, found = len(self.x), [None] * len(queries)
        scaled = queries / np.abs(queries).max(axis=1, initial=0)[:, None]  # whose squares are neither too small nor too large
        unit = np.hstack([scaled / np.linalg.norm(scaled, axis=1)[:, None], np.zeros((len(queries), 1))])
        heights, at = unit @ self.lines, min(2, len(self.sample) - 1)
        radius = np.sqrt(np.maximum(np.partition(2 - 2 * unit @ self.sample.T, at, axis=1)[:, at], 1e-4))
        few = np.array([n - len(o) <= k for o in own], bool)
        for i in np.flatnonzero(few):
            rows = np.setdiff1d(np.arange(n), own[i])
            found[i] = rows, self.x[rows] @ queries[i]
        open_ = np.flatnonzero(~few)
        count = np.zeros((len(queries), n), np.uint8)
        # window ends of every query and line so far: empty windows at the query's own place
        lo = np.stack([np.searchsorted(self.sorted[j], heights[:, j]) for j in range(N_PROJECTIONS)], 1)
        hi = lo.copy()
        while len(open_):
            reach = HALF_WIDTH * radius[open_]
            a = np.stack([np.searchsorted(self.sorted[j], heights[open_, j] - reach) for j in range(N_PROJECTIONS)], 1)
            b = np.stack([np.searchsorted(self.sorted[j], heights[open_, j] + reach) for j in range(N_PROJECTIONS)], 1)
            new = (lo[open_] - a + b - hi[open_]).sum(1)
            many = new > SPARSE * n * N_PROJECTIONS
            for i, start, end in zip(open_[~many], a[~many], b[~many], strict=True):
                rows = [self.order[j, x:y] for j in range(N_PROJECTIONS) for x, y in ((start[j], lo[i, j]), (hi[i, j], end[j])) if x < y]
                if rows:
                    count[i] += np.bincount(np.concatenate(rows), minlength=n).astype(np.uint8)
            for at in range(0, int(many.sum()), TOGETHER):
                part = np.flatnonzero(many)[at : at + TOGETHER]
                count[open_[part]] = self._inside(a[part], b[part])
            lo[open_], hi[open_] = a, b
            for i in open_:
                rows = np.setdiff1d(np.flatnonzero(count[i] >= _threshold()), own[i], assume_unique=True)
                if len(rows) >= k:
                    within = 2 - 2 * self.points[rows] @ unit[i] <= radius[i] ** 2
                    if within.sum() >= k or radius[i] > 2:
                        found[i] = rows, self.x[rows] @ queries[i]
                if found[i] is None and radius[i] > FARTHEST:
                    rows = np.setdiff1d(np.arange(n), own[i])
                    found[i] = rows, self.x[rows] @ queries[i]
            open_ = np.array([i for i in open_ if found[i] is None], int)
            radius[open_] *= GROWTH
        return found

    def _inside(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each row of window ends, how many lines hold each row of the block in their window."""
        count = np.zeros((len(lo), len(self.x)), np.uint8)
        away, inside = np.empty(count.shape, self.place.dtype), np.empty(count.shape, bool)
        width, lo = (hi - lo).astype(self.place.dtype), lo.astype(self.place.dtype)
        for j in range(N_PROJECTIONS):
            np.subtract(self.place[j], lo[:, j, None], out=away)  # wraps below the window, to a place beyond it
            np.less(away, width[:, j, None], out=inside)
            count += inside.view(np.uint8)
        return count


def _solve(k: int):
    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(data) and len(queries):
            data = data.sort_values("vec_id", kind="stable")
            ids, index = data.vec_id.to_numpy(), Index(stack(data.x), float(data.norm.iloc[0]))
            asked = queries.vec_id.to_numpy()
            own = [np.arange(a, b) for a, b in zip(np.searchsorted(ids, asked), np.searchsorted(ids, asked, "right"), strict=True)]
            for mine, (found, score) in zip(asked, index.search(stack(queries.x), k, own), strict=True):
                best = np.argsort(-score, kind="stable")[:k]
                out["query_id"].append(np.full(len(best), mine))
                out["vec_id"].append(ids[found[best]])
                out["score"].append(score[best])
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pd.DataFrame({c: np.concatenate(v).astype(kinds[c]) if v else np.empty(0, kinds[c]) for c, v in out.items()})

    return run


def _as_bytes(batches):
    for pdf in batches:
        if len(pdf):
            yield pd.DataFrame({"vec_id": pdf.vec_id, "dim": pdf.vec.map(len).astype("int32"), "x": [np.asarray(v, np.float64).tobytes() for v in pdf.vec]})


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For rows whose id is divisible by ``every``, the k rows of largest inner product that the index finds.

    Returns query_id, rank (from 1), vec_id, score (the inner product in double precision); ties go to the smaller id;
    a query with no more than k candidates gets all. Rows without id, and vectors that are null, empty, zero or hold a
    null or non-finite component take no part; vectors meet only those of their own length. Rows that share an id are
    one candidate with the best of their scores and never candidates of that id's query. Columns of any other name are
    not read; an empty table gives no row.
    """
    vectors = usable(df, id_col, vec_col, nonzero=True)
    most = F.array_max(F.transform("vec", F.abs))
    length = most * F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / most) * (x / most)))
    # every length has its own largest norm, and its own blocks and groups: a row for each length
    known = vectors.groupBy(F.size("vec").alias("dim")).agg(
        F.max(length).alias("norm"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("vec_id") % every == 0) / GROUP_QUERIES).cast("int").alias("groups")
    )
    known = settle(known.filter("groups > 0").coalesce(1), "lengths")
    placed = vectors.mapInPandas(_as_bytes, "vec_id long, dim int, x binary").join(known, "dim")
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = [F.col(c).alias(c) for c in ("vec_id", "dim", "x")]  # both sides need columns of their own
    data = placed.select(*own, "norm", deal(F.col("blocks")).alias("block"), every_one("groups").alias("grp"))
    queries = placed.filter(F.col("vec_id") % every == 0).select(*own, deal(F.col("groups")).alias("grp"), every_one("blocks").alias("block"))
    return ranked(meet(queries, data, ["dim", "grp", "block"], _solve(k), "query_id long, vec_id long, score double"), k)
