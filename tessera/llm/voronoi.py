"""Exact top-k inner products by a Voronoi join.

Rows are given to the nearest of at most ``N_PIVOTS`` pivots. A summary of each cell (rows, radius, largest norm)
bounds the inner product of any query in one cell with any row in another from both sides: with q = p + a, x = s + b,
q.x lies within p.s +- (|a||s| + |p||b| + |a||b|), and is at most |q||x|. A cell's queries then have a score that k
rows surely reach, and a row is sent only to those groups of cells where its upper bound reaches it. Neighbouring cells
share a block of rows, a large cell has several; a group of queries is sent only to the blocks of cells that can reach it
and is solved there; the blocks' bests are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import BLOCK_ROWS, GROUP_QUERIES, by_length, largest, meet, ranked, stack, usable

N_PIVOTS = 64


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Up to N_PIVOTS distinct rows of each of the commonest lengths, the same in every run."""
    least = vectors.select(F.xxhash64("vec").alias("h")).distinct().orderBy("h").limit(N_PIVOTS)
    rows = vectors.withColumn("h", F.xxhash64("vec")).join(F.broadcast(least), "h").groupBy("h").agg(F.first("vec").alias("vec")).collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(len(r.vec), []).append(np.asarray(r.vec))
    return {n: np.unique(np.stack(v), axis=0) for n, v in found.items()}


def _nearest(x: np.ndarray, pivots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row and the distance to it; without a pivot of this length, the origin."""
    if pivots is None:
        return np.zeros(len(x), int), np.linalg.norm(x, axis=1)
    d2 = (pivots**2).sum(1) - 2 * x @ pivots.T
    cell = d2.argmin(1)
    return cell, np.linalg.norm(x - pivots[cell], axis=1)


def _assign(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in by_length(pdf):
                x = stack(part.vec)
                cell, r = _nearest(x, pivots.get(n))
                yield pd.DataFrame({"vec_id": part.vec_id.to_numpy(), "dim": n, "cell": cell, "radius": r, "norm": np.linalg.norm(x, axis=1), "is_query": part.is_query.to_numpy(), "x": [v.tobytes() for v in x]})

    return run


class Bounds:
    """What the summaries say of one vector length: which groups of query cells a row has to reach, and by which blocks.

    ``cells``: cell, is_query, n (rows), ids (candidates counted in the cell, each id in one cell only), radius, norm."""

    def __init__(self, cells: pd.DataFrame, pivots: np.ndarray, k: int):
        queries = cells[cells.is_query]
        data = cells.groupby("cell", as_index=False).agg(n=("n", "sum"), ids=("ids", "sum"), radius=("radius", "max"), norm=("norm", "max"))
        self.pivots, self.cells = pivots, queries.cell.to_numpy()
        self.own, self.spread, self.norms = pivots[self.cells], queries.radius.to_numpy(), queries.norm.to_numpy()
        self.own_norm = np.linalg.norm(self.own, axis=1)
        mid, slack = self._mid(data.cell.to_numpy()), self._slack(data.cell.to_numpy(), data.radius.to_numpy())
        lower, self.reached = (mid - slack).T, np.full(len(queries), -np.inf)  # a row for each query cell
        for i, row in enumerate(lower):
            order = np.argsort(-row)
            enough = np.flatnonzero(np.cumsum(data.ids.to_numpy()[order]) >= k + 1)  # one may be the query's own
            if len(enough):
                self.reached[i] = row[order[enough[0]]]
        # neighbouring cells share a group of about GROUP_QUERIES queries; a larger cell is dealt into parts
        at = np.argsort(self.own @ self.own[0], kind="stable") if len(queries) else np.empty(0, int)
        before = np.cumsum(queries.n.to_numpy()[at]) - queries.n.to_numpy()[at]
        self.group = np.empty(len(queries), int)
        self.group[at] = before // GROUP_QUERIES
        self.parts = np.maximum(1, -(-queries.n.to_numpy() // GROUP_QUERIES))
        self.starts = {g: np.flatnonzero(self.group == g) for g in np.unique(self.group)}
        self.group_parts = {g: int(self.parts[i].max()) for g, i in self.starts.items()}
        self._deal(data)

    def _deal(self, data: pd.DataFrame) -> None:
        """Blocks of about BLOCK_ROWS rows: several cells along a line share one, a larger cell has as many as it needs."""
        cell, n = data.cell.to_numpy(), data.n.to_numpy()
        self.first_block, self.n_blocks = np.zeros(len(self.pivots), int), np.ones(len(self.pivots), int)
        block, rows = 0, 0
        for i in np.argsort(self.pivots[cell] @ self.pivots[cell[0]], kind="stable"):
            if rows and rows + n[i] > BLOCK_ROWS:
                block, rows = block + 1, 0
            self.first_block[cell[i]], self.n_blocks[cell[i]] = block, -(-n[i] // BLOCK_ROWS)
            rows += n[i]
            if rows >= BLOCK_ROWS:
                block, rows = block + self.n_blocks[cell[i]], 0
        self.blocks = {}
        for g, some in self.needed(cell, data.radius.to_numpy(), data.norm.to_numpy()):
            self.blocks[g] = sorted({b for c in cell[some] for b in range(self.first_block[c], self.first_block[c] + self.n_blocks[c])})

    def _mid(self, cell: np.ndarray) -> np.ndarray:
        return self.pivots[cell] @ self.own.T

    def _slack(self, cell: np.ndarray, radius: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(self.pivots[cell], axis=1)
        return norm[:, None] * self.spread + radius[:, None] * (self.own_norm + self.spread)

    def needed(self, cell: np.ndarray, radius: np.ndarray, norm: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each group, the rows that may be among some query's best. The margin covers rounding."""
        upper = np.minimum(self._mid(cell) + self._slack(cell, radius), norm[:, None] * self.norms)
        ok = upper + 1e-6 * (1 + np.abs(upper)) >= self.reached
        for g, members in self.starts.items():
            yield g, np.flatnonzero(ok[:, members].any(1))


def _route(bounds: dict[int, Bounds], queries: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in pdf.groupby("dim", sort=True):
                b = bounds.get(n)
                if b is None:
                    continue
                ids, cell, x = part.vec_id.to_numpy(), part.cell.to_numpy(), part.x.to_numpy()
                if queries:
                    slot = np.searchsorted(b.cells, cell)
                    group, sub = b.group[slot], (ids // 20) % b.parts[slot]
                    for g in np.unique(group):
                        mine = np.flatnonzero(group == g)
                        for block in b.blocks[g]:
                            yield pd.DataFrame({"dim": n, "grp": g, "sub": sub[mine], "block": block, "vec_id": ids[mine], "x": x[mine]})
                else:
                    # rows of one cell, or of one id, are dealt by their place in the batch
                    block = b.first_block[cell] + np.arange(len(part)) % b.n_blocks[cell]
                    for g, rows in b.needed(cell, part.radius.to_numpy(), part.norm.to_numpy()):
                        for sub in range(b.group_parts[g]):
                            yield pd.DataFrame({"dim": n, "grp": g, "sub": sub, "block": block[rows].astype(np.int64), "vec_id": ids[rows], "x": x[rows]})

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond the range of a long they stay at its end."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return q @ x.T
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(q) @ exact(x).T, -(2**63), 2**63 - 1)


def _solve(k: int):
    def run(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(queries):
            data = data.sort_values("vec_id", kind="stable")
            x, ids = stack(data.x), data.vec_id.to_numpy()
            firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            repeated, ids = len(firsts) < len(ids), ids[firsts]
            q, qids = stack(queries.x), queries.vec_id.to_numpy()
            for at in range(0, len(q), 256):
                score, mine = _products(q[at : at + 256], x), qids[at : at + 256]
                if repeated:
                    score = np.maximum.reduceat(score, firsts, axis=1)
                keep = min(k + 1, len(ids))  # one may be the query's own
                if score.dtype == object:
                    best = np.array([sorted(range(len(ids)), key=lambda j, row=row: (-row[j], j))[:keep] for row in score])
                else:
                    best = largest(score, keep)
                rows = np.repeat(np.arange(len(mine)), best.shape[1])
                cols = best.ravel()
                other = ids[cols] != mine[rows]
                rows, cols = rows[other], cols[other]
                out.append(pd.DataFrame({"query_id": mine[rows], "vec_id": ids[cols], "score": score[rows, cols].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})

    return run


def top_k(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """For rows whose id is divisible by ``every``, the k rows of highest integer inner product.

    Components become floor(scale * x). Returns query_id, rank (from 1), vec_id, score (long); ties go to the smaller
    id; a query with fewer candidates gets all. Rows without id, and vectors that are null, empty or hold a null or
    non-finite component, before or after scaling, take no part; vectors meet only those of their own length. Rows that share an id are one
    candidate with the best of their scores and never candidates of that id's query. Columns of any other name are not
    read; an empty table gives no row.
    """
    whole = usable(df, id_col, vec_col).select("vec_id", F.transform("vec", lambda v: F.rint(v * scale - 0.5)).alias("near"), "vec")
    # floor() gives a long and would wrap for huge values: correct the rounded half step instead
    whole = whole.filter(~F.exists("near", lambda x: F.abs(x) == float("inf")))
    vectors = whole.select("vec_id", F.zip_with("vec", "near", lambda v, r: F.when(r + 1 <= v * scale, r + 1).when(r > v * scale, r - 1).otherwise(r)).alias("vec"), (F.col("vec_id") % every == 0).alias("is_query"))
    pivots = _pivots(vectors)
    placed = vectors.mapInPandas(_assign(pivots), "vec_id long, dim int, cell int, radius double, norm double, is_query boolean, x binary")
    # an id is a candidate of one cell only, in the counts that bounds rest on
    once = placed.groupBy("dim", "vec_id", "is_query").agg(F.min("cell").alias("own"))
    once = once.groupBy("dim", F.col("own").alias("cell"), "is_query").agg(F.count(F.lit(1)).alias("ids"))
    cells = placed.groupBy("dim", "cell", "is_query").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm"))
    cells = cells.join(once, ["dim", "cell", "is_query"], "left").fillna(0, ["ids"]).toPandas()  # N_PIVOTS rows a length
    bounds = {}
    for n, part in cells.sort_values(["cell", "is_query"]).groupby("dim"):
        if part.is_query.any():
            bounds[n] = Bounds(part, pivots.get(n, np.zeros((1, n))), k)
    schema, keys = "dim int, grp long, sub long, block long, vec_id long, x binary", ["dim", "grp", "sub", "block"]
    data = placed.mapInPandas(_route(bounds, False), schema)
    queries = placed.filter("is_query").mapInPandas(_route(bounds, True), schema)
    return ranked(meet(queries, data, keys, _solve(k), "query_id long, vec_id long, score long"), k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
