"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Documents with the same set are one row of the matrix. Columns are taken in one order for all rows, rare n-grams first,
and the first block of columns of a row are those of which two linked rows must share one (n - ceil(t n) + 1 of n). The
product over these blocks pairs rows; a pair is discarded as soon as the columns left to either row can't lift its
overlap to the bound ceil(t (n + m) / (1 + t)) that their sizes demand. Survivors have their overlap counted over all
columns.

A group of thousands of near copies shares most columns, so its pairs are not all made: first each row meets only the
leader of each shared column, and rows so linked form components. Then columns that a single component holds are
dropped, and the rest pair rows of different components, in two steps: bounds per (column, size, component) first, rows
only where these leave room. The result is the exact set of components.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bits import ROOM, bit_table, holds, map_rows_of
from tessera.llm.common import hash_words, mix64, only, settle, shingle_hashes, word_list
from tessera.operators.graph import connected
from tessera.sources.shared import drop

#: N-grams are counted when about so many are held. One seen so often in one count is reported, and is placed last if all
#: reports together have seen it so often, or if so many first blocks hold it.
COUNTED, IN_BATCH, IN_ALL = 4_000_000, 3, 24


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, as signed longs."""
    return np.unique(shingle_hashes(hash_words(word_list(text)), size).view(np.int64))


def required(n: Column | int, m: Column | int, num: int, den: int) -> Column:
    """The least overlap of linked sets of sizes n and m."""
    total = (n + m) * num
    return F.floor((total + (den + num - 1)) / F.lit(den + num)).cast("long")


def _often(h: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that ``h`` holds ``least`` times or more, and how often. Sorts ``h`` in place and copies only these."""
    h.sort()
    ahead = least - 1
    values, c = np.unique(h[: len(h) - ahead][h[ahead:] == h[: len(h) - ahead]], return_counts=True)
    return values, c + ahead


def _frequent(size: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = np.empty(COUNTED + COUNTED // 8, np.int64), 0

    def counted() -> pd.DataFrame:
        values, c = _often(held[:n], IN_BATCH)
        return pd.DataFrame({"h": values, "c": c})

    for pdf in batches:
        for text in pdf.text:
            found = shingle_set(text, size)
            if n + len(found) > len(held):
                held = np.append(held[:n], np.empty(len(found), np.int64))
            held[n : n + len(found)] = found
            n += len(found)
            if n >= COUNTED:
                yield counted()
                n = 0
    if n:
        yield counted()


def _first_block(s: np.ndarray, num: int, den: int, frequent) -> np.ndarray:
    """The first block of columns of a set: those placed last are taken last, the others by hash."""
    late = np.zeros(len(s), bool) if frequent.value is None else holds(frequent.value, s)
    return s[np.lexsort((s, late))][: len(s) - -(-num * len(s) // den) + 1] if len(s) else s


def _firsts(size: int, num: int, den: int, frequent, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The columns of all first blocks, by their lower 32 bits: a filter of bits reads no others."""
    for pdf in batches:
        found = [_first_block(shingle_set(t, size), num, den, frequent) for t in pdf.text]
        yield pd.DataFrame({"h": np.concatenate([np.empty(0, np.int64), *found]).astype(np.int32)})


def _rows(size: int, num: int, den: int, frequent, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text in pdf.text:
            s = shingle_set(text, size)
            n = len(s)
            with np.errstate(over="ignore"):
                u = s.view(np.uint64)
                d1, d2 = mix64(u).sum(dtype=np.uint64), mix64(u ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
            out.append((n, int(d1.view(np.int64)), int(d2.view(np.int64)), _first_block(s, num, den, frequent)))
        frame = pd.DataFrame(out, columns=["n", "d1", "d2", "first"])
        frame.insert(0, "doc_id", pdf.doc_id.to_numpy())
        yield frame


def _sets(size: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            yield pd.DataFrame({"node": pdf.doc_id.to_numpy(np.int64), "grams": [shingle_set(t, size) for t in pdf.text]})


def _linked(docs: DataFrame, cells: DataFrame, pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of candidate ``pairs`` (a, b: rows by their node), those whose overlap over all columns is enough.

    First the overlap within the first blocks of columns is counted. Of the row whose block ends earlier, all columns
    shared up to there lie in the other's block, so the overlap is at most this count plus what either row has left.
    """
    left, right = cells.select("gram", F.col("node").alias("a"), F.col("n").alias("na")), cells.select("gram", F.col("node").alias("b"), F.col("n").alias("nb"))
    blocks = pairs.join(left, "a").join(right, ["b", "gram"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    after = F.ceil(F.greatest("na", "nb") * num / F.lit(float(den))) - 1
    likely = settle(blocks.filter(F.col("hits") + after >= required(F.col("na"), F.col("nb"), num, den)).select("a", "b"), "likely")
    if not likely.take(1):
        return likely

    def sets(side: str) -> DataFrame:
        return map_rows_of(docs, likely.select(side).distinct(), functools.partial(_sets, size), "node long, grams array<long>")

    # a repeated row may bring its set twice: links are distinct in the end
    both = likely.join(sets("a").toDF("a", "x"), "a").join(sets("b").toDF("b", "y"), "b")
    overlap = F.size(F.array_intersect("x", "y"))
    return settle(both.filter(overlap * (den + num) >= (F.size("x") + F.size("y")) * num).select("a", "b"), "linked")


def _stars(links: DataFrame) -> DataFrame:
    """node, c: a label that a row shares only with rows it is linked to, over few steps. ``links`` has one a for each b.

    Labels need not be whole components here: they save pairs that need not be looked at again.
    """
    back = links.select(F.col("b").alias("x"), F.col("a").alias("y"))
    once = links.join(back, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left").filter("x is null or b > a").select(F.col("b").alias("node"), F.col("a").alias("c"))
    for _ in range(2):
        up = once.select(F.col("node").alias("c"), F.col("c").alias("above"))
        once = settle(once.join(up, "c", "left").select("node", F.coalesce("above", "c").alias("c")), "stars")
    return once


def _filter(often: DataFrame):
    """The columns placed last, as a filter for every task: of very many the most frequent, as any order of the columns gives
    the same pairs."""
    n_often = often.count()
    if n_often > ROOM:
        least = often.agg(F.percentile_approx("c", 1 - 0.9 * ROOM / n_often, 100_000)).scalar()
        often = often.filter(F.col("c") > least)
        n_often = often.count()
    return often.sparkSession.sparkContext.broadcast(bit_table(often.select("h"), n_often))


def components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Two documents link when |A & B| / |A | B| >= num / den over their sets of ``size``-word shingles; a text of fewer
    words is one shingle, and one without words, null or empty, has none and links with nothing. component_id is the
    smallest doc_id that links reach. A row without doc_id links with nothing and has no component. A doc_id stands for
    one text; repeated rows are returned as often as they come. Very long texts are taken whole; columns of any other name
    are not read; pairs just at the bound link. An empty table gives no row.
    """
    named = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = named.filter(F.col("doc_id").isNotNull())
    often = named.select("text").mapInPandas(functools.partial(_frequent, size), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= IN_ALL)
    often = settle(often, "frequent")
    frequent = _filter(often)
    # what is frequent over all tasks but not within one shows in the first blocks: these are counted exactly, then made anew
    again = named.select("text").mapInPandas(functools.partial(_firsts, size, num, den, frequent), "h int").groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    again = again.filter(F.col("c") >= IN_ALL).select(F.col("h").cast("long").alias("h"), "c")
    low = F.col("h").bitwiseAND(F.lit((1 << 32) - 1)).alias("h")
    both = settle(often.union(again).groupBy(low).agg(F.max("c").alias("c")), "late")
    frequent.unpersist()
    frequent = _filter(both)
    rows = settle(named.mapInPandas(functools.partial(_rows, size, num, den, frequent), "doc_id long, n long, d1 long, d2 long, first array<long>"), "rows")
    frequent.unpersist()

    # rows of the matrix: distinct sets, named by their smallest document
    full = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    nodes = settle(full.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.first("first").alias("first")), "nodes")
    cells = nodes.select("node", "n", F.posexplode("first").alias("p", "gram")).select("gram", "node", (F.col("n") * F.lit(1 << 32) + F.col("p")).alias("np"))
    shared = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("gram")
    # what is summed is written before it is joined back, so that a column of very many rows can be split in the join
    shared = settle(shared, "shared")
    cells = settle(cells.join(shared, "gram"), "cells")
    # the first blocks are in the cells now
    wide, rows, nodes = (rows, nodes), settle(rows.select("doc_id", "n", "d1", "d2"), "documents"), settle(nodes.select("d1", "d2", "node"), "named")
    for done in (*wide, shared):
        drop(done)
    n, p = F.shiftright("np", 32), F.col("np").bitwiseAND(F.lit((1 << 32) - 1))
    cells = cells.select("gram", "node", n.alias("n"), p.alias("p"))
    # the smaller (or equal) row of a linked pair has a shared column among these
    head = cells.filter(F.col("n") - F.col("p") >= required(F.col("n"), F.col("n"), num, den))

    def room(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
        small, large = F.least(n1, n2), F.greatest(n1, n2)
        return (small * den >= large * num) & (F.least(n1 - p1, n2 - p2) >= required(n1, n2, num, den))

    lead = head.groupBy("gram").agg(F.min(F.struct("p", "node", "n")).alias("l")).select("gram", F.col("l.node").alias("a"), F.col("l.n").alias("na"), F.col("l.p").alias("pa"))
    lead = settle(lead, "lead")
    met = cells.join(lead, "gram").filter((F.col("node") != F.col("a")) & room(F.col("n"), F.col("p"), F.col("na"), F.col("pa")))
    met = met.groupBy(F.col("node").alias("b"), "a").agg(F.count(F.lit(1)).alias("hits"))
    best = Window.partitionBy("b").orderBy(F.col("hits").desc(), "a")
    links = _linked(texts, cells, met.withColumn("k", F.row_number().over(best)).filter("k = 1").select("a", "b"), size, num, den)

    group = _stars(links)
    grouped = cells.join(group, "node", "left").select("gram", "node", "n", "p", F.coalesce("c", "node").alias("c"))
    mixed = grouped.groupBy("gram").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("gram")
    rest = settle(grouped.join(settle(mixed, "mixed"), "gram"), "rest")
    heads = rest.filter(F.col("n") - F.col("p") >= required(F.col("n"), F.col("n"), num, den))
    bound = heads.groupBy("gram", F.col("n").alias("na"), F.col("c").alias("ca")).agg(F.min("p").alias("pa"))
    bound = settle(bound, "bound")
    larger = rest.toDF("gram", "b", "nb", "pb", "cb")
    open_ = larger.join(bound, "gram").filter((F.col("ca") != F.col("cb")) & (F.col("na") <= F.col("nb")) & room(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb")))
    smaller = heads.select("gram", F.col("n").alias("na"), F.col("c").alias("ca"), F.col("node").alias("a"), F.col("p").alias("p1"))
    pairs = open_.drop("pa").join(smaller, ["gram", "na", "ca"]).filter(room(F.col("na"), F.col("p1"), F.col("nb"), F.col("pb")))
    more = _linked(texts, cells, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), size, num, den)
    known = settle(connected(links.union(more)), "components")

    named_rows = rows.select("doc_id", "n", "d1", "d2").join(nodes.select("d1", "d2", "node"), ["d1", "d2"], "left").join(known, "node", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "node", "doc_id")).otherwise(F.col("doc_id"))
    return named_rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS g FROM w
), n AS (SELECT doc_id, len(g) AS n FROM s),
g AS (SELECT doc_id, unnest(g) AS gram FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.v)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY 1, 2
"""
