"""Answers of the public interface as it sends them: JSON that keeps nulls, its entity tag, and the answer that nothing has changed.

The tag is a polynomial of a body's UTF-16 units by 31, modulo 2**32. Of two neighbouring parts it follows from the value
and the length of each, so parts are hashed where they are and folded in groups, level by level, and no row or task holds the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that one group folds, and levels of groups: their power bounds the number of parts.
FOLD, LEVELS = 1_000, 4
_MASK = (1 << 32) - 1


def _times(a: Column, b: Column) -> Column:
    """The product of two numbers below 2**32, modulo 2**32, without a step beyond 64 bits."""
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(0xFFFF), 16)
    return (high + a * b.bitwiseAND(0xFFFF)).bitwiseAND(_MASK)


def _power(n: Column) -> Column:
    """31 to the n, modulo 2**32, by squaring."""
    one = F.struct(F.lit(1).cast("long").alias("r"), F.lit(31).cast("long").alias("b"), n.cast("long").alias("n"))

    def step(s: Column, _: Column) -> Column:
        odd = s["n"].bitwiseAND(1) == 1
        return F.struct(F.when(odd, _times(s["r"], s["b"])).otherwise(s["r"]).alias("r"), _times(s["b"], s["b"]).alias("b"), F.shiftright(s["n"], 1).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), one, step)["r"]


def text_hash(text: Column) -> Column:
    """value and length of a text; null counts as empty."""
    units = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    value = F.aggregate(units, F.lit(0).cast("long"), lambda s, u: (s * 31 + F.conv(u, 16, 10).cast("long")).bitwiseAND(_MASK))
    return F.struct(value.alias("value"), F.size(units).cast("long").alias("length"))


def joined(parts: Column) -> Column:
    """value and length of the parts (value, length) of an array, one after the other."""
    begun = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("length"))
    fold = lambda s, x: F.struct((_times(s["value"], _power(x["length"])) + x["value"]).bitwiseAND(_MASK).alias("value"), (s["length"] + x["length"]).alias("length"))
    return F.aggregate(parts, begun, fold)


def tag(value: Column) -> Column:
    return F.concat(F.lit('"'), F.lower(F.hex(value)), F.lit('"'))


def etag(parts: DataFrame, place: str = "place", text: str = "text") -> DataFrame:
    """One row, etag: of all texts in order of ``place`` (whole numbers from 0, each once)."""
    rows = parts.select(F.col(place).cast("long").alias("place"), text_hash(F.col(text)).alias("h"))
    for _ in range(LEVELS):
        group = F.floor(F.col("place") / FOLD).cast("long")
        folded = rows.groupBy(group.alias("group")).agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("parts"))
        rows = folded.select(F.col("group").alias("place"), joined(F.transform("parts", lambda p: p["h"])).alias("h"))
    return rows.agg(F.coalesce(F.max("h.value"), F.lit(0).cast("long")).alias("value")).select(tag(F.col("value")).alias("etag"))


def as_json(*columns: str) -> Column:
    """A row as JSON, its nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def answer(page: DataFrame, columns: tuple[str, ...], place: str = "place", known: str | None = None) -> DataFrame:
    """One row, status, etag, body: a page of items (a limited list, places from 0) as a JSON list; 304 without a body where the
    reader's ``known`` tag is that of the body."""
    rows = page.select(F.col(place).alias("place"), as_json(*columns).alias("text"))
    body = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda r: r["text"]), ","), F.lit("]"))
    parts = rows.select("place", F.concat(F.when(F.col("place") == 0, "[").otherwise(","), "text").alias("text"))
    made = rows.agg(body.alias("body"), F.count(F.lit(1)).alias("n"))
    ends = made.select(F.col("n").alias("place"), F.when(F.col("n") == 0, "[]").otherwise("]").alias("text"))
    same = F.col("etag") == F.lit(known) if known is not None else F.lit(False)
    whole = etag(parts.unionByName(ends))
    return made.withColumn("etag", whole.scalar()).select(F.when(same, 304).otherwise(200).alias("status"), "etag", F.when(~same, F.col("body")).alias("body"))
