"""Listings: filters, keyset and offset pages, look-ups, counts and shaping of public items."""

from __future__ import annotations

import base64
import binascii
import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import beijing_date, encode_cursor

LABELS = {"frontier": "Frontier", "industry_model": "Industry", "regulatory": "Regulation", "dispute": "Disputes", "normative": "Norms"}


def clamp(value, low: int, high: int, default: int) -> int:
    """A request parameter within bounds; what is no number gives the default."""
    try:
        return min(max(int(value), low), high)
    except (TypeError, ValueError):
        return default


def published(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "selected")


def not_rejected(status: Column) -> Column:
    return status.isNull() | (status != "rejected")


def newest(df: DataFrame, n: int, *ties: Column) -> DataFrame:
    """Newest first, nulls first as in the source system; ties by the given keys."""
    return df.orderBy(F.col("pub_date").desc_nulls_first(), *(ties or (F.col("id").desc(),))).limit(n)


def since(df: DataFrame, as_of: str, days: int) -> DataFrame:
    return df.filter(F.col("pub_date") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))


def filter_then_slice(df: DataFrame, fetch: int, keep: Column, offset: int, limit: int) -> DataFrame:
    """The newest ``fetch`` rows first, then the filter, then a page of what is left, with the filtered total."""
    kept = newest(df, fetch).filter(keep)
    return kept.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy())).orderBy(F.col("pub_date").desc_nulls_first(), F.col("id").desc()).offset(offset).limit(limit)


def decode_cursor(raw: str) -> tuple[dt.datetime, int] | None:
    """(time, id) of a cursor, or None if it is not one."""
    try:
        ts, key = base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)).decode().split("|")
        return dt.datetime.fromisoformat(ts), int(key)
    except (binascii.Error, ValueError, UnicodeDecodeError):
        return None


def clean_search(q: str) -> str:
    """Search words without pattern marks; the one-character wildcard is left as it is."""
    return "".join(" " if c in ",%()" else c for c in q).strip()[:80]


def after_cursor(df: DataFrame, cursor: tuple[dt.datetime, int] | None) -> DataFrame:
    if cursor is None:
        return df
    ts, key = F.lit(cursor[0]), cursor[1]
    return df.filter((F.col("pub_date") < ts) | ((F.col("pub_date") == ts) & (F.col("id") < key)))


def search(df: DataFrame, q: str | None, columns: tuple[str, ...]) -> DataFrame:
    words = clean_search(q or "")
    if not words:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{words}%"), F.lit(False))
    return df.filter(hit)


def items(df: DataFrame, category: str | None = None, take: int = 20, cursor: tuple[dt.datetime, int] | None = None, q: str | None = None, columns: tuple[str, ...] = ("title",)) -> DataFrame:
    """A keyset page with one row of look-ahead: has_more and the number of rows under all filters, cursor included."""
    rows = search(after_cursor(df if category is None else df.filter(F.col("category") == category), cursor), q, columns)
    total = rows.agg(F.count(F.lit(1))).scalar()
    page = rows.orderBy(F.col("pub_date").desc(), F.col("id").desc()).limit(take + 1)
    place = F.row_number().over(Window.orderBy(F.col("pub_date").desc(), F.col("id").desc()))  # take + 1 rows
    return page.withColumn("place", place).withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) > take).filter(F.col("place") <= take).withColumn("total", total)


def items_page(df: DataFrame, mode: str = "selected", category: str | None = None, after: str | None = None, take: int = 20, cursor: str | None = None, q: str | None = None, columns: tuple[str, ...] = ("title",)) -> DataFrame:
    """The public listing: ``mode`` selected (published items) or all (pending ones too), published from ``after`` on, of one
    category, behind a cursor, matching ``q``. On a page that more rows follow, next_cursor tells where to go on; what can't be read
    as a cursor is an error."""
    if cursor and decode_cursor(cursor) is None:
        raise ValueError(f"{cursor!r} is no cursor")
    rows = published(df) if mode == "selected" else df.filter(F.col("status").isin("selected", "pending"))
    rows = rows if after is None else rows.filter(F.col("pub_date") >= F.lit(after).cast("timestamp"))
    page = items(rows, category, take, decode_cursor(cursor) if cursor else None, q, columns)
    last = F.col("has_more") & (F.col("place") == F.max("place").over(Window.partitionBy()))  # of one page
    return page.withColumn("next_cursor", F.when(last, encode_cursor(F.col("pub_date"), F.col("id"))))


def public_item(df: DataFrame) -> DataFrame:
    """The public shape: score 0 for none, the category's label, the review tier."""
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("category")]
    return df.select(
        "id", "title", F.coalesce("score", F.lit(0.0)).alias("score"), "category", F.coalesce(label, F.lit("News")).alias("category_label"),
        F.when(F.col("status") == "selected", "selected").otherwise("signal").alias("review_tier"), beijing_date(F.col("pub_date")).alias("day"),
    )


def lookup(df: DataFrame, key: int | Column) -> DataFrame:
    """The row of a key if there is exactly one."""
    return df.filter(F.col("id") == key).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id"))).filter("_n = 1").drop("_n")


def details(df: DataFrame) -> DataFrame:
    """The articles that a detail page shows: pre-filtered, selected or pending, with a whole text (column content_quality)."""
    shown = df.filter(F.col("pre_filtered") & F.col("status").isin("selected", "pending") & (F.col("content_quality") == "full"))
    return shown.withColumn("review_tier", F.when(F.col("status") == "selected", "selected").otherwise("signal"))


def date_groups(df: DataFrame) -> DataFrame:
    """Each day's items by score, null as 0: day, place, id, score."""
    order = Window.partitionBy("day").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "id")
    return df.withColumn("day", beijing_date(F.col("pub_date"))).withColumn("place", F.row_number().over(order)).select("day", "place", "id", "score")


def home_focus(df: DataFrame, today: str) -> DataFrame:
    """The best item of today, or of all days where today has none."""
    now = (beijing_date(F.col("pub_date")) == F.lit(today).cast("date")).cast("int")
    return df.withColumn("is_today", now).orderBy(F.desc("is_today"), F.coalesce("score", F.lit(0.0)).desc(), "id").limit(1)


def relative_day(day: Column, today: Column) -> Column:
    gap = F.datediff(today, day)
    return F.when(gap == 0, "today").when(gap == 1, "yesterday").otherwise(F.date_format(day, "yyyy-MM-dd EEE"))
