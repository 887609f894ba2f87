"""Writes as frame algebra: what a table holds after an upsert, an insert, an expiry or an update."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import xml_escape


def upsert(target: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``target`` that no update replaces, and the updates. Keys are unique in ``updates``."""
    return target.join(updates.select(*key), key, "left_anti").unionByName(updates, allowMissingColumns=True)


def insert_if_absent(target: DataFrame, batch: DataFrame, key: list[str], order: list) -> DataFrame:
    """The rows of ``batch`` that are inserted: the first of each key, where the target has none."""
    first = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
    return first.join(target.select(*key), key, "left_anti")


def changed_only(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of ``new`` that differ from ``old`` in some field, nulls being equal to nulls."""
    before = old.select(key, *[F.col(f).alias(f"_old_{f}") for f in fields])
    differs = reduce(lambda a, f: a | ~F.col(f).eqNullSafe(F.col(f"_old_{f}")), fields, F.lit(False))
    return new.join(before, key).filter(differs).select(*new.columns)


def expire(df: DataFrame, as_of: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows deleted): those older than ``days`` go; a row without a time stays."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")
    gone = F.coalesce(F.col("pub_date") < cutoff, F.lit(False))
    return df.filter(~gone), df.filter(gone)


def last_value_first_place(df: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """Distinct keys with their last value at their first place."""
    return df.groupBy(key).agg(F.min(place).alias("first_place"), F.max_by(value, place).alias("last_value"))


def snapshot_guard(fresh: DataFrame, existing: DataFrame, key: list[str], today: str, force: bool = False) -> DataFrame:
    """A closed period keeps the report it has. ``period_end`` tells whether it is closed."""
    closed = existing.filter((F.col("period_end") < F.lit(today).cast("date")) & F.lit(not force))
    return fresh.join(closed.select(*key), key, "left_anti").unionByName(closed, allowMissingColumns=True)


def feed_xml(items: DataFrame, title: str, link: str, description: str = "", language: str = "en", built: Column | None = None) -> DataFrame:
    """One row, xml: an RSS 2.0 feed of ``items`` (place, title, link, description, pub_date, guid, category), a limited list.

    A missing category or date has no element; ``built`` is the time of the feed, left out without one."""

    def element(name: str, value: Column, attributes: str = "") -> Column:
        return F.concat(F.lit(f"<{name}{attributes}>"), xml_escape(F.coalesce(value, F.lit(""))), F.lit(f"</{name}>"))

    def where(value: Column, shown: Column) -> Column:
        return F.when(value.isNotNull(), shown).otherwise(F.lit(""))

    category = F.nullif(F.col("category"), F.lit(""))
    item = F.concat(
        F.lit("<item>"), *[element(c, F.col(c)) for c in ("title", "link", "description")], where(F.col("pub_date"), element("pubDate", feed_time(F.col("pub_date")))),
        element("guid", F.col("guid").cast("string"), ' isPermaLink="false"'), where(category, element("category", category)), F.lit("</item>"),
    )
    rows = items.agg(F.array_sort(F.collect_list(F.struct("place", item.alias("x")))).alias("rows"))
    head = [element(n, F.lit(v)) for n, v in (("title", title), ("link", link), ("description", description), ("language", language))]
    head += [] if built is None else [element("lastBuildDate", feed_time(built))]
    return rows.select(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'), *head, F.array_join(F.transform("rows", lambda r: r["x"]), ""), F.lit("</channel></rss>")).alias("xml"))


def feed_time(ts: Column) -> Column:
    """A time as feeds write it, in UTC."""
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
