"""Feed sources as frames: RSS, JSON lists of three shapes, and their dispatch by kind of source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import plain_text

ITEM = "title string, link string, description string, pubDate string"
COLUMNS = ("source_id", "title", "link", "excerpt", "pub_date")


def read_rss(spark: SparkSession, path: str, source_id: str, as_of: Column) -> DataFrame:
    """Items with a title and a link; a missing or unreadable date is the time of reading."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path).filter("title is not null and link is not null")
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("pubDate"), as_of)
    return rows.select(F.lit(source_id).alias("source_id"), F.trim("title").alias("title"), F.trim("link").alias("link"), F.substring(plain_text(F.col("description")), 1, 200).alias("excerpt"), when.alias("pub_date"))


def read_json_list(spark: SparkSession, path: str, source_id: str, schema: str, rows: str, title: str, links: list[str], excerpt: str | None, date: str, as_of: Column, most: int = 50) -> DataFrame:
    """Items of a JSON answer: ``rows`` is the list inside it, ``links`` the fields that may hold the address, in order.

    A placeholder text is no excerpt. The first ``most`` items of each answer are taken, as the source limits them.
    """
    answers = spark.read.schema(schema).option("multiLine", True).json(path)
    items = answers.select(F.posexplode(F.slice(F.col(rows), 1, most)).alias("place", "r"))
    text = F.coalesce(plain_text(F.col(f"r.{excerpt}")), F.lit("")) if excerpt else F.lit("")
    link = F.coalesce(*[F.nullif(F.trim(F.col(f"r.{c}")), F.lit("")) for c in links])
    found = items.select(
        F.lit(source_id).alias("source_id"), F.trim(F.col(f"r.{title}")).alias("title"), link.alias("link"), F.when(text.isin("暂无", "none"), "").otherwise(F.substring(text, 1, 200)).alias("excerpt"),
        F.coalesce(F.try_to_timestamp(F.col(f"r.{date}")), as_of).alias("pub_date"),
    )
    return found.filter("title is not null and link is not null")


def dispatch(parts: list[DataFrame]) -> DataFrame:
    """All sources' items, the first of each link."""
    both = reduce(DataFrame.unionByName, [p.select(*COLUMNS) for p in parts])
    return both.groupBy("link").agg(F.min_by(F.struct("source_id", "title", "excerpt", "pub_date"), F.struct("pub_date", "source_id", "title")).alias("r")).select("r.source_id", "r.title", "link", "r.excerpt", "r.pub_date")
