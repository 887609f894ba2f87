"""Article tables over the driver's tables, in Spark and as SQL common table expressions.

``articles`` maps documents and labels: time, score, status and method are derived from doc_id, so that every rule of
the state machine has rows. ``order_items`` maps orders for the listings and reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-03-01 00:00:00"
CATEGORIES = ("frontier", "industry_model", "regulatory", "dispute", "normative")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("id")
    # before the join, so that a query of titles alone shuffles no text
    docs = docs.withColumn("title", F.substring(F.substring_index("text", "\n", 1), 1, 80))
    named = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "title",
        F.col("text").alias("content"),
        F.col("source").alias("source_name"),
        (F.col("quality") == 1).alias("pre_filtered"),
        F.when(F.col("toxic") == 1, "seen as promotion").otherwise("on topic").alias("ai_reason"),
    )
    return named.select(
        "*",
        F.concat(F.lit("https://example.org/"), F.when(i % 9 == 0, "training/").otherwise("a/b/"), i).alias("url"),
        F.timestamp_add("HOUR", (i % 1440).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("pub_date"),
        F.when(i % 11 != 0, (i * 37) % 41).cast("double").alias("score"),
        F.when(i % 4 == 0, "rule").otherwise("llm").alias("scoring_method"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (i % 5 + 1).cast("int")).alias("category"),
    )


ARTICLES = """
art AS (
  SELECT *, 'https://example.org/' || CASE WHEN id % 9 = 0 THEN 'training/' ELSE 'a/b/' END || id AS url,
    TIMESTAMP '2024-01-01' + (id % 1440) * INTERVAL 1 HOUR AS pub_date,
    CASE WHEN id % 11 <> 0 THEN ((id * 37) % 41)::DOUBLE END AS score,
    CASE WHEN id % 4 = 0 THEN 'rule' ELSE 'llm' END AS scoring_method,
    (['frontier', 'industry_model', 'regulatory', 'dispute', 'normative'])[(id % 5 + 1)::INT] AS category
  FROM (
    SELECT d.doc_id AS id, left(split_part(d.text, chr(10), 1), 80) AS title, d.text AS content, d.source AS source_name,
      l.quality = 1 AS pre_filtered, CASE WHEN l.toxic = 1 THEN 'seen as promotion' ELSE 'on topic' END AS ai_reason
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  )
)"""


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.col("o_orderstatus")
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("pub_date"), F.floor(F.col("o_totalprice") % 41).cast("double").alias("score"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.substring("o_orderpriority", 1, 1).cast("int")).alias("category"),
        F.when(status == "F", "selected").when(status == "O", "pending").otherwise("rejected").alias("status"),
        F.concat(F.lit("Item "), k, F.when(k % 3 == 0, " North").otherwise("")).alias("title"),
    )


ITEMS = """
item AS (
  SELECT o_orderkey AS id, o_custkey AS source_id, o_orderdate AS pub_date, floor(o_totalprice % 41)::DOUBLE AS score,
    (['frontier', 'industry_model', 'regulatory', 'dispute', 'normative'])[left(o_orderpriority, 1)::INT] AS category,
    CASE o_orderstatus WHEN 'F' THEN 'selected' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
    'Item ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ' North' ELSE '' END AS title
  FROM orders
)"""
