"""The corpus pipeline: language, near duplicates, secrets, mixture, tokens."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, mixing, ngram_join, pieces, secrets
from tessera.llm.common import settle


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model gives a language with at least half of their letters; the others go.

    Texts that are null, empty or without letters go, as does every row where no labelled row is left to learn from. Very
    long texts are read whole, repeated rows are judged each, of languages with equal shares the first by name counts."""
    return language.accepted(docs, language.learn(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8: the smallest doc_id; rows without one stay.

    Of rows that share a doc_id the least by all columns stays. Null and empty texts link with nothing and stay; very long
    texts are compared whole."""
    found = settle(ngram_join.components(docs.select("doc_id", "text"), size=5, num=80, den=100), "groups")
    own = "_" * (1 + max(map(len, docs.columns)))  # the name of no column of docs
    others = found.filter("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct()
    kept = docs.join(settle(others, "others"), F.col("doc_id") == F.col(own), "left_anti")
    again = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(own)
    again = settle(again, "repeated")
    if not again.take(1):
        return kept
    once = kept.join(again, F.col("doc_id") == F.col(own), "left_anti")
    least = F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(own)  # in parts before the shuffle
    rest = kept.join(again, F.col("doc_id") == F.col(own), "left_semi").groupBy("doc_id").agg(least)
    return once.unionByName(rest.select(f"{own}.*"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked and n_chars counted anew.

    A null text stays null and has no n_chars, an empty one stays empty; repeated rows are masked each, spans that overlap
    as one; very long texts are scanned whole."""
    masked = docs.withColumn("text", secrets.masked("text"))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice, by tempered weights.

    A null source is a source; null and empty texts have no tokens and are drawn where they fall in the order; repeated
    rows are drawn each, equal ones at a cut by their number; ties of the order go by doc_id, then by tokens."""
    return mixing.draw_documents(docs, max_passes=2.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: a row for each draw. A null or empty text has none; very long texts are encoded whole.

    Workers stand beside executors that hold what the stages before have left, so they remember few words."""
    return pieces.encode_documents(docs, pieces.default_model(), remembered=50_000)


def small_batches(stage):
    """The stage with whole texts going to Python 1,000 at a time, so that workers and Arrow buffers stay small."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language", small_batches(known_language)),
    ("near_duplicates", small_batches(one_of_each_group)),
    ("secrets", small_batches(without_secrets)),
    ("mixture", small_batches(mixed)),
    ("tokens", small_batches(tokens)),
]

#: SQL can't express the language model or the tokenizer; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage before it is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, f"stage_{name}")
    return docs
