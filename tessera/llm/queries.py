"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chaining, chat, collision, fim, html_template, importance, language, mixing, ngram_join, pieces, secrets, toxicity, voronoi
from tessera.llm.common import table


def op1_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(table(spark, sf_dir, "embeddings"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op3_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


#: Grades: not toxic, toxic, toxic and of low quality.
SEVERITY = "toxic * (2 - quality)"


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), SEVERITY))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op6_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.nearest(table(spark, sf_dir, "embeddings"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), pieces.default_model())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op9_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


#: Every query, and its SQL where there is one.
ALL = (
    (op1_voronoi, voronoi.ORACLE),
    (op2_ngram_join, ngram_join.ORACLE),
    (op3_chaining, None),
    (op4_toxicity, None),
    (op5_secrets, None),
    (op6_collision, None),
    (op7_pieces, None),
    (op8_language, None),
    (op9_html_template, None),
    (op10_mixing, mixing.ORACLE),
    (op11_importance, importance.ORACLE),
    (op12_chat, chat.ORACLE),
    (op13_fim, fim.ORACLE),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f, _ in ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in ALL if sql}
