"""The whole news chain: pre-filter, quality, classification, floor, decision, clusters, ranked list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicon import Lexicon
from tessera.operators import selection, similarity
from tessera.sources.shared import settle


def decide_all(articles: DataFrame, lex: Lexicon, dims: dict) -> DataFrame:
    """``articles`` (id, title, content, source_name, url, pub_date, score, scoring_method, ai_reason) with their verdicts.

    The steps are columns of one scan: nothing is shuffled up to here.
    """
    title, content, source, url = (F.col(c) for c in ("title", "content", "source_name", "url"))
    verdict = T.pre_filter(T.keyword_filter(title, content, source, url, lex), title, content, url, lex)
    tier = T.content_tier(content, F.lit(None).cast("string"))
    with_tier = articles.withColumns({"passes": verdict, "tier": tier, "class": T.classify(title, content, lex)})
    floored = with_tier.withColumn("floor", selection.objective_floor(title, F.col("tier"), F.col("score"), dims, lex))
    decided = floored.withColumn("decision", selection.decide_selection(F.col("passes"), F.col("scoring_method"), F.col("floor.score"), F.col("tier"), F.col("ai_reason"), lex))
    return decided.select(
        "id", "title", "source_name", "pub_date", "tier", F.col("class.section").alias("section"), F.col("floor.score").alias("score"), F.col("decision.status").alias("status"),
        F.col("decision.reason").alias("reason"), T.sentence_excerpt(T.plain_text(content)).alias("excerpt"),
    )


def run(articles: DataFrame, lex: Lexicon, dims: dict, days: int = 14) -> DataFrame:
    """Decided articles with the topic cluster of those selected or pending, and whether they lead it."""
    decided = settle(decide_all(articles, lex, dims), "decided")
    live = decided.filter("status <> 'rejected'")
    topics = similarity.clusters(live.select("id", "score"), similarity.title_forest(live.select("id", "title", "pub_date"), days=days))
    best = topics.groupBy("cluster").agg(F.max_by("id", F.struct(F.coalesce("score", F.lit(0.0)), -F.col("id"))).alias("lead"))
    named = topics.join(best, "cluster").select("id", "cluster", (F.col("id") == F.col("lead")).alias("leads"))
    return decided.join(named, "id", "left")
