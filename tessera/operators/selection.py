"""The selection state machine: scores, floors, decisions and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lexicon import Lexicon
from tessera.functions.text import content_tier, once, reason_allows, topic_match

PUBLISH, SIGNAL, MUST_READ, DIMENSION_MAX = 8, 8, 30, 20
DIMENSIONS = ("frontier", "industry_model", "regulatory", "dispute", "normative")


def event_dimension(title: Column, lex: Lexicon) -> Column:
    return F.coalesce(*[F.when(title.rlike(p), name) for name, p in lex.events])


def objective_floor(title: Column, tier: Column, score: Column, dims: dict[str, Column], lex: Lexicon) -> Column:
    """struct(score, one field for each dimension): an event with a whole text is lifted to the publishing score.

    Its dimension grows by what the score lacks, at most to DIMENSION_MAX, and the score becomes the dimensions' sum.
    """
    event = event_dimension(title, lex)
    lift = F.coalesce((score < PUBLISH) & event.isNotNull() & topic_match(title, lex) & (tier == "full"), F.lit(False))
    lifted = {d: F.when(lift & (event == d), F.least(F.lit(DIMENSION_MAX), c + PUBLISH - score)).otherwise(c) for d, c in dims.items()}
    total = sum(list(lifted.values())[1:], next(iter(lifted.values())))
    return F.struct(F.when(lift, total).otherwise(score).alias("score"), *[c.alias(d) for d, c in lifted.items()])


def decide_selection(pre_filtered: Column, method: Column, score: Column, tier: Column, reason: Column, lex: Lexicon) -> Column:
    """struct(status, reason). A null score counts as 0, one that is no finite number as missing."""
    value = F.coalesce(score, F.lit(0.0))
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))

    def row(status: str, why: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(why).alias("reason"))

    return (
        F.when(~F.coalesce(pre_filtered, F.lit(False)), row("rejected", "not_pre_filtered"))
        .when(F.coalesce(method != "llm", F.lit(True)), row("pending", "signal"))
        .when(finite & (value >= PUBLISH) & (tier == "full") & reason_allows(reason, lex), row("selected", "publishable"))
        .when(~finite | (value >= SIGNAL), row("pending", "signal"))
        .otherwise(row("rejected", "irrelevant"))
    )


def normalize_reason(score: Column, reason: Column, excerpt: Column, lex: Lexicon) -> Column:
    """A reason that contradicts a publishable score is written anew, 400 characters at most."""
    value = F.nullif(F.trim(reason), F.lit(""))
    tier = F.when(score >= MUST_READ, "must read").otherwise("industry update")
    fact = F.coalesce(F.concat(F.lit("Key fact: "), F.nullif(F.trim(excerpt), F.lit(""))), F.lit("The text is on topic."))
    anew = F.substring(F.concat(F.lit("Checked as "), tier, F.lit(". "), fact), 1, 400)
    keep = (F.coalesce(score, F.lit(0.0)) < PUBLISH) | value.isNull() | ~value.rlike(lex.contradictory_reason)
    return F.when(keep, value).otherwise(anew)


def parse_scores(payload: Column) -> Column:
    """struct(score, dimensions) of a model's answer: as it is, without fences, or its outermost braces.

    The score is at the root, in data or in result; it must lie in 0..100. A missing dimension is a fifth of it, each is
    clamped to 0..DIMENSION_MAX and rounded, and the total is their sum.
    """
    bare = F.trim(F.regexp_replace(payload, "(?s)^\\s*```[a-z]*|```\\s*$", ""))
    braces = F.regexp_extract(payload, "(?s)(\\{.*\\})", 1)
    parsed = F.coalesce(F.try_parse_json(payload), F.try_parse_json(bare), F.try_parse_json(braces))

    def value(answer: Column, path: str) -> Column:
        return F.coalesce(*[F.try_variant_get(answer, f"${at}.{path}", "double") for at in ("", ".data", ".result")])

    return once(parsed, lambda answer: once(value(answer, "score"), lambda score: _scored(score, [value(answer, d) for d in DIMENSIONS])))


def _scored(score: Column, found: list[Column]) -> Column:
    dims = [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(DIMENSION_MAX)), F.coalesce(v, F.floor(score / 5 + 0.5)))) + 0.5).cast("int").alias(d) for d, v in zip(DIMENSIONS, found, strict=True)]
    return F.when((score >= 0) & (score <= 100), F.struct(score.alias("score"), *dims))


def reconcile(df: DataFrame, lex: Lexicon) -> DataFrame:
    """Decide every article anew and keep the rows whose status changes: id, old_status, status, reason, tier.

    ``df``: id, content, pre_filtered, scoring_method, score, ai_reason, status.
    """
    tier = content_tier(F.col("content"), F.lit(None).cast("string"))
    new = decide_selection(F.col("pre_filtered"), F.col("scoring_method"), F.col("score"), tier, F.col("ai_reason"), lex)
    return df.select("id", F.col("status").alias("old_status"), tier.alias("tier"), new.alias("d")).filter(~F.col("old_status").eqNullSafe(F.col("d.status"))).select("id", "old_status", "d.status", "d.reason", "tier")


def reopen(df: DataFrame) -> DataFrame:
    """A rejected article that now has a whole text (column tier) is pending again; its method, reason and time of scoring go."""
    again = F.coalesce((F.col("status") == "rejected") & (F.col("tier") == "full"), F.lit(False))
    gone = {c: F.when(~again, F.col(c)) for c in ("scoring_method", "ai_reason", "scored_at") if c in df.columns}
    return df.withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), **gone})
