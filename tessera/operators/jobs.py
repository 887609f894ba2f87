"""Maintenance jobs over the article table as column updates: what the source system does in chunks of ids is one plan here.

Every job takes the whole table and returns its changed rows or the table after the change; clocks are given, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.lexicon import Lexicon
from tessera.functions.text import candidate_match, cap_at_sentence, classify, content_tier, exclusion_reason, is_dirty, plain_text, sentence_excerpt
from tessera.operators.selection import decide_selection

def whole_text() -> Column:
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))


def tier() -> Column:
    return content_tier(F.col("content"), F.lit(None).cast("string"))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """The table with new values in the rows where the condition holds; a null condition changes nothing."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({name: F.when(hit, value.cast(df.schema[name].dataType)).otherwise(F.col(name)) for name, value in values.items()})


def touched(df: DataFrame, changed: Column, as_of: Column) -> DataFrame:
    """updated_at becomes ``as_of`` in the changed rows."""
    return df.withColumn("updated_at", F.when(F.coalesce(changed, F.lit(False)), as_of).otherwise(F.col("updated_at")))


def assign(df: DataFrame, batch: DataFrame, key: str, column: str) -> DataFrame:
    """The table with ``column`` taken from the batch (key, column) for the keys it names, null included; of a repeated key
    the largest value counts."""
    new = batch.groupBy(F.col(key).alias("_key")).agg(F.max(column).alias("_new"))
    found = df.join(new, F.col(key) == F.col("_key"), "left")
    return found.select(*[F.when(F.col("_key").isNotNull(), F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns])


def reset_scores(df: DataFrame) -> DataFrame:
    """Scores of models over whole texts are taken back, so that they are made anew."""
    again = (F.col("scoring_method") == "llm") & F.col("score").isNotNull() & F.coalesce("pre_filtered", F.lit(True)) & (tier() == "full")
    return update_where(df, again, dict.fromkeys(("score", "ai_reason", "scoring_method"), F.lit(None)))


def rebuild_pool(df: DataFrame, lex: Lexicon) -> DataFrame:
    """Candidates and items of listed sources are pending without a score, all others rejected. ``df`` has a status."""
    keep = candidate_match(whole_text(), lex) | F.coalesce(F.col("source_name").isin(*lex.whitelist), F.lit(False))
    status = F.when(keep, "pending").otherwise("rejected")
    return df.withColumns({"pre_filtered": keep, "status": status, "is_selected": F.lit(False), "score": F.when(~keep, F.col("score"))})


def rescreen(df: DataFrame, lex: Lexicon) -> DataFrame:
    """The pre-filtered rows that are excluded or off topic by now, with the reason (null: off topic)."""
    reason = exclusion_reason(F.col("title"), F.col("url"), lex)
    found = df.filter("pre_filtered").select("id", reason.alias("reason"), candidate_match(whole_text(), lex).alias("candidate"))
    return found.filter(F.col("reason").isNotNull() | ~F.col("candidate")).select("id", F.lit("rejected").alias("status"), F.lit(False).alias("pre_filtered"), "reason")


def quality_fields(df: DataFrame, as_of: Column) -> DataFrame:
    """The table with content_quality, content_word_count (characters of the plain text) and content_checked_at."""
    return df.withColumns({"content_quality": tier(), "content_word_count": F.length(plain_text(F.col("content"))), "content_checked_at": as_of})


def backfill_quality(df: DataFrame, lex: Lexicon, as_of: Column) -> DataFrame:
    """Decision and quality fields of every row."""
    d = decide_selection(F.col("pre_filtered"), F.col("scoring_method"), F.col("score"), tier(), F.col("ai_reason"), lex)
    rows = quality_fields(df, as_of).withColumn("d", d)
    return rows.select("id", F.col("d.status").alias("status"), (F.col("d.status") == "selected").alias("is_selected"), "content_quality", "content_word_count", "content_checked_at")


def reclassify(df: DataFrame, lex: Lexicon) -> DataFrame:
    """Rows whose category by the rules is another one: id, old_category, category."""
    new = classify(F.col("title"), F.col("content"), lex)["section"]
    return df.select("id", F.col("category").alias("old_category"), new.alias("category")).filter(~F.col("old_category").eqNullSafe(F.col("category")))


def backfill_excerpts(df: DataFrame) -> DataFrame:
    """New excerpts of rows that no model scored and whose text has over 30 characters, where they change: id, excerpt."""
    rows = df.filter(F.coalesce(F.col("scoring_method") != "llm", F.lit(True)) & (F.length("content") > 30))
    new = sentence_excerpt(plain_text(F.col("content")))
    return rows.select("id", F.col("excerpt").alias("old"), new.alias("excerpt")).filter((F.col("excerpt") != "") & ~F.col("excerpt").eqNullSafe(F.col("old"))).select("id", "excerpt")


def backfill_html(df: DataFrame, extracted: Column, lex: Lexicon, force: bool = False) -> DataFrame:
    """``df`` (id, content, content_html, excerpt, scoring_method) with a body extracted anew, and the outcome.

    A body of 50 characters or more replaces body and text, and the excerpt unless a model made a clean one. Without it
    the row has failed; ``force`` then takes its body away, and text and excerpt too where they are dirty."""
    whole = F.length(F.coalesce(extracted, F.lit(""))) >= 50
    text = plain_text(extracted)
    kept = F.coalesce((F.col("scoring_method") == "llm") & (F.length("excerpt") > 10) & ~is_dirty(F.col("excerpt"), lex), F.lit(False))

    def clean(name: str) -> Column:
        return F.when(~is_dirty(F.col(name), lex), F.col(name)) if force else F.col(name)

    return df.withColumns({
        "outcome": F.when(whole, "updated").otherwise("cleaned" if force else "failed"),
        "content_html": F.when(whole, extracted).otherwise(F.lit(None) if force else F.col("content_html")),
        "content": F.when(whole, cap_at_sentence(text, 5000)).otherwise(clean("content")),
        "excerpt": F.when(whole & kept, F.col("excerpt")).when(whole, cap_at_sentence(text, 200)).otherwise(clean("excerpt")),
    })


#: What a text that is not cut off ends with.
LAST_MARKS = "[。！？）》\"']\\s*$"


def wants_fetch(content: Column, html: Column) -> Column:
    """Whether an opened article is fetched anew: it has no body, and a text that is missing, under 50 characters, or under
    3,000 without a mark at its end."""
    text = F.coalesce(content, F.lit(""))
    return (F.coalesce(html, F.lit("")) == "") & ((F.length(text) < 50) | ((F.length(text) < 3000) & ~text.rlike(LAST_MARKS)))


def score_open(df: DataFrame, scored: Column, lex: Lexicon) -> DataFrame:
    """Rows to be scored: pre-filtered, without a score, not rejected. One without a readable text is rejected, the others
    get ``scored`` and are decided: id, score, status, reason."""
    open_ = df.filter(F.col("score").isNull() & F.col("pre_filtered") & F.coalesce(F.col("status") != "rejected", F.lit(True)))
    rows = open_.withColumns({"t": tier(), "s": scored})
    d = decide_selection(F.col("pre_filtered"), F.lit("llm"), F.col("s"), F.col("t"), F.col("ai_reason"), lex)
    out = F.col("t") == "external"
    return rows.select("id", F.when(~out, F.col("s")).alias("score"), F.when(out, "rejected").otherwise(d["status"]).alias("status"), F.when(out, "no text").otherwise(d["reason"]).alias("reason"))


def telemetry(outcomes: DataFrame, source: str, order: list[str], ts: str, failed: str, error: str) -> DataFrame:
    """A row for each source after its outcomes: last fetch, last success, failures in a row, and the last error if it fails.

    Sums and maxima alone, so a source with most of the outcomes is no single task."""
    key = F.struct(*[F.col(c) for c in order])
    f = F.col(failed)
    last = outcomes.groupBy(source).agg(
        F.max(ts).alias("last_fetch_at"), F.max(F.when(~f, F.col(ts))).alias("last_success_at"), F.max(F.when(~f, key)).alias("_ok"), F.max_by(F.struct(f.alias("f"), F.col(error).alias("e")), key).alias("_last")
    )
    since = outcomes.filter(f).select(F.col(source).alias("_s"), key.alias("_k")).join(last.select(source, "_ok"), F.col("_s") == F.col(source))
    streak = since.filter(F.col("_ok").isNull() | (F.col("_k") > F.col("_ok"))).groupBy("_s").agg(F.count(F.lit(1)).alias("n"))
    return last.join(streak, F.col(source) == F.col("_s"), "left").select(source, "last_fetch_at", "last_success_at", F.coalesce("n", F.lit(0)).cast("long").alias("failures"), F.when(F.col("_last.f"), F.col("_last.e")).alias("last_error"))


def recent(ts: Column, as_of: Column, days: int = 60) -> Column:
    """No more than a day ahead and ``days`` back; a missing time is not recent."""
    age = (F.unix_micros(as_of) - F.unix_micros(ts)) / 86_400_000_000
    return F.coalesce(age.between(-1, days), F.lit(False))


def retained(df: DataFrame, method: Column, reason: Column, relevant: Column, as_of: Column, most: int = 20) -> DataFrame:
    """Undecided recent items that still go to the pre-filter, the first ``most`` of each source in feed order (newest
    first, then by id), with their place: the limit is the rule of the source system."""
    open_ = df.filter(~relevant & (method == "skipped") & reason.isNull() & recent(F.col("pub_date"), as_of))
    order = Window.partitionBy("source_name").orderBy(F.desc("pub_date"), "id")
    return open_.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def import_verdict(listed: Column, url_ok: Column, title: Column, content: Column, html: Column, excluded: Column, relevant: Column) -> Column:
    """Why a single page is not imported: the first gate that it fails, or null."""
    whole = F.coalesce(content_tier(content, html) == "full", F.lit(False)) & title.isNotNull()
    return (
        F.when(~F.coalesce(listed, F.lit(False)), "unknown source").when(~F.coalesce(url_ok, F.lit(False)), "address not allowed").when(~whole, "no whole text")
        .when(excluded.isNotNull(), F.concat(F.lit("excluded: "), excluded)).when(~F.coalesce(relevant, F.lit(False)), "off topic")
    )


def with_selectors(sources: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """The registry with a source's own selector in place of the configured one, and how each source is read."""
    own = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])[F.col("id")] if overrides else F.lit(None).cast("string")
    return sources.withColumn("selector", F.coalesce(own, F.col("selector")))


def source_kind(custom: tuple[str, ...]) -> Column:
    """custom for sources with an adapter of their own, else rss if they have a feed, else html."""
    return F.when(F.col("id").isin(*custom), "custom").when(F.coalesce(F.trim("rss"), F.lit("")) != "", "rss").otherwise("html")


def pass_rate(df: DataFrame, by: str, passed: Column) -> DataFrame:
    """Rows, passed rows and their percentage to one decimal."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passed"))
    return counts.withColumn("rate", F.floor(F.lit(1000.0) * F.col("passed") / F.col("n") + 0.5) / 10)
