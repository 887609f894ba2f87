"""Daily, weekly and monthly reports, their look-ups and counts, as flat rows by section and rank."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.selection import MUST_READ, PUBLISH

CATEGORIES = ("frontier", "industry_model", "regulatory", "dispute", "normative")
ZONE = dt.timedelta(hours=8)


def between(df: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    return df.filter((F.col("pub_date") >= F.lit(start)) & (F.col("pub_date") < F.lit(end)))


def local_day(date: str, days: int = 0) -> dt.datetime:
    """The start of a local day, in UTC."""
    return dt.datetime.fromisoformat(date) + dt.timedelta(days=days) - ZONE


def week_start(year: int, week: int) -> dt.datetime:
    return dt.datetime.fromisocalendar(year, week, 1)


def first_n(df: DataFrame, by: list[str], order: list[Column], most: int, n: Column | None = None) -> DataFrame:
    """The first ``most`` rows of each group, or ``n`` of these, with their rank.

    The literal bound lets Spark keep the first of each group in every partition, so a large group is not sorted in one task."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most)
    return ranked if n is None else ranked.filter(F.col("rank") <= n)


def by_score() -> list[Column]:
    return [F.coalesce("score", F.lit(0.0)).desc(), F.col("id").asc()]


def daily_report(df: DataFrame, date: str, must_read: int = 3, updates: int = 15, signals: int = 10, highlights: int = 5) -> DataFrame:
    """section, rank, id, score. Must-reads first, all other selected items as updates, then pending ones as signals.

    A day without a selected item shows the best of the week before instead.
    """
    day = between(df, local_day(date), local_day(date, 1))
    chosen = day.filter((F.col("status") == "selected") & (F.col("score") >= PUBLISH))
    # the best three are must-reads if they score enough; one that is left over is an update
    ranked = chosen.withColumn("r", F.row_number().over(Window.partitionBy(F.col("status")).orderBy(*by_score())))
    top = (F.col("r") <= must_read) & (F.col("score") >= MUST_READ)
    split = ranked.withColumn("section", F.when(top, "must_read").otherwise("industry_updates"))
    shown = first_n(split, ["section"], by_score(), max(must_read, updates), F.when(F.col("section") == "must_read", must_read).otherwise(updates))
    pending = first_n(day.filter(F.col("status") == "pending").withColumn("section", F.lit("review_signals")), ["section"], [F.col("pub_date").desc_nulls_first(), F.col("id").asc()], signals)
    week = between(df, local_day(date, -7), local_day(date)).filter(F.col("status") == "selected")
    # five are fetched before the score filter, as in the source system
    recent = first_n(week.withColumn("section", F.lit("recent_highlights")), ["section"], by_score(), highlights).filter(F.col("score") >= PUBLISH)
    recent = recent.join(shown.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti")
    cols = ["section", "rank", "id", "score"]
    return shown.select(*cols).unionByName(pending.select(*cols)).unionByName(recent.select(*cols))


def period_sections(df: DataFrame, start: dt.datetime, end: dt.datetime, n: dict[str, int], signals: int) -> DataFrame:
    """section, kind, rank, id, score of a week's or month's report: the best of each category and its signals."""
    rows = between(df, start - ZONE, end - ZONE)
    limit = F.create_map(*[F.lit(x) for kv in n.items() for x in kv])[F.col("section")]
    chosen = rows.filter((F.col("status") == "selected") & (F.col("score") >= PUBLISH)).withColumn("section", F.col("category")).withColumn("kind", F.lit("selected"))
    pending = rows.filter(F.col("status") == "pending").withColumn("section", F.col("category")).withColumn("kind", F.lit("signal"))
    cols = ["section", "kind", "rank", "id", "score"]
    return first_n(chosen, ["section"], by_score(), max(n.values()), limit).select(*cols).unionByName(first_n(pending, ["section"], by_score(), signals).select(*cols))


def weekly_report(df: DataFrame, year: int, week: int) -> DataFrame:
    start = week_start(year, week)
    return period_sections(df, start, start + dt.timedelta(days=7), dict.fromkeys(CATEGORIES, 8), 4)


def monthly_report(df: DataFrame, year: int, month: int, regional: Column) -> DataFrame:
    """As the weekly one, with the regulatory section in two: national items and those of a region."""
    start, end = dt.datetime(year, month, 1), dt.datetime(year + month // 12, month % 12 + 1, 1)
    limits = {"frontier": 12, "industry_model": 12, "dispute": 12, "normative": 16, "regulatory_national": 8, "regulatory_regional": 8}
    split = df.withColumn("category", F.when((F.col("category") == "regulatory") & (F.col("status") == "selected"), F.when(regional, "regulatory_regional").otherwise("regulatory_national")).otherwise(F.col("category")))
    return period_sections(split, start, end, limits, 6)


def category_distribution(df: DataFrame) -> DataFrame:
    """A row with the count of each category, zero-filled, the total and the mean score to one decimal, null as 0."""
    counts = [F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    return df.agg(*counts, F.count(F.lit(1)).alias("total"), F.coalesce(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 1), F.lit(0.0)).alias("avg_score"))


def top_sources(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """The n commonest sources; an empty name is unknown; ties by first appearance."""
    name = F.coalesce(F.nullif(F.col(source).cast("string"), F.lit("")), F.lit("unknown")).alias("source")
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first").limit(n)


def as_of(reports: DataFrame, wanted: DataFrame, within: int | None = 3) -> DataFrame:
    """For each wanted date the newest report up to it, no more than ``within`` days older; is_stale if it is older."""
    if within is not None:
        # each report serves the dates of a bounded span: an equi-join instead of a range one
        spread = reports.withColumn("wanted", F.explode(F.sequence(F.col("report_date"), F.date_add("report_date", within))))
        found = wanted.join(spread, "wanted")
    else:
        # within the month by an equi-join, before it by the last report of each month, of which there are few
        month = lambda c: F.trunc(c, "MM")
        held = reports.select("report_date", month("report_date").alias("_m"))
        lasts = held.groupBy("_m").agg(F.max("report_date").alias("last")).agg(F.collect_list("last")).scalar()
        near = wanted.select("wanted", month("wanted").alias("_m")).join(held, "_m").filter("report_date <= wanted").select("wanted", "report_date")
        far = wanted.select("wanted", lasts.alias("_lasts"), month("wanted").alias("_m"))
        far = far.select("wanted", F.array_max(F.filter("_lasts", lambda d: d < F.col("_m"))).alias("report_date")).filter("report_date is not null")
        found = near.unionByName(far)
    return found.groupBy("wanted").agg(F.max("report_date").alias("report_date")).withColumn("is_stale", F.col("report_date") < F.col("wanted"))


def top_categories(df: DataFrame, order: list[Column], n: int = 3) -> DataFrame:
    """The ``n`` commonest categories, ties by first appearance: category, n, first (the smallest order key as a struct)."""
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")).orderBy(F.desc("n"), "first").limit(n)


def article_card(df: DataFrame) -> DataFrame:
    """The card of an article in a report: an empty excerpt counts as none, and the text's first 200 characters stand in."""
    text = F.coalesce(F.nullif(F.col("excerpt"), F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, 200))
    return df.withColumn("excerpt", text)


def insight_lines(insights: Column, summary: Column) -> Column:
    """The first four insights, or else the first three parts of the summary between line breaks and full stops."""
    parts = F.filter(F.transform(F.split(F.coalesce(summary, F.lit("")), "\n|。"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(F.coalesce(insights, F.array().cast("array<string>"))) > 0, F.slice(insights, 1, 4)).otherwise(F.slice(parts, 1, 3))


def section_articles(articles: Column, subsections: Column) -> Column:
    """A section's own articles, then those of its subsections in order; null lists are empty."""
    inner = F.flatten(F.transform(F.coalesce(subsections, F.array()), lambda s: F.coalesce(s["articles"], F.array())))
    return F.concat(F.coalesce(articles, F.array()), inner)


def feed_items(report: DataFrame, date: str, titles: DataFrame, names: dict[str, str], summary: str | None = None) -> DataFrame:
    """A daily report (section, rank, id, score) as feed items, one for each section in the order of ``names``: place, title,
    description (ten numbered titles with their scores), guid, category. A summary comes first. ``titles`` has id and title."""
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("section")]
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("section")).cast("int")
    score = F.when(F.coalesce("score", F.lit(0.0)) != 0, F.concat(F.lit(" ("), F.col("score").cast("long"), F.lit(")"))).otherwise(F.lit(""))
    line = F.concat(F.col("rank"), F.lit(". "), F.col("title"), score)
    lines = report.filter("rank <= 10").join(titles, "id").groupBy("section").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    items = lines.select(
        order.alias("place"), F.coalesce(label, F.lit("Section")).alias("title"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("description"),
        F.concat(F.lit(f"daily-{date}-"), "section").alias("guid"), F.col("section").alias("category"),
    )
    if not summary:
        return items
    first = report.sparkSession.createDataFrame([(0, "Summary", summary, f"daily-{date}-summary", "summary")], "place int, title string, description string, guid string, category string")
    return first.unionByName(items)


def period_overview(df: DataFrame, start: dt.datetime, end: dt.datetime, sources: int) -> DataFrame:
    """One row over a week or month: counts of each category, total, mean score, the commonest sources in order with their
    counts, and one insight for each category that has items, by count."""
    chosen = between(df, start - ZONE, end - ZONE).filter((F.col("status") == "selected") & (F.col("score") >= PUBLISH))
    row = category_distribution(chosen)
    ranked = top_sources(chosen, "source_id", "id", sources).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", "source", "n"))).alias("l"))
    best = ranked.select(F.array_join(F.transform("l", lambda x: F.concat(x["source"], F.lit(" "), x["n"])), ", ").alias("top_sources"))
    each = F.array(*[F.struct((-F.col(c)).alias("k"), F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(c).alias("n")) for i, c in enumerate(CATEGORIES)])
    lines = F.transform(F.array_sort(F.filter(each, lambda x: x["n"] > 0)), lambda x: F.concat(x["name"], F.lit(": "), x["n"]))
    return row.withColumns({"insights": F.array_join(lines, "\n"), "top_sources": best.scalar()})


def display_counts(df: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Published items of the local day, and of the days before it back to ``days``."""
    age = F.datediff(F.lit(today).cast("date"), F.to_date(F.from_utc_timestamp("pub_date", "Asia/Shanghai")))
    return df.agg(F.count_if(age == 0).alias("today"), F.count_if(age.between(1, days)).alias("recent"), F.max("pub_date").alias("latest"))
