"""Registered queries over the maintenance jobs, the home page and whole reports, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.lexicon import SAMPLE as LEX
from tessera.operators import jobs, listing, reports, selection
from tessera.plans import sql as S
from tessera.plans.articles import ARTICLES, AS_OF, ITEMS, articles, order_items, table
from tessera.plans.catalog import CLASS, DECIDE, LISTED, NEWEST, REPORTS, SIGNS, WHOLE, _reports, query

TIER = S.tier("content", "NULL::VARCHAR")
STATUS = "CASE WHEN id % 2 = 0 THEN 'pending' WHEN id % 3 = 0 THEN 'rejected' END"
TEXT = "title || ' ' || content"


def _now():
    return F.lit(AS_OF).cast("timestamp")


def _with_status(spark, sf):
    return articles(spark, sf).withColumn("status", F.when(F.col("id") % 2 == 0, "pending").when(F.col("id") % 3 == 0, "rejected"))


@query(
    f"WITH {ARTICLES}, r AS (SELECT *, scoring_method = 'llm' AND score IS NOT NULL AND coalesce(pre_filtered, true) AND {TIER} = 'full' AS again FROM art) "
    "SELECT id, CASE WHEN NOT again THEN score END AS score, CASE WHEN NOT again THEN ai_reason END AS ai_reason, CASE WHEN NOT again THEN scoring_method END AS scoring_method FROM r"
)
def reset_scores(spark, sf):
    return jobs.reset_scores(articles(spark, sf)).select("id", "score", "ai_reason", "scoring_method")


@query(
    f"WITH {ARTICLES}, k AS (SELECT id, score, {S.candidate(TEXT, LEX)} OR {LISTED} AS keep FROM art) "
    "SELECT id, keep AS pre_filtered, CASE WHEN keep THEN 'pending' ELSE 'rejected' END AS status, false AS is_selected, CASE WHEN NOT keep THEN score END AS score FROM k"
)
def rebuild_pool(spark, sf):
    return jobs.rebuild_pool(_with_status(spark, sf), LEX).select("id", "pre_filtered", "status", "is_selected", "score")


@query(
    f"WITH {ARTICLES}, x AS (SELECT id, {S.exclusion('title', 'url', LEX)} AS reason, {S.candidate(TEXT, LEX)} AS cand FROM art WHERE pre_filtered) "
    "SELECT id, 'rejected' AS status, false AS pre_filtered, reason FROM x WHERE reason IS NOT NULL OR NOT cand"
)
def keyword_rescreen(spark, sf):
    return jobs.rescreen(articles(spark, sf), LEX)


@query(
    f"WITH {ARTICLES}, {DECIDE} SELECT id, status, status = 'selected' AS is_selected, tier AS content_quality, length({S.plain('content')})::INT AS content_word_count, TIMESTAMP '{AS_OF}' AS content_checked_at FROM st"
)
def quality_backfill(spark, sf):
    return jobs.backfill_quality(articles(spark, sf), LEX, _now().cast("timestamp_ntz"))


@query(f"WITH {ARTICLES}, {CLASS} SELECT art.id, art.category AS old_category, cls.section AS category FROM art JOIN cls USING (id) WHERE art.category <> cls.section")
def reclassify_all(spark, sf):
    return jobs.reclassify(articles(spark, sf), LEX)


@query()
def excerpt_backfill(spark, sf):
    return jobs.backfill_excerpts(articles(spark, sf).withColumn("excerpt", F.substring("content", 1, 200)))


@query(
    f"WITH {ARTICLES}, o AS (SELECT *, {TIER} AS t, (id % 30)::DOUBLE AS s FROM art WHERE score IS NULL AND pre_filtered AND coalesce({STATUS} <> 'rejected', true)), "
    f"d AS (SELECT *, CASE WHEN s >= 8 AND t = 'full' AND NOT coalesce({S.like('ai_reason', LEX.reject_reason)}, false) THEN 'publishable' WHEN s >= 8 THEN 'signal' ELSE 'irrelevant' END AS r FROM o) "
    "SELECT id, CASE WHEN t <> 'external' THEN s END AS score, CASE WHEN t = 'external' THEN 'rejected' WHEN r = 'publishable' THEN 'selected' WHEN r = 'signal' THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN t = 'external' THEN 'no text' ELSE r END AS reason FROM d"
)
def scoring_job(spark, sf):
    return jobs.score_open(_with_status(spark, sf), (F.col("id") % 30).cast("double"), LEX)


@query(
    "WITH o AS (SELECT user_id, ts, event_id, event_type = 'error' AS f, props FROM events), "
    "l AS (SELECT user_id, max(ts) AS last_fetch_at, max(ts) FILTER (NOT f) AS last_success_at, arg_max(struct_pack(f := f, e := props), (ts, event_id)) AS z, max((ts, event_id)) FILTER (NOT f) AS ok FROM o GROUP BY user_id) "
    "SELECT l.user_id, last_fetch_at, last_success_at, (SELECT count(*) FROM o WHERE o.user_id = l.user_id AND o.f AND (l.ok IS NULL OR (o.ts, o.event_id) > l.ok)) AS failures, CASE WHEN z.f THEN z.e END AS last_error FROM l"
)
def source_telemetry(spark, sf):
    events = table(spark, sf, "events").withColumn("failed", F.col("event_type") == "error")
    return jobs.telemetry(events, "user_id", ["ts", "event_id"], "ts", "failed", "props")


@query(f"WITH {ITEMS} SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN (id % 50)::DOUBLE END ELSE score END AS score, category FROM item")
def bulk_assign(spark, sf):
    items = order_items(spark, sf).select("id", "score", "category")
    batch = items.filter("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, (F.col("id") % 50).cast("double")).alias("score"))
    return jobs.assign(items, batch, "id", "score")


RECENT = f"pub_date BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 60 DAY AND TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY"


@query(
    f"WITH {ARTICLES}, {WHOLE}, {SIGNS}, u AS (SELECT x.id, source_name, pub_date FROM x JOIN art USING (id) WHERE ex IS NULL AND NOT (core AND (listed OR points >= 2)) AND (listed OR cand) AND {RECENT}), "
    "p AS (SELECT id, source_name, row_number() OVER (PARTITION BY source_name ORDER BY pub_date DESC, id)::INT AS place FROM u) SELECT id, source_name, place FROM p WHERE place <= 20"
)
def retained_candidates(spark, sf):
    rows = articles(spark, sf)
    r = T.relevance(F.col("title"), F.col("content"), F.col("source_name"), F.col("url"), LEX)
    rows = rows.withColumn("r", r)
    return jobs.retained(rows, F.col("r.method"), F.col("r.reason"), F.col("r.relevant"), _now()).select("id", "source_name", "place")


@query(
    f"WITH {ARTICLES}, {WHOLE}, {SIGNS} SELECT x.id, CASE WHEN NOT listed THEN 'unknown source' WHEN art.id % 9 = 0 THEN 'address not allowed' WHEN {TIER} <> 'full' THEN 'no whole text' WHEN ex IS NOT NULL THEN 'excluded: ' || ex WHEN NOT core THEN 'off topic' END AS verdict FROM x JOIN art USING (id)"
)
def single_import(spark, sf):
    rows, none = articles(spark, sf), F.lit(None).cast("string")
    title, content, url = F.col("title"), F.col("content"), F.col("url")
    relevant = T.relevance(title, content, F.col("source_name"), url, LEX)["relevant"]
    verdict = jobs.import_verdict(F.col("source_name").isin(*LEX.whitelist), ~url.contains("/training/"), title, content, none, T.exclusion_reason(title, url, LEX), relevant)
    return rows.select("id", verdict.alias("verdict"))


@query(f"WITH {ARTICLES}, {WHOLE}, {SIGNS}, p AS (SELECT source_name, ex IS NULL AND core AS ok FROM x JOIN art USING (id)) SELECT source_name, count(*) AS n, count(*) FILTER (ok) AS passed, floor(1000.0::DOUBLE * count(*) FILTER (ok) / count(*) + 0.5) / 10 AS rate FROM p GROUP BY source_name")
def prefilter_pass_rate(spark, sf):
    c = [F.col(n) for n in ("title", "content", "url")]
    return jobs.pass_rate(articles(spark, sf), "source_name", T.pre_filter(F.lit(None).cast("boolean"), *c, LEX))


@query(f"WITH {ARTICLES} SELECT id, score, length({S.plain('content')})::INT AS word_count, pub_date FROM art ORDER BY coalesce(score, 0) DESC, word_count DESC, pub_date DESC, id LIMIT 100")
def selection_order(spark, sf):
    rows = articles(spark, sf).withColumn("word_count", F.length(T.plain_text(F.col("content"))))
    return rows.orderBy(F.coalesce("score", F.lit(0.0)).desc(), F.desc("word_count"), F.desc("pub_date"), "id").limit(100).select("id", "score", "word_count", F.col("pub_date").cast("timestamp_ntz").alias("pub_date"))


@query(
    f"WITH q AS (SELECT source, count(*) AS total, floor(100.0::DOUBLE * count(*) FILTER ({S.tier('text', 'NULL::VARCHAR')} = 'full') / count(*) + 0.5) / 100 AS full_rate FROM documents GROUP BY source) SELECT source, total, full_rate FROM q ORDER BY full_rate, total DESC, source LIMIT 10"
)
def quality_audit_worst(spark, sf):
    from tessera.plans import catalog

    return catalog.quality_audit(spark, sf).orderBy("full_rate", F.desc("total"), "source").limit(10).select("source", "total", "full_rate")


DAY = "1997-05-28"
LOCAL = "(pub_date + INTERVAL 8 HOUR)::DATE"


@query(
    f"WITH {ITEMS}, s AS (SELECT id, 'selected' AS part FROM item WHERE status = 'selected' {NEWEST} LIMIT 500), p AS (SELECT id, 'pending' AS part FROM item WHERE status = 'pending' {NEWEST} LIMIT 24) "
    "SELECT part, id, (SELECT max(pub_date) FROM item) AS latest FROM (FROM s UNION ALL FROM p)"
)
def home_page(spark, sf):
    rows = order_items(spark, sf)
    parts = [listing.newest(rows.filter(F.col("status") == part), n).select(F.lit(part).alias("part"), "id") for part, n in (("selected", 500), ("pending", 24))]
    return parts[0].unionByName(parts[1]).withColumn("latest", rows.agg(F.max("pub_date")).scalar())


@query(f"WITH {ITEMS} SELECT category, count(*) AS n FROM item WHERE status = 'selected' AND {LOCAL} = DATE '{DAY}' GROUP BY category ORDER BY n DESC, min((-coalesce(score, 0), id)) LIMIT 3")
def daily_top_categories(spark, sf):
    rows = listing.published(order_items(spark, sf)).filter(T.beijing_date(F.col("pub_date")) == F.lit(DAY).cast("date"))
    return reports.top_categories(rows, [(-F.coalesce("score", F.lit(0.0))).alias("k"), F.col("id")]).select("category", "n")


@query(f"WITH {ITEMS}, a AS (SELECT datediff('day', {LOCAL}, DATE '{DAY}') AS age, pub_date FROM item WHERE status = 'selected') SELECT count(*) FILTER (age = 0) AS today, count(*) FILTER (age BETWEEN 1 AND 7) AS recent, max(pub_date) AS latest FROM a")
def display_counts(spark, sf):
    return reports.display_counts(listing.published(order_items(spark, sf)), DAY)


@query("SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\n|。'), lambda x: trim(x)), lambda x: x <> '')[1:3], '|') AS lines FROM documents")
def insight_lines(spark, sf):
    lines = reports.insight_lines(F.lit(None).cast("array<string>"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(lines, "|").alias("lines"))


@query(f"WITH {ARTICLES} SELECT id, CASE WHEN id % 3 = 0 THEN left(title, 10) ELSE left(content, 200) END AS excerpt FROM art WHERE length(title) > 0")
def article_cards(spark, sf):
    rows = articles(spark, sf).withColumn("excerpt", F.when(F.col("id") % 3 == 0, F.substring("title", 1, 10)).when(F.col("id") % 3 == 1, ""))
    return reports.article_card(rows.filter("length(title) > 0")).select("id", "excerpt")


SECTIONS = {"must_read": "Must read", "industry_updates": "Updates", "review_signals": "Signals", "recent_highlights": "Highlights"}


@query(
    f"WITH {ITEMS}, d AS (SELECT * FROM item WHERE {LOCAL} = DATE '{DAY}'), c AS (SELECT *, row_number() OVER (ORDER BY coalesce(score, 0) DESC, id) AS r FROM d WHERE status = 'selected' AND score >= 8), "
    "t AS (SELECT *, CASE WHEN r <= 3 AND score >= 30 THEN 'must_read' ELSE 'industry_updates' END AS section FROM c), "
    "u AS (SELECT section, id, score, title, row_number() OVER (PARTITION BY section ORDER BY coalesce(score, 0) DESC, id) AS rank FROM t), "
    "p AS (SELECT 'review_signals' AS section, id, score, title, row_number() OVER (ORDER BY pub_date DESC NULLS FIRST, id) AS rank FROM d WHERE status = 'pending'), "
    "a AS (SELECT * FROM u WHERE rank <= CASE section WHEN 'must_read' THEN 3 ELSE 15 END UNION ALL SELECT * FROM p WHERE rank <= 10) "
    "SELECT CASE section WHEN 'must_read' THEN 1 WHEN 'industry_updates' THEN 2 ELSE 3 END AS place, CASE section WHEN 'must_read' THEN 'Must read' WHEN 'industry_updates' THEN 'Updates' ELSE 'Signals' END AS title, "
    f"string_agg(rank || '. ' || title || CASE WHEN coalesce(score, 0) <> 0 THEN ' (' || score::BIGINT || ')' ELSE '' END, chr(10) ORDER BY rank) AS description, 'daily-{DAY}-' || section AS guid, section AS category FROM a WHERE rank <= 10 GROUP BY section "
    f"UNION ALL SELECT 0, 'Summary', 'The day in brief', 'daily-{DAY}-summary', 'summary'"
)
def daily_feed_items(spark, sf):
    rows = order_items(spark, sf)
    return reports.feed_items(reports.daily_report(rows, DAY), DAY, rows.select("id", "title"), SECTIONS, "The day in brief")


def _overview(start: str, end: str, sources: int) -> str:
    cats = ("frontier", "industry_model", "regulatory", "dispute", "normative")
    each = ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in cats)
    pairs = ", ".join(f"struct_pack(k := -{c}, i := {i}, name := '{c}', n := {c})" for i, c in enumerate(cats))
    return (
        f"WITH {ITEMS}, c AS (SELECT * FROM item WHERE status = 'selected' AND score >= 8 AND pub_date >= TIMESTAMP '{start}' - INTERVAL 8 HOUR AND pub_date < TIMESTAMP '{end}' - INTERVAL 8 HOUR), "
        f"r AS (SELECT {each}, count(*) AS total, coalesce(floor(avg(score) * 10 + 0.5) / 10, 0) AS avg_score FROM c), "
        f"s AS (SELECT source_id::VARCHAR AS source, count(*) AS n, min(id) AS first FROM c GROUP BY source_id ORDER BY n DESC, first LIMIT {sources}), "
        "b AS (SELECT coalesce(string_agg(source || ' ' || n, ', ' ORDER BY n DESC, first), '') AS top_sources FROM s) "
        f"SELECT r.*, array_to_string(list_transform(list_filter(list_sort([{pairs}]), lambda x: x.n > 0), lambda x: x.name || ': ' || x.n), chr(10)) AS insights, b.top_sources FROM r, b"
    )


@query(_overview("1997-05-26", "1997-06-02", 5))
def weekly_overview(spark, sf):
    return reports.period_overview(order_items(spark, sf), dt.datetime(1997, 5, 26), dt.datetime(1997, 6, 2), 5)


@query(_overview("1997-05-01", "1997-06-01", 8))
def monthly_overview(spark, sf):
    return reports.period_overview(order_items(spark, sf), dt.datetime(1997, 5, 1), dt.datetime(1997, 6, 1), 8)


# Detail pages, enrichment and bodies ---------------------------------------------------------------------------------


def _decided(spark, sf):
    d = selection.decide_selection(F.col("pre_filtered"), F.col("scoring_method"), F.col("score"), jobs.tier(), F.col("ai_reason"), LEX)
    return articles(spark, sf).withColumns({"status": d["status"], "tier": jobs.tier()})


@query(f"WITH {ARTICLES}, {DECIDE} SELECT id, title, status, CASE status WHEN 'selected' THEN 'selected' ELSE 'signal' END AS review_tier FROM st WHERE pre_filtered AND status IN ('selected', 'pending') AND tier = 'full'")
def article_details(spark, sf):
    return listing.details(_decided(spark, sf).withColumnRenamed("tier", "content_quality")).select("id", "title", "status", "review_tier")


SHORT = "regexp_replace(stored, '(\\.\\.\\.|…)$', '')"


@query(
    f"WITH {ARTICLES}, {DECIDE}, f AS (SELECT *, CASE id % 3 WHEN 0 THEN left(title, 20) || '...' WHEN 1 THEN left(title, 20) || '…' ELSE title END AS stored, CASE WHEN id % 7 = 0 THEN left(title, 10) ELSE title END AS fetched, status = 'rejected' AND tier = 'full' AS again FROM st) "
    f"SELECT id, CASE WHEN stored <> {SHORT} AND length(fetched) > length({SHORT}) THEN fetched ELSE stored END AS title, CASE WHEN again THEN 'pending' ELSE status END AS status, "
    "CASE WHEN NOT again THEN scoring_method END AS scoring_method, CASE WHEN NOT again THEN ai_reason END AS ai_reason FROM f"
)
def enrich_outcome(spark, sf):
    """Cut titles repaired by fetched ones, and rejected articles that have a whole text by now reopened."""
    i, head = F.col("id"), F.substring("title", 1, 20)
    stored = F.when(i % 3 == 0, F.concat(head, F.lit("..."))).when(i % 3 == 1, F.concat(head, F.lit("…"))).otherwise(F.col("title"))
    fetched = F.when(i % 7 == 0, F.substring("title", 1, 10)).otherwise(F.col("title"))
    return selection.reopen(_decided(spark, sf)).select("id", T.repair_title(stored, fetched).alias("title"), "status", "scoring_method", "ai_reason")


def _backfilled(force: bool) -> str:
    def dirty(c: str) -> str:
        return f"(starts_with(left(coalesce({c}, ''), 200), '%PDF') OR {S.like(f'left(coalesce({c}, {S.q('')}), 200)', LEX.site_noise)})"

    def capped(most: int) -> str:
        return f"CASE WHEN length(t) <= {most} THEN t ELSE {S.cut_at_end('t', most, most / 2)} END"

    def clean(c: str) -> str:
        return f"CASE WHEN NOT {dirty(c)} THEN {c} END" if force else c

    return (
        f"WITH {ARTICLES}, f AS (SELECT id, scoring_method, CASE WHEN id % 10 = 5 THEN '%PDF-1.4 ' || left(content, 50) ELSE content END AS content, '<p>old</p>' AS content_html, CASE WHEN id % 6 = 0 THEN '%PDF-1.4' || left(content, 40) ELSE left(content, 100) END AS excerpt, "
        f"CASE WHEN id % 5 = 0 THEN '<p>short</p>' WHEN id % 5 > 1 THEN '<p>' || content || '</p>' END AS got FROM art), "
        f"x AS (SELECT *, length(coalesce(got, '')) >= 50 AS whole, {S.plain('got')} AS t, coalesce(scoring_method = 'llm' AND length(excerpt) > 10 AND NOT {dirty('excerpt')}, false) AS kept FROM f) "
        f"SELECT id, CASE WHEN whole THEN 'updated' ELSE '{'cleaned' if force else 'failed'}' END AS outcome, CASE WHEN whole THEN got ELSE {'NULL' if force else 'content_html'} END AS content_html, "
        f"CASE WHEN whole THEN {capped(5000)} ELSE {clean('content')} END AS content, CASE WHEN whole AND kept THEN excerpt WHEN whole THEN {capped(200)} ELSE {clean('excerpt')} END AS excerpt FROM x"
    )


def _backfill(spark, sf, force):
    i, text = F.col("id"), F.col("content")
    body = F.when(i % 5 == 0, "<p>short</p>").when(i % 5 > 1, F.concat(F.lit("<p>"), text, F.lit("</p>")))
    excerpt = F.when(i % 6 == 0, F.concat(F.lit("%PDF-1.4"), F.substring(text, 1, 40))).otherwise(F.substring(text, 1, 100))
    old = F.when(i % 10 == 5, F.concat(F.lit("%PDF-1.4 "), F.substring(text, 1, 50))).otherwise(text)
    rows = articles(spark, sf).select("id", "scoring_method", body.alias("got"), old.alias("content"), F.lit("<p>old</p>").alias("content_html"), excerpt.alias("excerpt"))
    return jobs.backfill_html(rows, F.col("got"), LEX, force).select("id", "outcome", "content_html", "content", "excerpt")


@query(_backfilled(False))
def html_backfill(spark, sf):
    return _backfill(spark, sf, False)


@query(_backfilled(True))
def html_backfill_forced(spark, sf):
    return _backfill(spark, sf, True)


@query("SELECT doc_id, length(coalesce(c, '')) < 50 OR (length(c) < 3000 AND NOT regexp_matches(c, '[。！？）》\"'']\\s*$')) AS wanted FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN left(text, 40) WHEN doc_id % 5 = 1 THEN left(text, 200) || '”' WHEN doc_id % 5 = 2 THEN left(text, 200) || '。' ELSE text END AS c FROM documents)")
def live_fetch(spark, sf):
    i, text = F.col("doc_id"), F.col("text")
    c = F.when(i % 5 == 0, F.substring(text, 1, 40)).when(i % 5 == 1, F.concat(F.substring(text, 1, 200), F.lit("”"))).when(i % 5 == 2, F.concat(F.substring(text, 1, 200), F.lit("。"))).otherwise(text)
    return table(spark, sf, "documents").select("doc_id", jobs.wants_fetch(c, F.lit(None).cast("string")).alias("wanted"))


@query(f"WITH {ARTICLES} SELECT id, CASE WHEN pre_filtered AND score >= 20 THEN TIMESTAMP '{AS_OF}' ELSE pub_date END AS updated_at FROM art")
def touched_rows(spark, sf):
    rows = articles(spark, sf).withColumn("updated_at", F.col("pub_date"))
    return jobs.touched(rows, F.col("pre_filtered") & (F.col("score") >= 20), _now()).select("id", "updated_at")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey IN (7, 21) THEN 'custom' WHEN s_suppkey % 3 = 2 THEN 'rss' ELSE 'html' END AS kind FROM supplier")
def source_kinds(spark, sf):
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(k.alias("id"), F.when(k % 3 == 1, " ").when(k % 3 == 2, F.concat(F.lit("https://example.org/"), k)).alias("rss"))
    return rows.select("id", jobs.source_kind((7, 21)).alias("kind"))


@query(f"WITH {REPORTS} SELECT wanted, max(report_date) AS report_date, max(report_date) < wanted AS is_stale FROM ask JOIN rep ON report_date BETWEEN wanted - 1 AND wanted GROUP BY wanted")
def report_of_day(spark, sf):
    """The report of the very day, else that of the day before."""
    return reports.as_of(*_reports(spark, sf), within=1)


@query("WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), t AS (SELECT max(day) AS today FROM d) SELECT day, CASE today - day WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE strftime(day, '%Y-%m-%d %a') END AS label FROM d, t")
def relative_days(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", listing.relative_day(F.col("day"), days.agg(F.max("day")).scalar()).alias("label"))


@query("SELECT o_custkey AS section, string_agg(o_orderkey, ',' ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS articles FROM orders GROUP BY o_custkey")
def section_lists(spark, sf):
    """The articles of each section, its own and those of its subsections."""

    def of(*status: str):
        return F.array_sort(F.collect_list(F.when(F.col("o_orderstatus").isin(*status), F.col("o_orderkey"))))

    sections = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("section")).agg(of("F").alias("own"), of("O").alias("open"), of("P").alias("part"))
    inner = F.array(F.struct(F.col("open").alias("articles")), F.struct(F.col("part").alias("articles")))
    return sections.select("section", F.array_join(reports.section_articles(F.col("own"), inner), ",").alias("articles"))
