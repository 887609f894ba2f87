"""Registered queries over pages and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.jobs import with_selectors
from tessera.plans import sql as S
from tessera.plans.articles import table
from tessera.plans.catalog import query
from tessera.sources import html as H
from tessera.sources import selectors
from tessera.sources import web as sources_web
from tessera.streaming import jobs

DECODED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _decoded(c: str) -> str:
    for a, b in DECODED:
        c = f"replace({c}, {S.q(a)}, {S.q(b)})"
    return c


def _tag(pattern: str) -> str:
    return _decoded(S.plain(f"regexp_extract(html, {S.q(pattern)}, 1)"))


H1 = _tag("(?is)<h1\\b[^>]*>(.*?)</h1>")
# the sample pages hold no meta titles and one h1 each, in the article


@query(f"SELECT page_id, CASE WHEN length({H1}) BETWEEN 6 AND 200 THEN {H1} END AS title FROM pages")
def page_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.page_title(F.col("html")).alias("title"))


BARE = "regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<!--.*?-->', ' ', 'g')"


@query(f"SELECT page_id, {_decoded(S.plain(BARE))} AS text FROM pages")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.html_text(F.col("html")).alias("text"))


ANCHORS = "regexp_extract_all(html, '(?is)<a\\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>', {})"


@query(
    f"WITH a AS (SELECT page_id, url, unnest({ANCHORS.format(1)}) AS h, unnest({ANCHORS.format(2)}) AS t, unnest(range(len({ANCHORS.format(1)}))) AS place FROM pages) "
    f"SELECT page_id, place::INT AS place, {_decoded(S.plain('t'))} AS title, CASE WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || h ELSE h END AS href FROM a"
)
def link_list(spark, sf):
    return H.link_list(table(spark, sf, "pages"), filtered=False)


BODY = _decoded(S.plain("regexp_replace(regexp_extract(html, '(?is)<body\\b.*'), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<!--.*?-->', ' ', 'g')"))
DATE = "(\\d{4})[-/.年](\\d{1,2})[-/.月](\\d{1,2})"
WRITTEN = f"try_cast(regexp_extract(x, '{DATE}', 1) || '-' || lpad(regexp_extract(x, '{DATE}', 2), 2, '0') || '-' || lpad(regexp_extract(x, '{DATE}', 3), 2, '0') AS TIMESTAMP)"


@query(
    f"WITH t AS (SELECT page_id, {BODY} AS x FROM pages), w AS (SELECT page_id, {WRITTEN} AS w FROM t) "
    "SELECT page_id, CASE WHEN w BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2024-03-02' THEN w ELSE TIMESTAMP '1970-01-01' + (1600000000 + page_id) * INTERVAL 1 SECOND END AS published FROM w"
)
def page_published(spark, sf):
    as_of = F.lit("2024-03-01").cast("timestamp")
    url = F.concat("url", F.lit("?_t="), F.col("page_id") + 1600000000)
    return table(spark, sf, "pages").select("page_id", H.published_at(F.col("html"), as_of, url).cast("timestamp_ntz").alias("published"))


ITEM = "regexp_extract_all(html, '(?is)<li\\b[^>]*>(.*?)</li', 1)"
ONE = "(?is)<a\\b[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>"


@query(
    f"WITH l AS (SELECT page_id, url, unnest({ITEM}) AS li, unnest(range(len({ITEM}))) AS place FROM pages) "
    f"SELECT page_id, place::INT AS place, {_decoded(S.plain(f'regexp_extract(li, {S.q(ONE)}, 2)'))} AS title, regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_extract(li, {S.q(ONE)}, 1) AS href, TIMESTAMP '2024-03-01 10:20' AS pub_date FROM l"
)
def list_items(spark, sf):
    as_of = F.lit("2024-03-01 10:20:30").cast("timestamp")
    return H.list_items(table(spark, sf, "pages"), as_of).withColumn("pub_date", F.col("pub_date").cast("timestamp_ntz"))


# all links of the sample pages are in nav > ul > li, none of them has an address that looks like an article's
LINKS = (
    f"a AS (SELECT page_id, url, unnest({ANCHORS.format(1)}) AS h, {{}} AS t, unnest(range(len({ANCHORS.format(1)}))) AS place FROM pages), "
    "l AS (SELECT page_id, place, regexp_extract(url, '^(https?://([^/?#]*))', 2) AS host, t AS title, regexp_extract(url, '^(https?://[^/?#]*)', 1) || h AS href FROM a WHERE length(t) BETWEEN 6 AND 200)"
).format(_decoded(S.plain(f"unnest({ANCHORS.format(2)})")))


@query(
    f"WITH {LINKS}, f AS (SELECT page_id, href, min(place) AS place, arg_min(title, place) AS title FROM l WHERE page_id % 3 < 2 GROUP BY ALL) "
    "SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place))::INT AS place, title, href, TIMESTAMP '2024-03-01 10:20' AS pub_date, true AS selected FROM f"
)
def selected_links(spark, sf):
    """Items of list pages: by the configured selector, by one of the page's own in its place, and where neither selects any, by links."""
    pages = table(spark, sf, "pages").withColumns({"id": (F.col("page_id") % 3).cast("string")})
    pages = with_selectors(pages.withColumn("selector", F.when(F.col("id") == "0", "nav > ul > li").otherwise("article li")), {"1": "body nav a[href], #none"})
    rows = selectors.page_list(pages, F.lit("2024-03-01 10:20:30").cast("timestamp"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("place"))
    return rows.select("page_id", place.alias("place"), "title", "href", F.col("pub_date").cast("timestamp_ntz").alias("pub_date"), "selected")


@query(
    f"WITH {LINKS}, m AS (SELECT host, href, min({{'p': page_id, 'i': place}}) AS p0, arg_max(title, {{'p': page_id, 'i': place}}) AS title FROM l WHERE page_id % 4 <> 3 GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY p0, href) AS place FROM m) "
    "SELECT host AS source_id, place::INT AS place, title, href, TIMESTAMP '2024-03-01 10:20' AS pub_date FROM r WHERE place <= 50"
)
def source_pages(spark, sf):
    """All pages of a host as one list: an address once, the first 50; every fourth page has failed."""
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    pages = table(spark, sf, "pages").select(host.alias("source_id"), F.col("page_id").alias("page_no"), "url", F.when(F.col("page_id") % 4 != 3, F.col("html")).alias("html"), F.lit("ul > li").alias("selector"))
    rows = selectors.source_list(pages, F.lit("2024-03-01 10:20:30").cast("timestamp"))
    return rows.withColumn("pub_date", F.col("pub_date").cast("timestamp_ntz"))


@query()
def article_pages(spark, sf):
    as_of = F.lit("2024-03-01").cast("timestamp")
    return H.article_page(table(spark, sf, "pages"), as_of).select("page_id", "title", "excerpt", "published", "summary_only", "tier")


@query()
def extract_body(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.extract_body("html", "url").alias("b")).select("page_id", "b.html", "b.cover", "b.text")


@query(
    "WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "
    "w AS (SELECT user_id, i, event_id, ts AS start, 1 AS n FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.event_id, CASE WHEN o.ts - w.start > INTERVAL 6 HOUR THEN o.ts ELSE w.start END, CASE WHEN o.ts - w.start > INTERVAL 6 HOUR THEN 1 ELSE w.n + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1) "
    "SELECT user_id AS key, event_id AS id, n AS in_window, n <= 2 AS allowed FROM w"
)
def stream_rate_limit(spark, sf):
    events = jobs.read_table(spark, sf, "events", table(spark, sf, "events").schema)
    return jobs.drain(jobs.rate_limit(events, "user_id", "ts", "event_id", 6 * 3600, 2), "rate_limit")


@query(
    "WITH r AS (SELECT event_id, user_id, event_type = 'error' AS f, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) "
    "SELECT user_id AS key, event_id AS id, (sum(f::INT) OVER (PARTITION BY user_id, g ORDER BY event_id))::BIGINT AS streak FROM r"
)
def stream_failure_streaks(spark, sf):
    events = jobs.read_table(spark, sf, "events", table(spark, sf, "events").schema)
    return jobs.drain(jobs.failure_streaks(events, "user_id", "ts", "event_id", F.col("event_type") == "error"), "streaks")


@query("SELECT user_id, min(ts) AS first_ts FROM events GROUP BY user_id")
def stream_first_by_key(spark, sf):
    events = jobs.read_table(spark, sf, "events", table(spark, sf, "events").schema)
    # the state is the least time so far, whatever the order of arrival
    least = jobs.drain(events.groupBy("user_id").agg(F.min("ts").alias("first_ts")), "first_by_key", "update")
    return least.groupBy("user_id").agg(F.min("first_ts").cast("timestamp_ntz").alias("first_ts"))


@query("SELECT DISTINCT user_id FROM events")
def stream_links(spark, sf):
    """Each link once, in whatever order its items come; a link is remembered for as long as the table spans."""
    events = jobs.read_table(spark, sf, "events", table(spark, sf, "events").schema).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.drain(jobs.first_by_link(events, "user_id", "ts", "3650 days"), "links").select("user_id")


@query(
    "WITH a AS (SELECT event_id, ts, TIMESTAMP '2024-01-20 10:20:30' + event_id % 7 * INTERVAL 1 DAY AS arrival FROM events) "
    "SELECT event_id, CASE WHEN ts <= arrival + INTERVAL 1 HOUR AND ts >= arrival - INTERVAL 180 DAY THEN ts ELSE date_trunc('minute', arrival) END AS ts FROM a"
)
def restamp(spark, sf):
    arrival = F.lit("2024-01-20 10:20:30").cast("timestamp") + F.make_dt_interval((F.col("event_id") % 7).cast("int"))
    return table(spark, sf, "events").select("event_id", jobs.restamp(F.col("ts").cast("timestamp"), arrival).cast("timestamp_ntz").alias("ts"))


SOURCE = "SELECT s_suppkey::VARCHAR AS id, s_name AS name, 'http://h' || s_suppkey || '.example.com/list' || CASE WHEN s_suppkey % 2 = 0 THEN '?c=1' ELSE '' END AS url, CASE WHEN s_suppkey % 5 = 0 THEN 'http://h' || s_suppkey || '.example.com/feed' END AS rss, s_suppkey % 7 <> 0 AS active FROM supplier"


def _sources(spark, sf):
    """The suppliers as a registry: loaded as one configuration for each nation, over a registry of every third."""
    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    host = F.concat(F.lit("http://h"), k, F.lit(".example.com/"))
    one = {
        "id": k.cast("string"), "name": F.col("s_name"), "url": F.concat(host, F.when(k % 2 == 0, "list?c=1").otherwise("list")), "type": F.lit("web"), "category": F.lit("x"), "priority": F.lit("P0"), "weight": F.lit(1.0),
        "rss": F.when(k % 5 == 0, F.concat(host, F.lit("feed"))).otherwise(""), "selector": F.lit("ul > li"), "active": k % 7 != 0,
    }
    rows = s.select("s_nationkey", *[v.alias(c) for c, v in one.items()])
    config = rows.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(F.struct(*one)).alias("sources"))).alias("value"))
    held = rows.filter("cast(id AS long) % 3 = 0").drop("s_nationkey").withColumns({"name": F.lit("old"), "rss": F.lit("old")})
    return sources_web.upsert_registry(held, config)


@query(f"SELECT id, name, url, rss, active FROM ({SOURCE})")
def source_registry(spark, sf):
    return _sources(spark, sf).select("id", "name", "url", "rss", "active")


@query(
    f"WITH s AS ({SOURCE}), n AS (SELECT unnest(range(7)) AS number) SELECT id AS source_id, number::INT AS number, "
    "CASE WHEN rss IS NOT NULL THEN rss WHEN number = 0 THEN url ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || CASE WHEN number % 2 = 1 THEN 'page=' ELSE 'pageNo=' END || (2 + (number - 1) // 2) END AS url "
    "FROM s, n WHERE active AND (rss IS NULL OR number = 0)"
)
def source_requests(spark, sf):
    return sources_web.list_requests(_sources(spark, sf))


SHELL = "'https://s143js.nicebox.cn/sysTools.php?mod=viewsConn&rtype=json&idweb=' || {} || '&viewid=newsDetail_style_01_' || {} || '&name=newsDetail&style=style_01&langid=0&pageid=' || {} || '&viewCtrl=newsDetail&isfb=1&newsid=' || page_id"


@query(
    f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'dahecube' WHEN 1 THEN 'szsyblxh' WHEN 2 THEN 'syblxh' END AS adapter, "
    f"CASE page_id % 5 WHEN 0 THEN 'https://app.dahecube.com/napi/news/pc/artinfo' WHEN 1 THEN {SHELL.format(58963, 1746604478645, 875615)} WHEN 2 THEN {SHELL.format(63623, 1506318095542, '(page_id + 3)')} END AS endpoint, "
    "CASE WHEN page_id % 5 = 0 THEN '{\"artid\":\"' || page_id || '\"}' END AS post, "
    "CASE WHEN page_id % 5 IN (1, 2) OR (page_id % 5 = 0 AND page_id % 3 = 0) THEN nullif(html, '') END AS body FROM pages"
)
def host_bodies(spark, sf):
    """Bodies of three hosts out of saved answers that hold the pages, a third of those of one host failed."""
    i = F.col("page_id")
    url = F.element_at(
        F.array(
            F.concat(F.lit("https://app.dahecube.com/x?artid="), i), F.concat(F.lit("https://szsyblxh.org.cn/x?newsid="), i), F.concat(F.lit("https://www.syblxh.org.cn/n/"), i + 3, F.lit("-1.html?newsid="), i),
            F.concat(F.lit("https://www.syblxh.org.cn/n/x.html?newsid="), i), F.col("url"),
        ), (i % 5 + 1).cast("int"),
    )
    code = F.when(i % 3 == 0, 0).otherwise(1)
    saved = F.when(i % 5 == 0, F.to_json(F.struct(code.alias("code"), F.struct(F.col("html").alias("content")).alias("data")))).otherwise(F.to_json(F.struct("html")))
    rows = table(spark, sf, "pages").select("page_id", sources_web.body_request(url).alias("q"), saved.alias("answer"))
    return rows.select("page_id", "q.adapter", "q.endpoint", "q.post", sources_web.answer_body(F.col("q.adapter"), F.lit(200), F.col("answer")).alias("body"))
