import datetime as dt
import json

from pyspark.sql import functions as F

from tessera.operators import health, reports, sinks
from tessera.sources import feeds, html

def as_of():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def test_rss_items(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<rss><channel><item><title> One </title><link>https://x/1</link><description>&lt;p&gt;Body&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item>"
        "<item><title>Two</title><link>https://x/2</link></item><item><title>No link</title></item></channel></rss>"
    )
    rows = sorted(feeds.read_rss(spark, str(tmp_path / "a.xml"), "s1", as_of()).collect(), key=lambda r: r.link)
    assert [(r.title, r.link, r.excerpt) for r in rows] == [("One", "https://x/1", "Body"), ("Two", "https://x/2", "")]
    assert rows[0].pub_date == dt.datetime(2024, 1, 2, 3, 4, 5) and rows[1].pub_date == dt.datetime(2024, 5, 1)


def test_json_lists_and_dispatch(spark, tmp_path):
    body = {"data": {"list": [{"t": "A", "u": "", "v": "https://x/1", "s": "暂无", "d": "2024-01-01"}, {"t": "B", "u": "https://x/2", "s": "text"}, {"t": None, "u": "https://x/3"}]}}
    (tmp_path / "a.json").write_text(json.dumps(body))
    schema = "data struct<list: array<struct<t: string, u: string, v: string, s: string, d: string>>>"
    rows = feeds.read_json_list(spark, str(tmp_path / "a.json"), "s2", schema, "data.list", "t", ["u", "v"], "s", "d", as_of())
    got = sorted(feeds.dispatch([rows, rows]).collect(), key=lambda r: r.link)
    assert [(r.title, r.link, r.excerpt) for r in got] == [("A", "https://x/1", ""), ("B", "https://x/2", "text")]


PAGE = (
    '<html><head><meta name="description" content="A description of the page."></head><body><nav><a href="/n">n</a></nav><form><article onclick="x()"><h1>A headline here</h1>'
    '<p style="width:expression(1)">' + "Text of the story. " * 12 + '</p><a href="javascript:x()">bad</a><img src="/logo.png"><img data-src="pic.jpg"><script>evil()</script>'
    '<p>All rights reserved</p></article></form><time datetime="2024-02-03T04:05:06Z"></time></body></html>'
)


def test_body_of_a_page():
    markup, cover, text = html.body_of(PAGE, "https://x.org/a/b")
    assert cover == "https://x.org/a/pic.jpg" and "Text of the story." in text and "rights" not in text
    assert "onclick" not in markup and "javascript" not in markup and "evil" not in markup and "expression" not in markup
    assert html.body_of("<p>short</p>", None) == ("", None, "") and html.body_of(None, None) == ("", None, "")


def test_page_columns(spark):
    df = spark.createDataFrame([(1, PAGE, "https://x.org/a/b")], "page_id long, html string, url string")
    r = df.select(html.page_title(F.col("html")).alias("t"), html.meta_description(F.col("html")).alias("d"), html.published_at(F.col("html"), as_of()).alias("p"), html.extract_body("html", "url").alias("b")).first()
    assert (r.t, r.d, r.p) == ("A headline here", "A description of the page.", dt.datetime(2024, 2, 3, 4, 5, 6)) and r.b.cover.endswith("pic.jpg")
    hrefs = [x.href for x in html.link_list(df, filtered=False).orderBy("place").collect()]
    assert hrefs[0] == "https://x.org/n"


def test_charsets(spark):
    rows = [("漢字".encode("gbk"), "text/html; charset=GB2312"), (b'<meta charset="gbk">' + "漢".encode("gbk"), None), ("é".encode(), "text/html; charset=nonsense"), (None, None)]
    got = [r[0] for r in spark.createDataFrame([(bytearray(b) if b else None, k) for b, k in rows], "b binary, k string").select(html.decode_html("b", "k")).collect()]
    assert got == ["漢字", '<meta charset="gbk">漢', "é", None]


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in sinks.insert_if_absent(old, new.union(new), ["id"], [F.col("v")]).collect()] == [(3, "d")]
    none = spark.createDataFrame([(1, None), (2, "b")], "id long, v string")
    assert [r.id for r in sinks.changed_only(old, none, "id", ["v"]).collect()] == [1]


def test_closed_period_keeps_its_report(spark):
    schema = "year int, period_end date, n int"
    old = spark.createDataFrame([(1, dt.date(2024, 1, 1), 5), (2, dt.date(2024, 9, 1), 6)], schema)
    new = spark.createDataFrame([(1, dt.date(2024, 1, 1), 7), (2, dt.date(2024, 9, 1), 8)], schema)
    assert sorted(r.n for r in sinks.snapshot_guard(new, old, ["year"], "2024-05-01").collect()) == [5, 8]
    assert sorted(r.n for r in sinks.snapshot_guard(new, old, ["year"], "2024-05-01", force=True).collect()) == [7, 8]


def test_fixed_start_windows(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate((0, 30, 60, 61, 90, 122))], "ip long, id long, ts timestamp")
    got = sorted((r.id, r.in_window, r.allowed) for r in health.rate_limit(df, "ip", "ts", "id", 60, 2).collect())
    assert got == [(0, 1, True), (1, 2, True), (2, 3, False), (3, 1, True), (4, 2, True), (5, 1, True)]


def test_day_without_selected_items_shows_the_week_before(spark):
    rows = [(1, dt.datetime(2024, 1, 5, 3), 40.0, "selected"), (2, dt.datetime(2024, 1, 6, 3), 5.0, "selected"), (3, dt.datetime(2024, 1, 8, 3), 20.0, "pending")]
    df = spark.createDataFrame(rows, "id long, pub_date timestamp, score double, status string")
    assert sorted((r.section, r.rank, r.id) for r in reports.daily_report(df, "2024-01-08").collect()) == [("recent_highlights", 1, 1), ("review_signals", 1, 3)]


def test_dangerous_elements_and_attributes_are_taken_out():
    page = (
        "<article>" + "<p>" + "Text of the story. " * 12 + '</p><object data="x"><p>inner</p></object><embed src="y"><svg onload="z()"></svg><math></math><base href="//evil"><meta http-equiv="refresh">'
        '<a xlink:href=" JavaScript:x()" style="background:url( javascript:1)">a</a><p style="background:url(pic.png)">kept</p></article>'
    )
    markup, _, text = html.body_of(page, "https://x.org/")
    for word in ("object", "embed", "svg", "math", "base", "meta", "onload", "avaScript", "javascript", "inner"):
        assert word not in markup, word
    assert "url(pic.png)" in markup and "kept" in text


def test_head_of_a_body_is_stripped_to_its_first_real_child():
    story = "<p>" + "Text of the story. " * 12 + "</p>"
    _, _, text = html.body_of(f'<article><div class="top-bar">Hello</div><p>Sign in</p><div><a href="/x">All</a></div><div></div><h2>Head</h2>{story}<p>Login below stays</p></article>', None)
    assert text.split()[:2] == ["Head", "Text"] and "Login below stays" in text
    _, cover, _ = html.body_of(f'<article>{story}<img src="a.jpg" width="20" height="400"><img src="b.jpg" width="640"></article>', "https://x.org/a/")
    assert cover == "https://x.org/a/b.jpg"


def test_titles_and_dates_by_their_cascades(spark):
    rows = [
        ("<meta content='Title by meta' property='og:title'><h1>Another headline</h1>", "Title by meta"), ('<meta name="twitter:title" content="short"><div class="x aTitle">Title by class</div>', "Title by class"),
        ("<h1>First headline</h1><article><p>x</p><h1>Article headline</h1></article>", "Article headline"), ("<h1>新闻标题</h1><title>No title of these</title>", None),
    ]
    got = spark.createDataFrame(rows, "html string, want string").select("want", html.page_title(F.col("html")).alias("t")).collect()
    assert [r.t for r in got] == [r.want for r in got]
    rows = [
        ('<meta name="pubdate" content="2024-02-03"><time datetime="2024-01-01">x</time>', "u", "2024-02-03"), ('<meta name="pubdate" content="1980-02-03"><time>2024-01-01</time>', "u", "2024-01-01"),
        ("<head>2001-01-01</head><body>on 2024年3月5日 we</body>", "u", "2024-03-05"), ("<body>nothing</body>", "https://x/?a=1&_t=1700000000#x", "2023-11-14"), ("<body>2031-01-01</body>", "u", None),
    ]
    got = spark.createDataFrame(rows, "html string, url string, want string").select("want", F.to_date(html.published_at(F.col("html"), as_of(), F.col("url"))).cast("string").alias("t")).collect()
    assert [r.t for r in got] == [r.want for r in got]


def test_links_are_resolved_as_readers_do(spark):
    from urllib.parse import urljoin

    base = "https://x.org/a/b/c.html?q=1#f"
    links = ["/n", "d.html", "./d.html", "../d.html", "../../../d", "?p=2", "#top", "", "//y.org/z", "http://y.org", "mailto:a@b", "d/../e?x=/../1", "..", ".", "d/"]
    got = {r.h: r.u for r in spark.createDataFrame([(h, base) for h in links], "h string, b string").select("h", html.resolve(F.col("h"), F.col("b")).alias("u")).collect()}
    assert got == {h: urljoin(base, h) if h else "https://x.org/a/b/c.html?q=1" for h in links}


def test_answers_that_are_no_pages(spark):
    rows = [(1, "%PDF-1.4", "u", None), (2, PAGE, "https://x.org/a", "image/png"), (3, PAGE, "https://x.org/a", "text/html"), (4, None, "u", None), (5, '<meta name="description" content="A description of the page.">', "u", "")]
    got = {r.page_id: r for r in html.article_page(spark.createDataFrame(rows, "page_id long, html string, url string, kind string"), as_of(), content_type="kind").collect()}
    assert [got[i].title for i in (1, 2, 4)] == [None] * 3 and got[3].title == "A headline here" and not got[3].summary_only
    assert got[5].summary_only and got[5].text == "A description of the page." and got[5].tier == "external"
