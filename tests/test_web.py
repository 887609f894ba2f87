"""Source plug-ins: the registry, requests, adapters of hosts, and answers from a server of the test's own."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.sources import selectors, web


class Handler(BaseHTTPRequestHandler):
    def _say(self, status, kind, body):
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        if "pageNo" in self.path:
            self._say(404, "text/plain", "none")
        elif self.path.startswith("/list"):
            n = self.path.rpartition("page=")[2] if "page=" in self.path else "1"
            self._say(200, "text/html; charset=utf-8", f'<ul><li><a href="/n/m/{n}">Item of the page {n} é</a></li><li><a href="/n/m/1">Item again on {n}</a></li></ul>')
        else:
            self._say(200, "application/rss+xml", "<rss/>")

    def do_POST(self):
        sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self._say(200, "application/json", json.dumps({"code": 0, "data": {"content": f"<p>body of {sent['artid']}</p>"}}))

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


SOURCES = [
    {"id": "a", "name": "A", "url": "{}/list", "type": "web", "category": "x", "priority": "P0", "weight": 1.5, "rss": "", "selector": "ul > li", "active": True},
    {"id": "b", "name": "B", "url": "{}/", "rss": " {}/feed ", "active": True},
    {"id": "c", "name": "C", "url": "{}/list?x=1", "active": False},
    {"id": "d", "name": "D", "url": "http://127.0.0.1:9/closed", "active": True},
]


def config(spark, base, more=()):
    text = json.dumps({"sources": [*SOURCES, *more]}).replace("{}", base)
    return spark.createDataFrame([(text,)], "value string")


def test_registry_replaces_by_id_and_keeps_the_others(spark):
    held = web.registry(config(spark, "http://h"))
    assert {r.id: (r.rss, r.selector, r.weight) for r in held.collect()} == {"a": (None, "ul > li", 1.5), "b": (" http://h/feed ", None, None), "c": (None, None, None), "d": (None, None, None)}
    new = spark.createDataFrame([(json.dumps({"sources": [{"id": "a", "name": "first"}, {"id": "a", "name": "A2"}, {"id": "z"}, {"name": "no id"}]}),), (None,), ("no json",)], "value string")
    got = {r.id: r.name for r in web.upsert_registry(held, new).collect()}
    assert got == {"a": "A2", "b": "B", "c": "C", "d": "D", "z": None}


def test_answers_are_read_a_partition_for_each_source_and_failures_are_rows(spark, server):
    sources = web.registry(config(spark, server))
    requests = web.list_requests(sources)
    urls = {(r.source_id, r.number): r.url for r in requests.collect()}
    assert urls["a", 0] == f"{server}/list" and urls["a", 1] == f"{server}/list?page=2" and urls["a", 6] == f"{server}/list?pageNo=4"
    assert urls["b", 0] == f"{server}/feed" and len(urls) == 15 and not any(s == "c" for s, _ in urls)
    answers = web.ask(spark, requests, timeout="3")
    assert answers.rdd.getNumPartitions() == 3
    rows = {(r.source_id, r.number): r for r in answers.collect()}
    assert len(rows) == 15
    assert rows["b", 0].content_type == "application/rss+xml" and bytes(rows["b", 0].body) == b"<rss/>"
    assert rows["a", 2].status == 404 and rows["a", 2].body is None and rows["a", 2].error == "HTTP 404"
    assert rows["d", 0].status is None and "Error" in rows["d", 0].error
    pages = answers.join(sources.select(F.col("id").alias("source_id"), "selector"), "source_id").filter("source_id = 'a'")
    pages = pages.select("source_id", F.col("number").alias("page_no"), "url", F.col("body").cast("string").alias("html"), "selector")
    got = selectors.source_list(pages, F.lit("2024-01-01").cast("timestamp")).orderBy("place").collect()
    assert [(r.href.rpartition("/")[2], r.title) for r in got] == [("1", "Item again on 4"), ("2", "Item of the page 2 é"), ("3", "Item of the page 3 é"), ("4", "Item of the page 4 é")]


def test_more_requests_than_allowed_are_an_error(spark):
    with pytest.raises(ValueError, match="in parts"):
        web.ask(spark, spark.range(5).selectExpr("'s' AS source_id", "cast(id AS int) AS number", "'http://h' AS url"), most=4)
    assert web.ask(spark, spark.range(0).selectExpr("'s' AS source_id", "1 AS number", "'http://h' AS url")).collect() == []
    odd = web.ask(spark, spark.range(1).selectExpr("'s' AS source_id", "1 AS number", "'file:///etc/passwd' AS url")).collect()
    assert odd[0].body is None and "no address" in odd[0].error


def test_bodies_by_host(spark, server):
    urls = [
        "https://app.dahecube.com/x?artid=12%2B3", "https://dahecube.com/x", "https://www.szsyblxh.org.cn/a?newsid=7", "https://syblxh.org.cn/n/44-2.html?newsid=8", "https://syblxh.org.cn/n/44.html?newsid=8",
        "https://other.org/x?artid=1", "no url", None,
    ]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string").withColumn("q", web.body_request(F.col("url")))
    got = {r.id: r.q for r in rows.collect()}
    assert (got[0].adapter, got[0].post) == ("dahecube", '{"artid":"12+3"}') and got[1] is None
    assert got[2].endpoint.endswith("&newsid=7") and "idweb=58963" in got[2].endpoint and got[2].post is None
    assert got[3].endpoint.endswith("pageid=44&viewCtrl=newsDetail&isfb=1&newsid=8") and all(got[i] is None for i in (4, 5, 6, 7))
    answers = [("dahecube", 200, '{"code": 0, "data": {"content": "<p>x</p>"}}'), ("dahecube", 200, '{"code": 1, "data": {"content": "x"}}'), ("dahecube", 500, '{"code": 0, "data": {"content": "x"}}'), ("syblxh", 200, '{"html": "<b>"}'), ("szsyblxh", 200, '{"html": ""}'), ("syblxh", 200, "no json"), ("none", 200, "{}"), (None, None, None)]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(answers)], "id int, adapter string, status int, answer string")
    assert [r.b for r in df.orderBy("id").select(web.answer_body(F.col("adapter"), F.col("status"), F.col("answer")).alias("b")).collect()] == ["<p>x</p>", None, None, "<b>", None, None, None, None]
    asked = rows.filter("id = 0").selectExpr("'s' AS source_id", "1 AS number", f"'{server}/post' AS url", "q.post AS post", "q.adapter AS adapter")
    answer = web.ask(spark, asked).withColumn("adapter", F.lit("dahecube"))
    assert answer.select(web.answer_body(F.col("adapter"), F.col("status"), F.col("body").cast("string")).alias("b")).first().b == "<p>body of 12+3</p>"


def test_dates_and_scores_are_worked_out_once_a_row(spark):
    from pyspark.sql import functions as F

    from tessera.operators import selection
    from tessera.sources import html as H

    df = spark.createDataFrame([("<body>2024-01-02</body>", "{}")], "html string, payload string")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(H.published_at(F.col("html"), F.lit("2024-03-01").cast("timestamp"))).count("<body") <= 2
    assert plan(selection.parse_scores(F.col("payload"))).count("parse_json") + plan(selection.parse_scores(F.col("payload"))).count("parseJson") <= 6
