"""Selectors against a plain tree, and the rules of list pages."""

import datetime as dt
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tessera.operators.jobs import with_selectors
from tessera.sources import selectors as S

VOID = {"br", "img"}


class Tree(HTMLParser):
    """Elements as [tag, attrs, parent], for pages whose tags are all closed."""

    def __init__(self):
        super().__init__()
        self.all, self.open = [], [None]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, self.open[-1]]
        self.all.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()


def matches(node, steps):
    """Whether an element ends the steps, tried from the right with every ancestor."""
    if not steps[-1].fits(node[0], node[1]):
        return False
    if len(steps) == 1:
        return True
    up = node[2]
    while up is not None:
        if matches(up, steps[:-1]):
            return True
        if steps[-1].child:
            return False
        up = up[2]
    return False


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 4)):
        tag = rng.choice(["div", "ul", "span", "section", "br"])
        attrs = "".join(f' {k}="{rng.choice(v)}"' for k, v in (("class", ["x", "y", "x y", "xy"]), ("id", ["i", "j"]), ("data-k", ["ab", "b", "a-b", ""])) if rng.random() < 0.5)
        out += f"<{tag}{attrs}>" if tag in VOID else f"<{tag}{attrs}>{random_page(rng, depth + 1) if depth < 5 else ''}</{tag}>"
    return out


SELECTORS = [
    "div", "*", ".x", "#i", "div.x", "div.x.y", "div#i.y", "ul > span", "div div", "div > ul span.x", "section .x > .y", "[data-k]", "[data-k=b]", "[data-k^='a']", '[data-k$="b"]', "[data-k*=a]", "[data-k|=a]",
    "[class~=y]", "div, span.x", "ul > div > span , #j", "div div div", "* > *", "div[data-k=''] span", ".x .x", "br",
]


def test_selectors_match_what_a_tree_walk_matches():
    rng, hits = random.Random(5), 0
    for _ in range(60):
        page = random_page(rng)
        tree = Tree()
        tree.feed(page)
        for s in SELECTORS:
            steps = S.compiled(s)
            want = [i for i, n in enumerate(tree.all) if any(matches(n, a) for a in steps)]
            got = S._Matches(steps)
            got.feed(page)
            got.finish()
            assert [m["place"] for m in got.matches] == want, (s, page)
            hits += len(want)
    assert hits > 5_000


@pytest.mark.parametrize("bad", ["", "div >", "> div", "div:first-child", "a + b", "div,,p", ".", "[x", "div &"])
def test_what_is_no_selector_is_an_error(bad):
    with pytest.raises(ValueError, match="selector"):
        S.compiled(bad)


PAGE = """<ul id=nav><li><a href="/a/b/menu1">Menu entry one</a></li></ul>
<dl><dd><p class=t>2024-02-03 04:05 <a href="/a/b/1" title="A much longer title than shown">Short title</a></p></dd>
<dd><p class=t><a href="x/y/2.html">Second   item
 title</a> on 2024年3月9日</p></dd><dd><p class=t>no link 2024-01-01</p></dd><dd><p class=t><a href="/a/b/1">Again the first</a></p></dd>
<dd><p class=t><a href="#">Only a fragment</a><a href="/q/r/9">Not the first link</a></p></dd></dl>"""
NOW = dt.datetime(2024, 3, 10, 11, 12)


def as_of():
    return F.lit("2024-03-10 11:12:13").cast("timestamp")


def listed(spark, rows):
    df = spark.createDataFrame([(k, "http://h.org/d/e.html", p, s) for k, (p, s) in enumerate(rows)], "page_id long, url string, html string, selector string")
    return {k: [(r.title, r.href, r.pub_date, r.selected) for r in S.page_list(df, as_of()).orderBy("place").collect() if r.page_id == k] for k in range(len(rows))}


def test_selector_then_links_where_it_leaves_none(spark):
    got = listed(spark, [(PAGE, "dd > p.t"), (PAGE, "dd > p.none"), (PAGE, None), (PAGE, " "), (None, "p"), ("", None), (PAGE, "a[href*='y/']")])
    picked = [("A much longer title than shown", "http://h.org/a/b/1", dt.datetime(2024, 2, 3, 4, 5), True), ("Second item title", "http://h.org/d/x/y/2.html", dt.datetime(2024, 3, 9), True)]
    assert got[0] == picked
    links = [("Menu entry one", "http://h.org/a/b/menu1", NOW, False), (picked[0][0], picked[0][1], NOW, False), (picked[1][0], picked[1][1], NOW, False), ("Not the first link", "http://h.org/q/r/9", NOW, False)]
    assert got[1] == got[2] == got[3] == links
    assert got[4] == got[5] == []
    assert got[6] == [(picked[1][0], picked[1][1], NOW, True)]


def test_overrides_win_over_configured_selectors(spark):
    sources = spark.createDataFrame([("one", "ul > li"), ("two", "ul > li"), ("three", None)], "id string, selector string")
    chosen = with_selectors(sources, {"two": "dd > p", "three": "dl p.t"})
    assert {r.id: r.selector for r in chosen.collect()} == {"one": "ul > li", "two": "dd > p", "three": "dl p.t"}
    pages = chosen.select(F.col("id").alias("page_id"), F.lit("http://h.org/").alias("url"), F.lit(PAGE).alias("html"), "selector")
    assert {(r.page_id, r.n) for r in S.page_list(pages, as_of()).groupBy("page_id").agg(F.count("href").alias("n")).collect()} == {("one", 1), ("two", 2), ("three", 2)}


def test_pages_of_a_source_are_one_list(spark):
    page = lambda ids, says: "".join(f'<li><a href="/n/m/{i}">Item number {i} {says}</a></li>' for i in ids)
    rows = [("s", 1, page([1, 2, 3], "p1")), ("s", 2, None), ("s", 3, page([3, 4], "p3")), ("t", 1, page(range(80), "t"))]
    df = spark.createDataFrame([(*r, "http://h.org/", "li") for r in rows], "source_id string, page_no int, html string, url string, selector string")
    got = S.source_list(df, as_of()).orderBy("source_id", "place").collect()
    assert [(r.place, r.title) for r in got if r.source_id == "s"] == [(1, "Item number 1 p1"), (2, "Item number 2 p1"), (3, "Item number 3 p3"), (4, "Item number 4 p3")]
    assert [r.href for r in got if r.source_id == "t"] == [f"http://h.org/n/m/{i}" for i in range(50)]


def test_deep_and_broken_pages_take_one_pass():
    began = time.time()
    assert len(S.items_of("<div class=x>" * 50_000 + "<a href=/a>text</a>", "div .x")) == 50_000
    assert S.items_of("</li></div>" * 20_000 + "<li><a href=/b/c>t", "li") == [(True, 0, "t", "/b/c", None), (False, 1, "t", "/b/c", None)]
    assert time.time() - began < 6
