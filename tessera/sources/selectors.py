"""Items of list pages by CSS selectors, matched while the page is read.

A selector is compiled to steps (tag, id, classes, attributes) with the relation of each to the one before. While a page's
tags go by, each open element holds which beginnings of the selectors end at it and which end at an element above it; a new element
follows from its parent's two sets, so a page takes one pass whatever its depth, and no tree is built. What an item
holds, its first link and first date, are places in the page's text, looked up when the element ends.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.urls import article_like_url, noise_link
from tessera.sources.html import LIST_DATE, SPACES, VOID, resolve

_SIMPLE = re.compile(r"""\s*(?:(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\])""")
_BETWEEN = re.compile(r"\s*([>,])\s*|\s+")
_TESTS = {
    "=": lambda have, want: have == want, "~=": lambda have, want: want in have.split(), "^=": lambda have, want: want != "" and have.startswith(want),
    "$=": lambda have, want: want != "" and have.endswith(want), "*=": lambda have, want: want != "" and want in have, "|=": lambda have, want: have == want or have.startswith(f"{want}-"),
}


class Step:
    """One element of a selector; ``child`` if it must stand right below the one before."""

    __slots__ = ("attrs", "child", "classes", "tag")

    def __init__(self, child: bool):
        self.child, self.tag, self.classes, self.attrs = child, None, set(), []

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        return (
            (self.tag is None or self.tag == tag) and (not self.classes or self.classes <= set(attrs.get("class", "").split()))
            and all(name in attrs and (op is None or _TESTS[op](attrs[name], want)) for name, op, want in self.attrs)
        )


@lru_cache(maxsize=1024)
def compiled(selector: str) -> tuple[tuple[Step, ...], ...]:
    """The alternatives of a selector. Tags, ids, classes, attribute tests, descendants and children are known; a selector with
    anything else is an error."""
    found: list[list[Step]] = [[]]
    text, at, child, fresh = selector.strip(), 0, False, True
    while at < len(text):
        m = None if fresh else _BETWEEN.match(text, at)
        if m:
            if m[1] == ",":
                found.append([])
            child, fresh, at = m[1] == ">", True, m.end()
            continue
        m = _SIMPLE.match(text, at)
        if not m or (m["tag"] and not fresh):
            raise ValueError(f"selector {selector!r} is not understood at {text[at:]!r}")
        if fresh:
            found[-1].append(Step(child))
            child, fresh = False, False
        step = found[-1][-1]
        if m["tag"]:
            step.tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            step.attrs.append(("id", "=", m["id"]))
        elif m["cls"]:
            step.classes.add(m["cls"])
        else:
            step.attrs.append((m["attr"].lower(), m["op"], next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")))
        at = m.end()
    if fresh or not all(found):
        raise ValueError(f"selector {selector!r} ends early")
    return tuple(map(tuple, found))


class _Matches(HTMLParser):
    """Matched elements and links of a page in order: (is match, place of its start, first link, text from, text to)."""

    def __init__(self, alternatives: tuple[tuple[Step, ...], ...]):
        super().__init__(convert_charrefs=True)
        # a beginning of an alternative is a bit; its last step's bit tells a match
        self.steps, self.last, bit = [], 0, 0
        for steps in alternatives:
            for k, step in enumerate(steps):
                self.steps.append((1 << bit, (1 << (bit - 1)) if k else 0, step))
                bit += 1
            self.last |= 1 << (bit - 1)
        self.open: list[tuple[str, int, int, dict | None, dict | None]] = [("", 0, 0, None, None)]
        self.counts: dict[str, int] = {}
        self.texts: list[str] = []
        self.size, self.place = 0, 0
        self.matches: list[dict] = []
        self.links: list[dict] = []

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "a":  # a link ends where the next begins
            self._close("a")
        elif tag in ("li", "p") and self.open[-1][0] == tag:
            self._close(tag)
        here, above = self.open[-1][1], self.open[-1][2]
        own = 0
        for bit, before, step in self.steps:
            if (not before or (here if step.child else above) & before) and step.fits(tag, attrs):
                own |= bit
        match = link = None
        if own & self.last:
            match = {"place": self.place, "from": self.size, "to": None, "link": None, "after": len(self.links)}
            self.matches.append(match)
        if tag == "a":
            link = {"place": self.place, "from": self.size, "to": None, "href": attrs.get("href"), "title": attrs.get("title", "")}
            self.links.append(link)
        self.place += 1
        if tag in VOID:
            for x in (match, link):
                if x is not None:
                    x["to"], x["until"] = self.size, len(self.links)
            return
        self.open.append((tag, own, above | own, match, link))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def _close(self, tag: str) -> None:
        if not self.counts.get(tag):
            return
        while True:
            name, _, _, match, link = self.open.pop()
            self.counts[name] -= 1
            for x in (match, link):
                if x is not None:
                    x["to"], x["until"] = self.size, len(self.links)
            if name == tag:
                return

    def handle_endtag(self, tag):
        self._close(tag)

    def handle_data(self, data):
        self.texts.append(data)
        self.size += len(data)

    def finish(self) -> None:
        self.close()
        for name in [x[0] for x in self.open[:0:-1]]:
            self._close(name)


_DATE = re.compile(LIST_DATE)


def items_of(page: str | None, selector: str | None) -> list[tuple[bool, int, str, str, str | None]]:
    """(selected, place, title, href, date) of the items of a page: elements that the selector matches, with their first link,
    and all links of the page, not selected. The title is the longer of the link's text and its title attribute."""
    p = _Matches(compiled(selector) if selector and selector.strip() else ())
    p.feed(page or "")
    p.finish()
    text = "".join(p.texts)
    dates = [(m.start(), m.end(), m[0]) for m in _DATE.finditer(text)]
    starts = [d[0] for d in dates]

    def item(selected: bool, place: int, link: dict, begin: int, end: int) -> tuple:
        shown, title = (SPACES.sub(" ", x).strip() for x in (text[link["from"] : link["to"]], link["title"]))
        k = bisect_left(starts, begin)
        date = dates[k][2] if k < len(dates) and dates[k][1] <= end else None
        return selected, place, title if len(title) > len(shown) else shown, link["href"] or "", date

    found = []
    for m in p.matches:
        if m["after"] < m["until"]:  # the first link in it, or it itself
            found.append(item(True, m["place"], p.links[m["after"]], m["from"], m["to"]))
    return found + [item(False, x["place"], x, x["from"], x["to"]) for x in p.links]


ITEM = T.ArrayType(T.StructType().add("selected", "boolean").add("place", "integer").add("title", "string").add("href", "string").add("date", "string"))


@F.pandas_udf(ITEM)
def page_items(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, selectors in batches:
        yield pd.Series([[dict(zip(("selected", "place", "title", "href", "date"), x, strict=True)) for x in items_of(p, s)] for p, s in zip(pages, selectors, strict=True)])


def item_time(date: Column, as_of: Column) -> Column:
    """The time in an item's text, else the minute of ``as_of``."""
    at = [F.regexp_extract(date, LIST_DATE, i) for i in range(1, 6)]
    clock = F.when(at[3] != "", F.concat(F.lpad(at[3], 2, "0"), F.lit(":"), at[4])).otherwise("00:00")
    return F.coalesce(F.try_to_timestamp(F.concat(at[0], F.lit("-"), F.lpad(at[1], 2, "0"), F.lit("-"), F.lpad(at[2], 2, "0"), F.lit(" "), clock)), F.date_trunc("minute", as_of))


def page_list(pages: DataFrame, as_of: Column, key: str = "page_id", url: str = "url", html: str = "html", selector: str = "selector") -> DataFrame:
    """key, place, title, href, pub_date, selected: the items of each page by its selector, or where that leaves none, all
    article-like links. Noise goes in both; of items with one address on a page the first counts. A null or empty selector
    selects nothing."""
    rows = pages.select(F.col(key), F.col(url).alias("_base"), F.explode(page_items(F.col(html), F.col(selector).cast("string"))).alias("i")).select(key, "_base", "i.*")
    rows = rows.filter(~noise_link(F.col("title"), F.col("href"))).withColumn("_href", resolve(F.col("href"), F.col("_base")))
    rows = rows.filter(F.col("selected") | article_like_url(F.col("_href")))
    any_selected = F.max("selected").over(Window.partitionBy(key))  # of one page
    rows = rows.withColumn("_any", any_selected).filter(F.col("selected") == F.col("_any"))
    first = rows.groupBy(key, F.col("_href").alias("href")).agg(F.min_by(F.struct("place", "title", item_time(F.col("date"), as_of).alias("pub_date"), "selected"), "place").alias("r"))
    return first.select(key, "r.place", "r.title", "href", "r.pub_date", "r.selected")


def source_list(pages: DataFrame, as_of: Column, source: str = "source_id", number: str = "page_no", most: int = 50, **columns: str) -> DataFrame:
    """source, place, title, href, pub_date: the items of each source over its pages in order of ``number``; an address counts once,
    at its first place with what its last one says, and the first ``most`` of a source are taken. A page that failed (null html)
    is passed over."""
    key = F.struct(source, number)
    items = page_list(pages.filter(F.col(columns.get("html", "html")).isNotNull()).withColumn("_page", key), as_of, "_page", **columns)
    rows = items.select(F.col(f"_page.{source}").alias(source), F.struct(F.col(f"_page.{number}").alias("n"), "place").alias("at"), "title", "href", "pub_date")
    merged = rows.groupBy(source, "href").agg(F.min("at").alias("first"), F.max_by(F.struct("title", "pub_date"), "at").alias("r"))
    place = F.row_number().over(Window.partitionBy(source).orderBy("first", "href"))  # the pages of a source are few
    return merged.withColumn("place", place).filter(F.col("place") <= most).select(source, "place", "r.title", "href", "r.pub_date")
