"""Main text of pages by equivalence classes of tokens.

A page becomes a sequence of tokens: the path of each element (tags with class or id) and each block of text. Over the
pages of a host, tokens with the same occurrence vector - how often each page holds them - form an equivalence class. A
vector is kept as an exclusive-or of hashes of (page, count), so it can be summed in parts and a host's pages never meet
in one task. Equal pages of a host count as one, and so do pages whose article elements have the same longest block, if it
is a paragraph: they are copies of one article. Classes that are found on most of a host's pages and hold several tokens are valid if their tokens stand in one
order on most of the pages. The one on most pages is the root of the template; another belongs to it if it lies within one
slot of the root, the same on most pages: so the classes nest. What the template doesn't hold is what its slots hold:
blocks of the article in slots are the text; on pages without an article element those outside menus, notices and the like.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, settle

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^<>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
SPACE = re.compile(r"\s+")

# Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside form button dialog menu head".split())
ARTICLE = frozenset("article main".split())
ASIDE_NAME = frozenset(
    """ad ads advert advertisement adverts banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent
    notice notices popup modal newsletter subscribe share sharing social related recommended comment comments disqus reply replies footer header masthead
    toolbar widget pagination pager skip""".split()
)
ASIDE_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: A page opened by one of these tags closes an open p, as readers of HTML do.
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",))}

#: Elements of text, whose id is the name of a place in it and no kind of element.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote figcaption pre".split())
#: Characters of a path; a longer one is told by its hash.
LONGEST_PATH = 1_000

#: Share of a host's pages that a class must be found on, fewest pages, and fewest tokens of a valid class.
MOST, FEWEST_PAGES, FEWEST_TOKENS = 0.6, 4, 3
#: Characters of a block that tells copies of an article.
PARAGRAPH = 80


def blocks(page: str) -> Iterator[tuple[str, str, int, int]]:
    """(path, text, article, aside) of each block of text in page order.

    article is 1 within an article, 2 if what holds the article is an aside by its name; aside is 1 within an aside by
    its name, 2 within one by its element, role or hiding. An article ends an aside by name that holds it. Elements themselves are given too, as their path with text ''."""
    stack: list[tuple[str, str, int, int, int]] = []  # tag, path, article, aside, place of the block that holds it or is it (-1: none)
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    at = 0

    def block() -> tuple[str, str, int, int]:
        at = stack[-1][4] if stack else -1
        return stack[at][:4] if at >= 0 else ("", "", 0, 0)

    def last(*tags: str) -> int | None:
        """The place of the innermost open element of these tags."""
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in tags), None) if any(open_tags[t] for t in tags) else None

    def cut(i: int) -> None:
        open_tags.subtract(x[0] for x in stack[i:])
        del stack[i:]

    def read(text: str) -> None:
        # an aside within a block, such as an advert in a paragraph, is no part of it
        if text and not (stack and stack[-1][0] in INLINE and stack[-1][3] > block()[3]):
            parts.append(text)

    def flush():
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            _, path, article, aside = block()
            return [(path, text, article, aside)]
        return []

    for m in TOKEN.finditer(page):
        read(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br" or tag in VOID:
            parts.append(" ")
            if tag == "hr":
                yield from flush()
            continue
        if m["end"]:
            if tag not in INLINE:
                yield from flush()
                if (i := last(tag)) is not None:
                    cut(i)
            elif open_tags[tag]:
                i = next((i for i in range(len(stack) - 1, stack[-1][4], -1) if stack[i][0] == tag), None)  # within its block
                if i is not None:
                    cut(i)
            continue
        if tag not in INLINE:
            yield from flush()
            if tag in CLOSES_P and block()[0] == "p":
                cut(stack[-1][4])
            if tag in SAME:
                own, scope = SAME[tag]
                i = last(*own.split(), *scope)
                if i is not None and stack[i][0] in own.split():
                    cut(i)
        found: dict[str, str] = {}
        for key, *values in ATTR.findall(m["attrs"]) if m["attrs"].strip() else ():
            found.setdefault(key.lower(), html.unescape("".join(values)))  # the first of a repeated attribute holds
        classes = found.get("class", "").split()
        name = " ".join([*classes, *([found["id"]] if found.get("id") else [])])
        above = stack[-1] if stack else ("", "", 0, 0, -1)
        begins = not above[2] and (tag in ARTICLE or found.get("role", "").lower() in ("main", "article"))
        article = (2 if above[3] == 1 else 1) if begins else above[2]
        # the heading of an article is part of it; a page's header is not
        heading = tag == "header" and above[2]
        apart = tag in ASIDE and tag != "form" and not heading or found.get("role", "").lower() in ASIDE_ROLE or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        named = bool(name and tag not in ("html", "body") and tag not in ARTICLE and not begins and not heading and not ASIDE_NAME.isdisjoint([*(c.lower() for c in classes), *([found.get("id", "").lower()] if tag not in TEXTUAL else [])]))
        named |= tag == "form"  # like a wrapper of such a name, it may hold the article or the whole page
        aside = max(0 if begins and above[3] == 1 else above[3], 2 if apart else int(named))
        path = f"{above[1]}>{tag}" + (f".{name}" if name else "") if tag not in INLINE else above[1]
        path = path if len(path) <= LONGEST_PATH else f"#{_digest(path)}"
        stack.append((tag, path, article, aside, len(stack) if tag not in INLINE else above[4]))
        open_tags[tag] += 1
        if tag not in INLINE:
            yield path, "", article, aside
    read(page[at:])
    yield from flush()


def main_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The article's blocks that the template does not hold; without an article element, all such blocks not aside.

    Where the template holds all of them they are the page's only content, and stay. Of an article the template takes what heads
    or ends it: labels between its own blocks are its text. What is an aside by name alone, or a form, counts where it holds most
    of the page's text and nothing else is left."""
    found = [(path, text, article, aside) for path, text, article, aside in blocks(page or "") if text]
    plain = [(path, text, article) for path, text, article, aside in found if not aside]
    soft = [(path, text, article) for path, text, article, aside in found if aside == 1]
    if not plain and 2 * sum(len(x[1]) for x in soft) > sum(len(x[1]) for x in found):
        plain = soft
    # articles that stand in an aside by name count where no other is, such as a lone article in a wrapper of that name
    kind, rest = next(((k, some) for k in (1, 2, 0) if (some := [(path, text) for path, text, article in plain if article == k])), (0, []))
    if template and rest:
        own = [i for i, mark in enumerate(token_hashes([f"{path}|{text}" for path, text in rest])) if int(mark) not in template]
        if own:
            rest = rest[own[0] : own[-1] + 1] if kind else [rest[i] for i in own]
    return "\n".join(text for _, text in rest)


def token_hashes(tokens: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(tokens, dtype=object), categorize=False).view(np.int64)


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for host, page in zip(pdf.host, pdf.html, strict=True):
            found = list(blocks(page or ""))
            if not found:
                continue
            tokens = [f"{path}|{text}" for path, text, _, _ in found]
            first, last, counts = {}, {}, Counter(tokens)
            for place, token in enumerate(tokens):
                first.setdefault(token, place)
                last[token] = place
            texts = {token for token, block in zip(tokens, found, strict=True) if block[1]}
            # equal pages are one page, whatever their ids
            page_id = _digest("\0".join(tokens))
            longest = max((text for _, text, article, aside in found if article and not aside), key=len, default="")
            out.append(
                pd.DataFrame(
                    {
                        "host": host, "token": token_hashes(list(counts)), "is_text": [t in texts for t in counts], "n": list(counts.values()), "page": page_id,
                        "longest": _digest(longest) if len(longest) >= PARAGRAPH else page_id, "first": [first[t] for t in counts], "last": [last[t] for t in counts],
                    }
                )
            )
        if out:
            yield pd.concat(out)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True)


TOKENS = "host string, token long, is_text boolean, n long, page long, longest long, first int, last int"


def templates(pages: DataFrame) -> DataFrame:
    """host, tokens: the text tokens of each host's template. ``pages`` has host and html; copies of a page count once."""
    everywhere = settle(pages.mapInPandas(_tokens, TOKENS).distinct(), "page_tokens")
    chosen = everywhere.groupBy("host", "longest").agg(F.min("page").alias("page")).select("host", "page").distinct()
    tokens = settle(everywhere.join(settle(chosen, "pages_once"), ["host", "page"]), "tokens_once")
    vectors = tokens.groupBy("host", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count(F.lit(1)).alias("n_pages"), F.max("n").alias("most"), F.max("is_text").alias("is_text")
    )
    sizes = tokens.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    frequent = vectors.filter(F.col("n_pages") >= FEWEST_PAGES).join(sizes, "host").filter(F.col("n_pages") >= MOST * F.col("host_pages"))
    frequent = settle(frequent, "frequent_tokens")
    classes = frequent.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("size"), F.max("n_pages").alias("n_pages"), F.max("most").alias("most")).filter(F.col("size") >= FEWEST_TOKENS)
    roots = classes.filter("most = 1").groupBy("host").agg(F.max(F.struct("n_pages", "size", "vector")).alias("root")).select("host", F.col("root.vector").alias("root"))
    members = frequent.select("host", "token", "vector", "is_text").join(classes.select("host", "vector"), ["host", "vector"])
    members = settle(members.join(roots, "host"), "class_members")
    # where the tokens of each class stand on each page: a page's tokens are no more than the page
    stand = tokens.select("host", "page", "token", "first", "last").join(members, ["host", "token"])
    order = F.transform(F.sort_array(F.collect_list(F.struct("first", "token"))), lambda x: x["token"])
    spans = stand.groupBy("host", "page", "vector", "root").agg(F.xxhash64(order).alias("sequence"), F.min("first").alias("lo"), F.max("last").alias("hi"))
    marks = stand.filter("vector = root").groupBy("host", "page").agg(F.collect_list("first").alias("marks"))
    before = lambda at: F.when(F.col("vector") == F.col("root"), 0).otherwise(F.size(F.filter(F.coalesce("marks", F.array()), lambda m: m < F.col(at))))
    placed = spans.join(marks, ["host", "page"], "left").select("host", "vector", "sequence", before("lo").alias("lo_slot"), before("hi").alias("hi_slot"))
    alike = placed.groupBy("host", "vector", "sequence", "lo_slot", "hi_slot").agg(F.count(F.lit(1)).alias("n"))
    commonest = alike.groupBy("host", "vector").agg(F.max(F.struct("n", (F.col("lo_slot") == F.col("hi_slot")).alias("inside"))).alias("top"), F.sum("n").alias("all"))
    nested = commonest.filter(F.col("top.inside") & (F.col("top.n") >= MOST * F.col("all"))).select("host", "vector")
    # a class on most pages has no more tokens than a page has, divided by that share
    return members.filter("is_text").join(nested, ["host", "vector"]).groupBy("host").agg(F.collect_list("token").alias("tokens"))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = [main_text(h, frozenset() if t is None else frozenset(map(int, t))) for h, t in zip(pdf.html, pdf.tokens, strict=True)]
        yield pd.DataFrame({"page_id": pdf.page_id, "url": pdf.url, "text": text, "n_chars": [len(t) for t in text]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty page has the text ''. A null url has the host ''. Repeated rows are each extracted; other columns
    are not read; very long pages are parsed whole. Where classes tie for the root the larger hash takes it. An empty
    table gives none.
    """
    named = only(pages, "page_id", "url", "html").withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))))
    known = settle(templates(named.select("host", "html")).select(F.col("host").alias("h"), "tokens"), "templates")
    return named.join(known, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "tokens").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")
