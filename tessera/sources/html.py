"""Pages: title, description and links by expressions; bodies by a small tree in a pandas function."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import build_excerpt, content_tier, once, plain_text
from tessera.functions.urls import article_like_url, noise_link

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


SPACES = re.compile(r"\s+")


def decoded(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style|noscript)\\b.*?</\\1\\s*>|<!--.*?-->", " ")
    return decoded(plain_text(bare))


def meta_description(html: Column) -> Column:
    """The description of at least 20 characters, or null."""
    found = F.trim(decoded(F.regexp_extract(html, "(?is)<meta\\b[^>]*name=[\"']description[\"'][^>]*content=\"([^\"]*)\"", 1)))
    return F.when(F.length(found) >= 20, found)


def attribute(html: Column, tag: str, pick: str, value: str, wanted: str) -> Column:
    """An attribute of the first ``tag`` whose attribute ``pick`` is ``value``, in either order of the two; '' if none is."""
    quoted = "(?:\"([^\"]*)\"|'([^']*)')"
    key = f"\\b{pick}=[\"']?{value}[\"'\\s>/]"
    found = F.regexp_extract(html, f"(?is)(<{tag}\\b[^>]*?{key}[^>]*>?)", 1)
    held = F.regexp_extract(found, f"(?is)\\b{wanted}={quoted}", 1)
    return F.when(held != "", held).otherwise(F.regexp_extract(found, f"(?is)\\b{wanted}={quoted}", 2))


# Where pages keep their titles and dates, in order.
TITLE_META = (("property", "og:title"), ("name", "twitter:title"))
TITLE_CLASSES = ("aTitle", "newsBigTit")
PLACEHOLDER_TITLE = "新闻标题"
#: Stands for the tags of articles; no text holds it.
MARK = "\uffff"
DATE_META = (
    ("name", "publishdate"), ("name", "pubdate"), ("name", "publish_date"), ("name", "publishDate"), ("name", "article:published_time"), ("property", "article:published_time"),
    ("property", "og:article:published_time"), ("name", "Date"), ("name", "pub_date"), ("name", "createtime"),
)


def page_title(html: Column) -> Column:
    """The first of the meta titles, the article's h1, the title classes and any h1 that has 6 to 200 characters and is no placeholder."""
    h1 = "<h1\\b[^>]*>(.*?)</h1>"
    begun = F.split(F.regexp_replace(html, "(?i)<(?=/?article\\b)", MARK), MARK)  # at every tag of an article
    inside = F.array_join(F.filter(begun, lambda s: s.rlike("^(?i)article\\b")), MARK)
    found = [attribute(html, "meta", k, v, "content") for k, v in TITLE_META] + [F.regexp_extract(inside, f"(?is){h1}", 1)]
    found += [F.regexp_extract(html, f"(?is)<([a-z0-9]+)\\b[^<>]*class=[\"'](?:[^\"'<>]*\\s)?{c}(?:\\s[^\"'<>]*)?[\"'][^<>]*>(.*?)</\\1>", 2) for c in TITLE_CLASSES]
    found = [decoded(plain_text(f)) for f in [*found, F.regexp_extract(html, f"(?is){h1}", 1)]]
    return F.coalesce(*[F.when(F.length(t).between(6, 200) & (t != PLACEHOLDER_TITLE), t) for t in found])


def resolve(href: Column, base: Column) -> Column:
    """An absolute address of a link on a page: whole and scheme-less addresses, paths from the root or the folder with ./ and ../
    taken out, and links that are a query or a fragment alone."""
    h = F.trim(href)
    scheme, origin = F.regexp_extract(base, "^(https?):", 1), F.regexp_extract(base, "^(https?://[^/?#]*)", 1)
    path = F.coalesce(F.nullif(F.regexp_extract(base, "^https?://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
    folder, bare = F.regexp_extract(path, "^(.*/)", 1), F.regexp_extract(base, "^([^#]*)", 1)
    tail = F.regexp_extract(h, "^[^?#]*(.*)$", 1)
    parts = F.split(F.concat(folder, F.regexp_extract(h, "^([^?#]*)", 1)), "/")
    up = lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).when(p == ".", acc).otherwise(F.concat(acc, F.array(p)))
    kept = F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), up), "/")
    ends = h.rlike("(^|/)\\.\\.?([?#]|$)")
    joined = F.concat(origin, kept, F.when(ends, "/").otherwise(""), tail)
    return (
        F.when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, F.lit(":"), h)).when(h == "", bare).when(h.startswith("#"), F.concat(bare, h))
        .when(h.startswith("?"), F.concat(origin, path, h)).when(h.startswith("/"), F.concat(origin, h)).otherwise(joined)
    )


ANCHOR = '(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'


def link_list(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", filtered: bool = True) -> DataFrame:
    """key, place, title, href of a page's anchors with a link; ``filtered`` keeps article-like ones that are no noise."""
    found = pages.select(key, F.col(url).alias("_base"), F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR), 1).alias("h"), F.regexp_extract_all(html, F.lit(ANCHOR), 2).alias("t")).alias("_a"))
    rows = found.select(key, "_base", F.posexplode("_a").alias("place", "a")).select(key, "place", decoded(plain_text(F.col("a.t"))).alias("title"), F.col("a.h").alias("_h"), "_base")
    rows = rows.withColumn("href", resolve(F.col("_h"), F.col("_base")))
    if filtered:
        rows = rows.filter(~noise_link(F.col("title"), F.col("_h")) & article_like_url(F.col("href")))
    return rows.select(key, "place", "title", "href")


def published_at(html: Column, as_of: Column, url: Column | None = None) -> Column:
    """The publication time: meta tags in order, the time element, a date in the body, the _t parameter of the address; the first
    that is readable and lies from 2000 to a day ahead."""
    timed = F.regexp_extract(html, "(?is)<time\\b[^>]*>(.*?)</time>", 1)
    stamp = F.regexp_extract(html, "(?is)<time\\b[^>]*datetime=[\"']([^\"']*)", 1)
    body = F.regexp_extract(html, "(?is)<body\\b.*", 0)
    date = "(\\d{4})[-/.年](\\d{1,2})[-/.月](\\d{1,2})"
    text = html_text(F.when(body != "", body).otherwise(html))
    named = once(F.regexp_extract(text, date, 0), lambda d: F.concat_ws("-", *[F.lpad(F.regexp_extract(d, date, i), 4 if i == 1 else 2, "0") for i in (1, 2, 3)]))
    raw = [attribute(html, "meta", k, v, "content") for k, v in DATE_META] + [F.when(stamp != "", stamp).otherwise(F.trim(plain_text(timed))), named]
    times = [once(r, lambda x: F.try_to_timestamp(F.nullif(x, F.lit("")))) for r in raw]
    if url is not None:
        times.append(F.timestamp_seconds(F.nullif(F.regexp_extract(url, "[?&]_t=(\\d{1,11})(?:[&#]|$)", 1), F.lit("")).cast("long")))
    return F.coalesce(*[once(t, lambda x: F.when((x >= "2000-01-01") & (x <= as_of + F.expr("interval 1 day")), x)) for t in times])


LIST_DATE = "(\\d{4})[-/.年](\\d{1,2})[-/.月](\\d{1,2})日?(?:\\s*(\\d{1,2}):(\\d{2}))?"


def list_items(pages: DataFrame, as_of: Column, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, place, title, href, pub_date of the list items (li) of a list page that hold a link: its first anchor, and the date in
    the item's text, else the minute of ``as_of``."""
    rows = pages.select(key, F.col(url).alias("_base"), F.posexplode(F.regexp_extract_all(html, F.lit("(?is)<li\\b[^>]*>(.*?)(?=</li|<li\\b|</ul|</ol|$)"), 1)).alias("place", "_li"))
    at = [F.regexp_extract(html_text(F.col("_li")), LIST_DATE, i) for i in range(1, 6)]
    named = F.concat(F.concat_ws("-", *[F.lpad(a, 4 if i == 0 else 2, "0") for i, a in enumerate(at[:3])]), F.lit(" "), F.when(at[3] != "", F.concat(F.lpad(at[3], 2, "0"), F.lit(":"), at[4])).otherwise("00:00"))
    found = rows.select(
        key, "place", decoded(plain_text(F.regexp_extract("_li", ANCHOR, 2))).alias("title"), resolve(F.regexp_extract("_li", ANCHOR, 1), F.col("_base")).alias("href"),
        F.coalesce(F.try_to_timestamp(named), F.date_trunc("minute", as_of)).alias("pub_date"), (F.regexp_extract("_li", ANCHOR, 1) != "").alias("_linked"),
    )
    return found.filter("_linked").drop("_linked")


# How an element counts in a page.
NOISE = frozenset("script style noscript nav footer aside iframe header button template svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("p div section span".split())
CONTAINERS = re.compile(r"(^|[\s_-])(content|article|detail|post|entry|main|body)([\s_-]|$)", re.I)
BOILERPLATE = re.compile(r"(?i)share this|related articles|all rights reserved|advert|copyright|read more")
#: Attributes that hold an address, and the schemes that one may have; readers take control characters and white space out first.
ADDRESSES = frozenset("href src action formaction xlink:href background dynsrc lowsrc ping poster cite data usemap longdesc data-src".split())
SCHEMES = frozenset(("http", "https", "mailto"))
SCHEME = re.compile(r"([a-z][a-z0-9+.-]*):", re.I)
UNSEEN = re.compile(r"[\x00-\x20\x7f]+")
UNSAFE_STYLE = re.compile(r"(?i)expression\s*\(|url\s*\(\s*[\"']?\s*(javascript|vbscript|data):")
#: Elements that run or fetch things, taken out of a body with all that they hold.
DANGEROUS = frozenset("embed object svg math applet portal base meta link script style iframe".split())
# Words and names of what heads a body without being part of it, in order.
HEAD_WORDS = re.compile(r"登录|注册|退出|激活|电子版|购物车|经观智讯|智讯|Subscribe|subscribe|Login|login|Register|Sign\s*in|Cart|cart|会员|VIP")
HEAD_NAMES = re.compile(r"(nav|top-?bar|head-?nav|user-?nav|login-?bar|tool-?bar|member|func-?bar|subscription)", re.I)
#: Head children looked at, characters that make a real one, and those of a short one with links.
HEAD_CHILDREN, REAL_TEXT, SHORT_TEXT = 8, 80, 30
#: Sides of a picture, in pixels, below which it is decoration.
LEAST_SIDE = 100
DECORATION = re.compile(r"(?i)(logo|icon|avatar|blank|pixel)")


#: Up to so many characters an element's text is kept with it.
SHORT = 300


class Node:
    """An element. ``measure`` gives it, of all that it holds: length of the text with its white space collapsed, p, img, a (without
    itself), length of links' texts, whether a container is among it, and the text itself where that is short."""

    __slots__ = ("a", "attrs", "children", "contains", "img", "length", "linked", "p", "short", "spaced", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def elements(self) -> list[Node]:
        """The element and all below it, in order."""
        out, rest = [], [self]
        while rest:
            n = rest.pop()
            out.append(n)
            rest.extend(c for c in reversed(n.children) if isinstance(c, Node))
        return out

    def text(self) -> str:
        parts, rest = [], list(reversed(self.children))
        while rest:
            c = rest.pop()
            if isinstance(c, str):
                parts.append(c)
            else:
                parts.append(" ")
                rest.extend(reversed(c.children))
        return SPACES.sub(" ", "".join(parts)).strip()

    def measure(self) -> Node:
        """Set the sums of every element, each from those of its children."""
        for n in reversed(self.elements()):
            n.p = n.img = n.a = n.linked = n.length = 0
            n.contains = _is_container(n)
            parts: list[str] | None = []
            before = after = False  # white space at the ends
            for c in n.children:
                if isinstance(c, str):
                    core = SPACES.sub(" ", c)
                    lead, trail, own = core.startswith(" "), core.endswith(" "), core.strip()
                    size, short = len(own), own if len(own) <= SHORT else None
                else:
                    n.p += c.p + (c.tag == "p")
                    n.img += c.img + (c.tag == "img")
                    n.a += c.a + (c.tag == "a")
                    n.linked += c.linked
                    n.contains |= c.contains
                    lead, trail, size, short = True, c.spaced[1], c.length, c.short
                if size:
                    gap = bool(n.length) and (after or lead)
                    before = before if n.length else before or lead
                    n.length += size + gap
                    after = trail
                    parts = parts + [" "] * gap + [short] if parts is not None and short is not None and n.length <= SHORT else None
                elif lead or trail:
                    before, after = before or not n.length, True
            n.spaced = before, after
            n.short = "".join(parts) if parts is not None else None
            n.linked += n.length if n.tag == "a" else 0
        return self

    def drop(self, bad) -> Node:
        """Take out the elements below that ``bad`` holds for, those above first."""
        rest = [self]
        while rest:
            n = rest.pop()
            n.children = [c for c in n.children if isinstance(c, str) or not bad(c)]
            rest.extend(c for c in n.children if isinstance(c, Node))
        return self


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.open, self.counts = [self.root], {}

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag == "p" and self.open[-1].tag == "p":
            self.handle_endtag("p")
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_endtag(self, tag):
        while self.counts.get(tag):
            closed = self.open.pop().tag
            self.counts[closed] -= 1
            if closed == tag:
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree_of(page: str | None) -> Node:
    """The tree of a page, whatever its depth; end tags of what is not open are passed over."""
    tree = _Tree()
    tree.feed(page or "")
    tree.close()
    return tree.root


def _is_container(n: Node) -> bool:
    return n.tag in ("article", "main") or bool(CONTAINERS.search(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"))


def _dense(n: Node) -> bool:
    return n.length >= 30 and n.a >= 5 and n.linked / n.length > 0.6


def safe_address(value: str) -> bool:
    """Whether an address is relative or of a scheme that may stay."""
    m = SCHEME.match(UNSEEN.sub("", value))
    return m is None or m[1].lower() in SCHEMES


def absolute(base: str, address: str) -> str:
    """The address on a page at ``base``; empty if it can't be read or isn't safe."""
    try:
        found = urljoin(base, address.strip())
    except ValueError:
        return ""
    return found if safe_address(found) else ""


def _kept(key: str, value: str) -> bool:
    if key.startswith("on") or key == "srcdoc" or (key == "style" and UNSAFE_STYLE.search(value)):
        return False
    if key in ADDRESSES:
        return safe_address(value)
    return key != "srcset" or all(safe_address(x) for x in value.split(","))


def _markup(nodes: list[Node | str], base: str) -> str:
    out: list[str] = []
    rest: list[Node | str | tuple[str]] = list(reversed(nodes))
    while rest:
        n = rest.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif isinstance(n, str):
            out.append(escape(n, quote=False))
        else:
            attrs = {k: v for k, v in n.attrs.items() if _kept(k, v)}
            if n.tag == "img":
                attrs["src"] = absolute(base, attrs.get("data-src") or attrs.get("src", ""))
            out.append(f"<{n.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in attrs.items()) + ">")
            if n.tag not in VOID:
                rest.append((f"</{n.tag}>",))
                rest.extend(reversed(n.children))
    return "".join(out)


def _strip_head(box: Node) -> None:
    """Take menus, log-in lines and empty elements off the head of a body, up to the first real child."""
    gone = 0
    for child in [c for c in box.children if isinstance(c, Node)]:
        if gone >= HEAD_CHILDREN or child.length > REAL_TEXT or child.tag == "img" or child.img:
            return
        text, name = child.text(), f"{child.attrs.get('class', '')} {child.attrs.get('id', '')}"
        linked = child.a + (child.tag == "a")
        if not (HEAD_WORDS.search(text) or HEAD_WORDS.search(name) or HEAD_NAMES.search(name) or (len(text) < SHORT_TEXT and linked) or not text):
            return
        box.children.remove(child)
        gone += 1


def _small(n: Node) -> bool:
    """Whether a picture says that one of its sides is too short."""
    return any(v.isdigit() and int(v) < LEAST_SIDE for v in (n.attrs.get(side, "").strip().removesuffix("px") for side in ("width", "height")))


def _noise(n: Node) -> bool:
    """What is no part of a body: a form counts where no container is in it."""
    return n.tag in NOISE or (n.tag == "form" and not n.contains) or re.search(r"(^|\s)(ad|ads|advert)(\s|$)", n.attrs.get("class", "")) is not None


def body_of(page: str | None, base: str | None) -> tuple[str, str | None, str]:
    """(markup, cover image, text) of the article of one page; empty if it has under 100 characters and no image.

    Every step is one pass over the tree. Addresses that can't be read or have another scheme than http, https and mailto
    go, as do attributes that run scripts."""
    root, base = tree_of(page).measure().drop(_noise).measure(), base or ""
    ranked = [(n.length + 120 * n.p + 80 * n.img - 2 * n.linked, -i, n) for i, n in enumerate(root.elements()) if n.length > 80 and _is_container(n)]
    if ranked:
        box = max(ranked, key=lambda x: x[:2])[2]
    else:
        box = Node("div", {})
        box.children = [n for n in root.elements() if n.tag in ("p", "figure") and (n.length > 20 or n.img)]
    box.drop(lambda n: n.tag in DANGEROUS).measure()
    _strip_head(box)
    box.drop(_dense).measure()
    box.drop(lambda n: n.tag in BLOCKS and 0 < n.length < SHORT and BOILERPLATE.search(n.short) is not None).measure()
    images = [absolute(base, n.attrs.get("data-src") or n.attrs.get("src", "")) for n in box.elements() if n.tag == "img" and not _small(n)]
    images = [i for i in images if i and not DECORATION.search(i)]
    if box.length < 100 and not images:
        return "", None, ""
    return _markup(box.children, base), images[0] if images else None, box.text()


@F.pandas_udf(T.StructType([T.StructField("html", T.StringType()), T.StructField("cover", T.StringType()), T.StructField("text", T.StringType())]))
def extract_body(page: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([body_of(p, b) for p, b in zip(page, base, strict=True)], columns=["html", "cover", "text"])


def html_response(content_type: Column) -> Column:
    """Whether an answer of this content type is a page; none given counts as one."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (kind == "") | (~kind.rlike("application/(pdf|octet-stream)|^(image|video)/") & kind.rlike("text/|html|xml"))


def article_page(pages: DataFrame, as_of: Column, url: str = "url", html: str = "html", content_type: str | None = None) -> DataFrame:
    """``pages`` with title, body (html, cover, text), excerpt, published and summary_only. What is no page, or begins as a PDF, has
    none of them; a page under 50 characters of body has its description in place of a text."""
    page = F.col(html)
    readable = ~F.coalesce(page, F.lit("")).startswith("%PDF") & page.isNotNull()
    if content_type is not None:
        readable = readable & html_response(F.col(content_type))
    rows = pages.withColumns({"_ok": readable, "body": extract_body(F.col(html), F.col(url))})
    short = F.length("body.html") < 50
    text = F.when(short, meta_description(page)).otherwise(F.col("body.text"))
    parts = {"title": page_title(page), "text": text, "excerpt": build_excerpt(text), "published": published_at(page, as_of, F.col(url)), "summary_only": short & text.isNotNull(), "tier": content_tier(text, F.col("body.html"))}
    return rows.withColumns({k: F.when(F.col("_ok"), v) for k, v in parts.items()}).drop("_ok")


@F.pandas_udf(T.StringType())
def decode_html(raw: pd.Series, content_type: pd.Series) -> pd.Series:
    """Bytes as text: the charset of the header, else of a meta tag in the first 4096 bytes, else UTF-8."""

    def one(b: bytes | None, kind: str | None) -> str | None:
        if b is None:
            return None
        m = re.search(r"(?i)charset=[\"']?([\w-]+)", kind or "") or re.search(r"(?i)charset=[\"']?([\w-]+)", bytes(b[:4096]).decode("latin-1"))
        name = (m[1] if m else "utf-8").lower()
        name = "gb18030" if name in ("gb2312", "gbk", "gb18030") else name
        try:
            return bytes(b).decode(name, "replace")
        except LookupError:
            return bytes(b).decode("utf-8", "replace")

    return pd.Series([one(b, k) for b, k in zip(raw, content_type, strict=True)])
