"""Bodies against plain sums over subtrees, and pages that are broken, deep or hostile."""

import random
import time

from tessera.sources import html as H


def plain(n):
    """The measures of an element, by a walk of its subtree."""
    below = n.elements()[1:]
    text = n.text()
    linked = sum(len(x.text()) for x in [n, *below] if x.tag == "a")
    return len(text), sum(x.tag == "p" for x in below), sum(x.tag == "img" for x in below), sum(x.tag == "a" for x in below), linked, any(H._is_container(x) for x in [n, *below])


def test_sums_equal_walks_of_subtrees():
    rng = random.Random(8)

    def part(depth=0):
        out = ""
        for _ in range(rng.randrange(0, 5)):
            kind = rng.choice(["text", "text", "space", "p", "a", "div", "img", "span", "article"])
            if kind == "text":
                out += rng.choice(["word", " word", "word ", "two  words", "\n x \n", "é" * rng.randrange(1, 200)])
            elif kind == "space":
                out += rng.choice([" ", "\n", "  "])
            elif kind == "img":
                out += "<img src=x>"
            else:
                out += f"<{kind}>{part(depth + 1) if depth < 6 else ''}</{kind}>"
        return out

    seen = 0
    for _ in range(300):
        for n in H.tree_of(part()).measure().elements():
            assert (n.length, n.p, n.img, n.a, n.linked, n.contains) == plain(n)
            if n.short is not None:
                assert n.short == n.text()
                seen += 1
            else:
                assert n.length > H.SHORT
    assert seen > 1000


STORY = "<p>" + "A sentence of a story that is long enough. " * 6 + "</p>"


def test_addresses_that_cannot_be_read_and_hidden_schemes_go():
    page = f"""<article>{STORY}<img src="http://[bad"><img src="ok.jpg"><a href="java
script:alert(1)">x</a><a href="\x01javascript:alert(1)">y</a><a href="vbscript:x">z</a><a href=" https://x.org/a">w</a><a href="mailto:a@b.c">m</a><a href="rel/a:b">r</a>
<img srcset="a.png 1x, data:x 2x" src="data:image/png;base64,AA"><button formaction="javascript:1">b</button><p srcdoc="<script>" onclick="x()" style="width:expression(1)" title="javascript: a word">t</p></article>"""
    markup, cover, _ = H.body_of(page, "https://x.org/d/e")
    assert cover == "https://x.org/d/ok.jpg"
    for bad in ("script:alert", "vbscript", "srcdoc", "onclick", "expression", "data:", "[bad", "formaction"):
        assert bad not in markup, bad
    for good in ('href=" https://x.org/a"', 'href="mailto:a@b.c"', 'href="rel/a:b"', 'title="javascript: a word"'):
        assert good in markup, good


def test_a_form_around_an_article_stays_and_other_forms_go():
    assert "sentence" in H.body_of(f"<form id=f><div><article>{STORY}</article></div></form>", None)[2]
    assert "Search here" not in H.body_of(f"<article>{STORY}<form>Search here</form></article>", None)[2]


def test_deep_wide_and_broken_pages_take_one_pass():
    began = time.time()
    wide = '<div class="content">' * 150 + STORY * 4_000 + "</div>" * 150
    assert H.body_of(wide, None)[2].count("A sentence") == 24_000
    deep = "<div>" * 30_000 + f"<article>{STORY}</article>"
    assert H.body_of(deep, None)[2].count("A sentence") == 6
    assert H.body_of("<div><b>" + "</i>" * 50_000 + f"<article>{STORY}</article>", None)[2].count("A sentence") == 6
    assert H.body_of("".join(f"<div class=content><span>{k}</span>" for k in range(5_000)) + STORY, None)[2]
    assert time.time() - began < 20


def test_title_of_many_articles_is_quick(spark):
    pages = ["<article " * 10_000, "<article><p>x</p></article><h1>A heading outside</h1>", "<ARTICLE class=x><h1>The heading <b>inside</b></h1></ARTICLE>", "<h1>First heading</h1><article><h1>Second heading</h1></article>", "no tags", None]
    began = time.time()
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
    assert [r.t for r in df.select("id", H.page_title(df.html).alias("t")).orderBy("id").collect()] == [None, "A heading outside", "The heading inside", "Second heading", None, None]
    assert time.time() - began < 30
