import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions.lexicon import SAMPLE as LEX
from tessera.operators import listing, selection


@pytest.fixture(scope="module")
def value(spark):
    def run(column, **cells):
        df = spark.range(1).select(*[(F.lit(v) if v is not None else F.lit(None).cast("string")).alias(k) for k, v in cells.items()])
        return df.select(column.alias("v")).first().v

    return run


c = F.col


@pytest.mark.parametrize("raw, want", [(None, ""), ("", ""), ("<p>a</p> b", "a b"), ("a 　 b\t", "a b"), ("漢<b>字</b>", "漢 字")])
def test_plain_text(value, raw, want):
    assert value(T.plain_text(c("x")), x=raw) == want


@pytest.mark.parametrize("content, html, want", [("a" * 79, None, "external"), ("a" * 80, None, "summary"), ("a" * 299, None, "summary"), ("a" * 300, None, "full"), ("a" * 150, "<p>" + "b" * 297, "full"), ("a" * 150, "b" * 300, "full"), ("a. " * 51, "b" * 300, "summary"), ("a" * 149, "<p>" + "b" * 400, "summary"), (None, None, "external")])
def test_content_tier(value, content, html, want):
    # without a p tag, a sentence of 30 characters counts as a paragraph
    assert value(T.content_tier(c("x"), c("h")), x=content, h=html) == want


def test_bigrams_of_short_titles(value):
    assert value(T.bigrams(c("x")), x="") == [] and value(T.bigrams(c("x")), x="a") == []
    assert value(T.bigrams(c("x")), x="aba") == ["ab", "ba"]


def test_title_similarity_without_dates_and_marks(value):
    assert value(T.title_similarity(c("a"), c("b")), a="2024-01-02 12:30 Big news!", b="Big, news (2023/5/6)") == 1.0
    assert value(T.title_similarity(c("a"), c("b")), a=None, b="Big") == 0.0
    assert value(T.title_similarity(c("a"), c("b")), a="漢字新聞", b="漢字新") == pytest.approx(2 / 3)


def test_excerpts(value):
    assert value(T.build_excerpt(c("x")), x="a" * 100 + "." + "b" * 300) == "a" * 100 + "." + "b" * 199
    assert value(T.build_excerpt(c("x")), x="a" * 101 + "." + "b" * 300) == "a" * 101 + "."
    assert value(T.sentence_excerpt(c("x")), x="Hi. " + "a" * 30 + ". " + "b" * 20 + ". rest.") == "Hi." + "a" * 30 + "." + "b" * 20 + "."
    assert value(T.sentence_excerpt(c("x")), x="") == ""
    assert value(T.cap_at_sentence(c("x"), 10), x="abcd. efghijk") == "abcd. efgh"
    assert value(T.cap_at_sentence(c("x"), 10), x="abcdef. hijk") == "abcdef."


def test_etag_is_the_rolling_hash(value):
    assert value(T.etag(c("x")), x="abc") == '"17862"'
    assert value(T.etag(c("x")), x="") == '"0"'


def test_xml_escape(value):
    assert value(T.xml_escape(c("x")), x="<a&'\">") == "&lt;a&amp;&apos;&quot;&gt;"


def test_exclusion_order(value):
    assert value(T.exclusion_reason(c("t"), c("u"), LEX), t=None, u=None) == "malformed_title"
    assert value(T.exclusion_reason(c("t"), c("u"), LEX), t="what??? training course", u=None) == "malformed_title"
    assert value(T.exclusion_reason(c("t"), c("u"), LEX), t="training course", u=None) == "training"
    assert value(T.exclusion_reason(c("t"), c("u"), LEX), t="fine title", u="https://x/courses/1") == "training_url"
    assert value(T.exclusion_reason(c("t"), c("u"), LEX), t="fine title", u="https://x/1") is None


def decide(value, pre=True, method="llm", score=8.0, tier="full", reason=None):
    d = selection.decide_selection(c("p"), c("m"), c("s").cast("double"), c("t"), c("r"), LEX)
    return value(d["status"], p=pre, m=method, s=score, t=tier, r=reason)


def test_selection_rules(value):
    assert decide(value) == "selected"
    assert decide(value, pre=False) == "rejected" and decide(value, pre=None) == "rejected"
    assert decide(value, method="rule") == "pending" and decide(value, method=None) == "pending"
    assert decide(value, tier="summary") == "pending" and decide(value, reason="a promotion") == "pending"
    assert decide(value, score=7.0) == "rejected" and decide(value, score=None) == "rejected"
    assert decide(value, score=float("nan")) == "pending"


@pytest.mark.parametrize("payload, want", [('{"score": 50}', (50.0, 10)), ('```json\n{"score": 52, "dispute": 99}\n```', (52.0, 20)), ('so {"data": {"score": 50}} ok', (50.0, 10)), ('{"score": 101}', None), ("none", None), (None, None)])
def test_score_payloads(value, payload, want):
    got = value(selection.parse_scores(c("x")), x=payload)
    assert (got and (got.score, got.dispute)) == want


@pytest.mark.parametrize("url, want", [("https://a.org/s", True), ("https://a.org/s/x?y", True), ("https://a.org/sx", False), ("http://a.org/s", False), ("https://b.org/s", False), (None, False), ("nonsense", False)])
def test_listed_url(value, url, want):
    assert value(U.listed_article_url(c("x"), "a.org"), x=url) is want


@pytest.mark.parametrize("host, want", [("10.0.0.1", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.1.1", True), ("8.8.8.8", False), ("localhost", True), ("example.org", False), (None, True)])
def test_private_hosts(value, host, want):
    assert value(U.private_host(c("x")), x=host) is want


def test_cursor_round_trip(spark):
    ts = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    raw = spark.range(1).select(T.encode_cursor(F.lit(ts), F.lit(77)).alias("c")).first().c
    assert "=" not in raw and listing.decode_cursor(raw) == (ts, 77)
    assert listing.decode_cursor("%%%") is None and listing.decode_cursor("abcd") is None


def test_parameters():
    assert [listing.clamp(v, 1, 50, 20) for v in ("7", "900", "-3", "x", None)] == [7, 50, 1, 20, 20]
    assert listing.clean_search(" a,b%(c)_d ") == "a b  c _d"


def test_keyset_pages_cover_every_row_once_with_equal_times(spark):
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, ts if i < 8 else ts + dt.timedelta(days=1), "t", "frontier") for i in range(12)], "id long, pub_date timestamp, title string, category string")
    seen, cursor = [], None
    while True:
        page = sorted(listing.items(df, take=5, cursor=cursor).collect(), key=lambda r: r.place)
        seen += [r.id for r in page]
        if not page or not page[-1].has_more:
            break
        cursor = (page[-1].pub_date, page[-1].id)
    assert seen == [11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0]
