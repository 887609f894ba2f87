"""Text functions over columns. All stay in the JVM; thresholds are inclusive unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.lexicon import Lexicon

#: White space as browsers' languages see it (wider than Java's class), and sentence ends.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ENDS = ".!?。！？"
#: A mark that no text holds, to split after a match without lookbehind.
CUT = "\x01"

FULL, FULL_SHORT, FULL_HTML, SUMMARY = 300, 150, 300, 80


def plain_text(c: Column) -> Column:
    """Tags become spaces, white space is collapsed; null becomes ''."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " "), f"[{SPACES}]+", " "))


def sentences(text: Column) -> Column:
    """Parts of a text, each with its end mark; blanks around them are kept."""
    return F.split(F.regexp_replace(text, f"([{ENDS}])", f"$1{CUT}"), CUT)


def paragraphs(html: Column, text: Column) -> Column:
    """Opening p tags; without one, sentences of at least 30 characters."""
    tags = F.regexp_count(F.coalesce(html, F.lit("")), F.lit(f"(?i)<p[{SPACES}>]"))
    long_ones = F.size(F.filter(sentences(text), lambda s: F.length(F.trim(s)) >= 30))
    return F.when(tags > 0, tags).otherwise(long_ones)


def content_tier(content: Column, html: Column) -> Column:
    text = plain_text(content)
    page = F.coalesce(html, F.lit(""))
    rich = (F.length(text) >= FULL_SHORT) & (F.length(page) >= FULL_HTML) & (paragraphs(page, text) >= 1)
    return F.when((F.length(text) >= FULL) | rich, "full").when(F.length(text) >= SUMMARY, "summary").otherwise("external")


def content_quality(content: Column, html: Column) -> Column:
    text = plain_text(content)
    page = F.coalesce(html, F.lit(""))
    return F.struct(
        content_tier(content, html).alias("tier"), F.length(text).alias("text_length"), F.length(page).alias("html_length"), paragraphs(page, text).alias("paragraph_count")
    )


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | text.contains(w), words, F.lit(False))


def count_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a + text.contains(w).cast("int"), words, F.lit(0))


def keyword_score(text: Column, lex: Lexicon) -> Column:
    """Two for each strong word that the text holds, one for each weak one."""
    return count_of(text, lex.strong) * 2 + count_of(text, lex.weak)


def topic_match(text: Column, lex: Lexicon) -> Column:
    return reduce(lambda a, p: a | (text.rlike(p[0]) & text.rlike(p[1])), lex.pairs, any_of(text, lex.core))


def candidate_match(text: Column, lex: Lexicon) -> Column:
    return topic_match(text, lex) | any_of(text, lex.candidate)


def malformed_title(title: Column) -> Column:
    return title.isNull() | (F.trim(title) == "") | title.contains("�") | title.rlike("\\?{3}")


def exclusion_reason(title: Column, url: Column, lex: Lexicon) -> Column:
    """The first rule that excludes an item, or null."""
    link = F.coalesce(url, F.lit(""))
    return (
        F.when(malformed_title(title), "malformed_title")
        .when(title.rlike(lex.site_noise) | title.rlike(lex.noise_title), "site_noise")
        .when(title.rlike(lex.training_title), "training")
        .when(link.rlike(lex.training_url), "training_url")
    )


def relevance(title: Column, content: Column, source_id: Column, url: Column, lex: Lexicon, judge: Column | None = None) -> Column:
    """struct(relevant, method, score, reason) by ordered rules; ``judge`` is an outside verdict for what is left open."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
    excluded, listed = exclusion_reason(title, url, lex), F.coalesce(source_id.isin(*lex.whitelist), F.lit(False))
    core, candidate, score = topic_match(text, lex), candidate_match(text, lex), keyword_score(text, lex)

    def row(relevant: bool | Column, method: str | Column, points: int | Column, reason: str | Column | None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(relevant).cast("boolean").alias("relevant"), lit(method).cast("string").alias("method"), lit(points).cast("int").alias("score"), lit(reason).cast("string").alias("reason"))

    open_ = row(False, "skipped", score, None) if judge is None else row(F.coalesce(judge, F.lit(False)), "judge", score, F.when(judge.isNull(), "no verdict"))
    return (
        F.when(excluded.isNotNull(), row(False, "skipped", 0, excluded))
        .when(listed & core, row(True, "keyword", 2, None))
        .when(listed, row(False, "skipped", 0, None))
        .when(~candidate, row(False, "skipped", 0, "off topic"))
        .when(~core, row(False, "skipped", 1, None))
        .when(score >= 2, row(True, "keyword", score, None))
        .otherwise(open_)
    )


def keyword_filter(title: Column, text: Column, source_id: Column, url: Column, lex: Lexicon) -> Column:
    """True passes, false drops, null is undecided."""
    whole = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    return (
        F.when(exclusion_reason(title, url, lex).isNotNull(), F.lit(False))
        .when(F.coalesce(source_id.isin(*lex.whitelist), F.lit(False)), F.lit(None).cast("boolean"))
        .when(~candidate_match(whole, lex), F.lit(False))
        .when(topic_match(whole, lex), F.lit(True))
    )


def pre_filter(verdict: Column, title: Column, text: Column, url: Column, lex: Lexicon) -> Column:
    """A verdict where there is one; else an item passes if it is on topic and not excluded."""
    whole = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    return F.coalesce(verdict, exclusion_reason(title, url, lex).isNull() & topic_match(whole, lex))


def is_regional(title: Column, lex: Lexicon) -> Column:
    starts = reduce(lambda a, p: a | title.startswith(f"{p}：") | title.startswith(f"{p}:") | title.startswith(f"{p} "), lex.regional, F.lit(False))
    return starts | (any_of(title, lex.regional) & title.rlike(lex.regional_scope))


def classify(title: Column, content: Column, lex: Lexicon) -> Column:
    """struct(section, confidence, reason, sub_section) by ordered rules."""
    t = F.coalesce(title, F.lit(""))
    text = F.concat_ws(" ", t, F.coalesce(content, F.lit("")))
    disputes, fronts, trade = count_of(text, lex.dispute), count_of(text, lex.frontier), count_of(text, lex.industry)

    def row(section: str, confidence, reason, sub: Column | None = None) -> Column:
        c = confidence if isinstance(confidence, Column) else F.lit(confidence)
        r = reason if isinstance(reason, Column) else F.lit(reason)
        return F.struct(F.lit(section).alias("section"), c.cast("double").alias("confidence"), r.alias("reason"), (F.lit(None) if sub is None else sub).cast("string").alias("sub_section"))

    return (
        F.when(t.rlike(lex.noise_title), row("regulatory", 0.0, "noise"))
        .when(disputes >= 2, row("dispute", F.least(disputes * 0.3, F.lit(1.0)), "dispute words"))
        .when(any_of(t, lex.dispute_titles), row("dispute", 0.8, "dispute title"))
        .when(any_of(t, lex.risk_titles), row("dispute", 0.7, "risk title"))
        .when(any_of(t, lex.normative) & (t.rlike(lex.formal) | t.rlike("《.*》")), row("normative", 0.9, "formal document"))
        .when(fronts >= 2, row("frontier", F.least(fronts * 0.4, F.lit(1.0)), "frontier words"))
        .when(trade >= 2, row("industry_model", F.least(trade * 0.35, F.lit(1.0)), "industry words"))
        .when(is_regional(t, lex), row("regulatory", 0.7, "regional", F.lit("regional")))
        .otherwise(row("regulatory", 0.5, F.when(any_of(t, lex.national), "national").otherwise("other"), F.when(any_of(t, lex.national), F.lit("national"))))
    )


def topic_area(title: Column, content: Column, lex: Lexicon) -> Column:
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
    return F.coalesce(*[F.when(text.rlike(p), name) for name, p in lex.areas])


DATE = "\\d{4}[-/.年]\\d{1,2}[-/.月]\\d{1,2}日?( ?\\d{1,2}:\\d{2}(:\\d{2})?)?"
PUNCTUATION = f"[{SPACES}\\p{{P}}\\p{{S}}]+"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def normalize_title(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), DATE, ""), PUNCTUATION, "")


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; fewer than two characters have none."""
    n = F.length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, 2)))).otherwise(F.array().cast("array<string>"))


def title_similarity(a: Column, b: Column) -> Column:
    x, y = bigrams(normalize_title(a)), bigrams(normalize_title(b))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / (F.size(x) + F.size(y) - both))


def build_excerpt(text: Column, limit: int = 300, least: int = 100) -> Column:
    """The first ``limit`` characters, cut after the last sentence end if that lies beyond ``least``."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_extract(head, f"(?s)^(.*[{ENDS}])", 1)
    return F.when(F.length(cut) - 1 > least, cut).otherwise(head)


def sentence_excerpt(text: Column) -> Column:
    """Sentences of 3 or more characters until there are two with 40 characters, or 300; none: the first 200 characters."""
    parts = F.filter(F.transform(sentences(text), lambda s: F.trim(s)), lambda s: F.length(s) >= 3)
    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def add(acc: Column, s: Column) -> Column:
        grown, n = F.concat(acc["text"], s), acc["n"] + 1
        done = ((n >= 2) & (F.length(grown) >= 40)) | (F.length(grown) >= 300)
        return F.when(acc["done"], acc).otherwise(F.struct(grown.alias("text"), n.alias("n"), done.alias("done")))

    found = F.aggregate(parts, empty, add)["text"]
    return F.when(found == "", F.substring(text, 1, 200)).otherwise(found)


def cap_at_sentence(text: Column, most: int, share: float = 0.5) -> Column:
    """At most ``most`` characters, cut after the last sentence end if that lies beyond ``share`` of them."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, f"(?s)^(.*[{ENDS}])", 1)
    return F.when(F.length(text) <= most, text).when(F.length(cut) > most * share, cut).otherwise(head)


def truncate_text(text: Column, most: int = 5000) -> Column:
    """Longer texts are cut after the last sentence end in reach, if there is one."""
    return cap_at_sentence(text, most, 0.0)


def is_dirty(text: Column, lex: Lexicon) -> Column:
    head = F.substring(F.coalesce(text, F.lit("")), 1, 200)
    return head.startswith("%PDF") | head.rlike(lex.site_noise)


def repair_title(stored: Column, fetched: Column) -> Column:
    stem = F.regexp_replace(stored, "(\\.\\.\\.|…)$", "")
    return F.when(stored.rlike("(\\.\\.\\.|…)$") & (F.length(fetched) > F.length(stem)), fetched).otherwise(stored)


def reason_allows(reason: Column, lex: Lexicon) -> Column:
    return ~F.coalesce(reason.rlike(lex.reject_reason), F.lit(False))


def etag(body: Column) -> Column:
    """The 31-multiplier rolling hash of the text as unsigned hex, in quotes."""
    codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    rolled = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.concat(F.lit('"'), F.lower(F.hex(rolled)), F.lit('"'))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def encode_cursor(ts: Column, key: Column) -> Column:
    """base64url of "time|key" without padding."""
    raw = F.concat_ws("|", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), key.cast("string"))
    return F.regexp_replace(F.translate(F.base64(raw.cast("binary")), "+/", "-_"), "=+$", "")


def beijing_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Shanghai"))


def sanitize_ts(text: Column, as_of: Column) -> Column:
    """A time that is no more than an hour ahead and 180 days back; else null."""
    ts = F.try_to_timestamp(text)
    return F.when((ts <= as_of + F.expr("interval 1 hour")) & (ts >= as_of - F.expr("interval 180 days")), ts)
