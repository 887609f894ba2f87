"""Predicates over links and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listed_article_url(url: Column, host: str, path: str = "/s") -> Column:
    """https, exactly this host, and the path itself or below it."""
    parts = [F.try_parse_url(url, F.lit(p)) for p in ("PROTOCOL", "HOST", "PATH")]
    return F.coalesce((parts[0] == "https") & (parts[1] == host) & ((parts[2] == path) | parts[2].startswith(f"{path}/")), F.lit(False))


def article_like_url(url: Column) -> Column:
    """No bare folder, and three path segments, a date or an article word."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    folder = path.endswith("/") & ~path.rlike("\\d{4}")
    deep = F.size(F.filter(F.split(path, "/"), lambda s: s != "")) >= 3
    return ~folder & (deep | path.rlike("\\d{4}[-/]?\\d{2}") | path.rlike("(?i)(article|detail|content|news)"))


def noise_link(title: Column, href: Column) -> Column:
    text, link = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(href, F.lit("")))
    return (F.length(text) < 6) | (F.length(text) > 200) | (link == "") | link.startswith("#") | link.rlike("(?i)^(javascript|mailto|tel):")


def private_host(host: Column) -> Column:
    """Loopback, private and link-local names and addresses."""
    h = F.lower(F.coalesce(host, F.lit("")))
    octets = F.split(h, "\\.")
    second = F.try_to_number(F.try_element_at(octets, F.lit(2)), F.lit("999")).cast("int")
    ip = h.rlike("^\\d{1,3}(\\.\\d{1,3}){3}$")
    private = h.rlike("^(10|127|0)\\.") | h.rlike("^192\\.168\\.") | h.rlike("^169\\.254\\.") | (h.rlike("^172\\.") & second.between(16, 31))
    return (h == "") | (h == "localhost") | h.endswith(".localhost") | h.endswith(".local") | h.rlike("^\\[?(::1|f[cd][0-9a-f]{2}:|fe80:)") | (ip & private)
