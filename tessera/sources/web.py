"""Sources as plug-ins: a registry of them, what is to be requested of each, answers as a data source, bodies by host.

The registry is a table. ``list_requests`` and ``body_requests`` say in column functions what to ask for; ``Answers`` is a
data source for ``spark.read`` that asks, a partition for each source, and gives a row for each answer, failed ones too; saved
answers are a table of the same columns. What an answer holds is read by column functions again.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.operators import sinks

# The fields of the registry, the pages of a list and the parameters that name them.
FIELDS = "id string, name string, url string, type string, category string, priority string, weight double, rss string, selector string, active boolean"
PAGES, PAGE_PARAMETERS = 4, ("page", "pageNo")
ANSWER = "source_id string, number int, url string, status int, content_type string, body binary, error string"


def registry(config: DataFrame, column: str = "value") -> DataFrame:
    """The sources of JSON texts with a list ``sources``; an empty feed or selector is none, of a repeated id the last counts."""
    read = config.select(F.from_json(column, f"sources array<struct<{FIELDS.replace(' ', ': ')}>>".replace(",: ", ", ")).alias("c"))
    rows = read.select(F.posexplode("c.sources").alias("n", "s")).groupBy("s.id").agg(F.max_by("s", "n").alias("s")).select("s.*")
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("rss", "selector")}).filter("id IS NOT NULL")


def upsert_registry(held: DataFrame, config: DataFrame, column: str = "value") -> DataFrame:
    """The registry after a configuration is loaded: its sources replace those of the same id, all others stay."""
    return sinks.upsert(held, registry(config, column), ["id"])


def list_requests(sources: DataFrame) -> DataFrame:
    """source_id, number, url: of an active source its feed, else its list page and, by either parameter, the pages after it."""
    feed = F.nullif(F.trim("rss"), F.lit(""))
    joiner = F.when(F.col("url").contains("?"), "&").otherwise("?")
    more = [F.concat("url", joiner, F.lit(f"{p}={n}")) for n in range(2, PAGES + 1) for p in PAGE_PARAMETERS]
    urls = F.when(feed.isNotNull(), F.array(feed)).otherwise(F.array("url", *more))
    rows = sources.filter("active").select(F.col("id").alias("source_id"), F.posexplode(urls).alias("number", "url"))
    return rows.filter(F.coalesce("url", F.lit("")) != "")


@dataclass(frozen=True)
class BodyAdapter:
    """How the body of a host's articles is asked for: what of the address goes into the request, and where the answer holds it.

    ``parts`` are query parameters, or patterns of the path with one group; ``{name}`` in endpoint and post stands for them."""

    name: str
    hosts: tuple[str, ...]
    endpoint: str
    path: str
    parts: dict[str, str] = field(default_factory=dict)
    suffix: bool = False
    post: str | None = None
    ok: tuple[str, str] | None = None

    def serves(self, url: Column) -> Column:
        host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
        if not self.suffix:
            return host.isin(*self.hosts)
        return F.greatest(*[host.endswith(h) for h in (*self.hosts, self.hosts[0])])

    def _filled(self, template: str, url: Column) -> Column:
        out = F.lit(template)
        for name, where in self.parts.items():
            raw = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), where, 1) if "(" in where else F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(where)))
            out = F.replace(out, F.lit(f"{{{name}}}"), F.nullif(raw, F.lit("")))  # null where a part is missing
        return out

    def request(self, url: Column) -> Column:
        """(name, endpoint, post), or null if a part is missing."""
        endpoint = self._filled(self.endpoint, url)
        post = F.lit(None).cast("string") if self.post is None else self._filled(self.post, url)
        asks = F.struct(F.lit(self.name).alias("adapter"), endpoint.alias("endpoint"), post.alias("post"))
        return F.when(endpoint.isNotNull() & (post.isNotNull() if self.post is not None else F.lit(True)), asks)

    def body(self, status: Column, answer: Column) -> Column:
        """The body that an answer holds, or null."""
        good = status.between(200, 299) & (F.get_json_object(answer, self.ok[0]) == self.ok[1] if self.ok else F.lit(True))
        return F.when(F.coalesce(good, F.lit(False)), F.nullif(F.get_json_object(answer, self.path), F.lit("")))


# Hosts whose article pages are empty shells, and where their scripts get the bodies.
_SHELL = "https://s143js.nicebox.cn/sysTools.php?mod=viewsConn&rtype=json&idweb={site}&viewid=newsDetail_style_01_{view}&name=newsDetail&style=style_01&langid=0&pageid={page}&viewCtrl=newsDetail&isfb=1&newsid={{newsid}}"
BODY_ADAPTERS = (
    BodyAdapter("dahecube", ("dahecube.com",), "https://app.dahecube.com/napi/news/pc/artinfo", "$.data.content", {"artid": "artid"}, suffix=True, post='{"artid":"{artid}"}', ok=("$.code", "0")),
    BodyAdapter("szsyblxh", ("www.szsyblxh.org.cn", "szsyblxh.org.cn"), _SHELL.format(site="58963", view="1746604478645", page="875615"), "$.html", {"newsid": "newsid"}),
    BodyAdapter("syblxh", ("www.syblxh.org.cn", "syblxh.org.cn"), _SHELL.format(site="63623", view="1506318095542", page="{pageid}"), "$.html", {"newsid": "newsid", "pageid": r"/(\d+)-\d+\.html$"}),
)


def body_request(url: Column, adapters: tuple[BodyAdapter, ...] = BODY_ADAPTERS) -> Column:
    """(adapter, endpoint, post) for an article's address, by the first adapter that serves its host; null if none does."""
    out = F.lit(None).cast("struct<adapter: string, endpoint: string, post: string>")
    for a in reversed(adapters):
        out = F.when(a.serves(url), a.request(url)).otherwise(out)
    return out


def answer_body(adapter: Column, status: Column, answer: Column, adapters: tuple[BodyAdapter, ...] = BODY_ADAPTERS) -> Column:
    """The body in an answer to ``body_request``; null if it has none, so that the page itself is read instead."""
    out = F.lit(None).cast("string")
    for a in adapters:
        out = F.when(adapter == a.name, a.body(status, answer)).otherwise(out)
    return out


@dataclass
class _Source(InputPartition):
    requests: list[dict]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.requests, self.timeout = json.loads(options.get("requests", "[]")), float(options.get("timeout", "8"))
        self.agent, self.most = options.get("agent", "Mozilla/5.0 (compatible)"), int(options.get("mostbytes", str(32 << 20)))

    def partitions(self) -> list[InputPartition]:
        by: dict[str, list[dict]] = {}
        for r in self.requests:
            by.setdefault(str(r.get("source_id")), []).append(r)
        return [_Source(rs) for rs in by.values()] or [_Source([])]

    def read(self, partition: _Source) -> Iterator[tuple]:
        for r in partition.requests:
            head = r.get("source_id"), r.get("number"), r.get("url")
            try:
                if not str(r.get("url")).startswith(("http://", "https://")):
                    raise ValueError("no address of the web")
                post = r.get("post")
                headers = {"User-Agent": self.agent} | ({"Content-Type": "application/json"} if post else {})
                request = urllib.request.Request(r["url"], data=post.encode() if post else None, headers=headers)
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    yield *head, answer.status, answer.headers.get("Content-Type"), answer.read(self.most), None
            except urllib.error.HTTPError as e:
                yield *head, e.code, e.headers.get("Content-Type"), None, f"HTTP {e.code}"
            except (OSError, ValueError) as e:
                yield *head, None, None, None, f"{type(e).__name__}: {e}"[:300]


class Answers(DataSource):
    """Answers to requests over the web. Options: ``requests``, a JSON list of objects (source_id, number, url, post), and timeout in
    seconds, agent and mostBytes. A source's requests are one partition, asked one after the other; a failure is a row
    with its error, so that one source doesn't stop the others."""

    @classmethod
    def name(cls) -> str:
        return "web_answers"

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def ask(spark: SparkSession, requests: DataFrame, most: int = 20_000, **options: str) -> DataFrame:
    """The answers to ``requests`` (source_id, number, url): those of a registry, whose rows are few, ``most`` at the utmost."""
    rows = requests.select(F.to_json(F.struct(*[c for c in ("source_id", "number", "url", "post") if c in requests.columns])).alias("r")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} requests; ask for them in parts")
    spark.dataSource.register(Answers)
    return spark.read.format("web_answers").options(requests=f"[{','.join(r.r for r in rows)}]", **options).load()
