"""Registered queries over tables that are changed in place: durable writes and a stream into them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import answers, listing, reports
from tessera.operators.durable import MonthTable, follow
from tessera.plans.articles import ITEMS, order_items, table
from tessera.plans.catalog import REPORTS, _reports, query
from tessera.sources.shared import settle, shared_dir


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


@query(
    f"WITH {ITEMS}, u AS (SELECT id, source_id, pub_date, CASE WHEN id % 5 = 0 AND id % 3 <> 0 THEN score + 1 ELSE score END AS score, category, CASE WHEN id % 5 = 0 THEN 'pending' ELSE status END AS status, title FROM item), "
    "r AS (SELECT *, status = 'pending' AND score >= 20 AS again FROM u) "
    "SELECT id, pub_date, CASE WHEN NOT again THEN score END AS score, CASE WHEN again THEN 'rejected' ELSE status END AS status FROM r WHERE pub_date >= TIMESTAMP '1994-01-01'"
)
def durable_items(spark, sf):
    """Two thirds of the items as a table; the rest and changed ones come as a batch, scores are reset, old rows expire. Each
    batch is applied twice."""
    rows = order_items(spark, sf)
    kept = MonthTable(spark, _path(spark, "items"), "id", "pub_date").create(rows.filter("id % 3 <> 0"))
    new = rows.filter("id % 3 = 0 OR id % 5 = 0").withColumns({"status": F.when(F.col("id") % 5 == 0, "pending").otherwise(F.col("status"))})
    for _ in range(2):
        kept.upsert(0, new, {"score": lambda old, fresh: fresh + 1})
        kept.update(1, (F.col("status") == "pending") & (F.col("score") >= 20), {"score": F.lit(None), "status": F.lit("rejected")})
        kept.delete(2, F.col("pub_date") < "1994-01-01")
    return kept.read().select("id", "pub_date", "score", "status")


@query(
    "SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*)::BIGINT AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents, max(ts) AS last_ts FROM events GROUP BY ALL"
)
def stream_totals(spark, sf):
    """Totals of users and months from several micro-batches that add up in a table by month, each once."""
    parts = settle(table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value").repartition(3), "event_parts")
    path = _path(spark, "totals")
    begun = parts.limit(0).select(F.lit("").alias("key"), "user_id", "ts", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("cents"), F.col("ts").alias("last_ts"))
    totals = MonthTable(spark, f"{path}/table", "key", "ts").create(begun)

    def changes(rows):
        first = F.date_trunc("month", "ts")
        key = F.concat_ws("|", F.coalesce(F.col("user_id").cast("string"), F.lit("null")), F.date_format("ts", "yyyy-MM"))
        sums = rows.groupBy(key.alias("key"), "user_id", first.alias("ts"))
        return sums.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.max(rows.ts).alias("last_ts"))

    add = lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
    source = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(parts.inputFiles()[0].rpartition("/")[0])
    follow(source, totals, f"{path}/state", changes, {"n": add, "cents": add, "last_ts": F.greatest})
    return totals.read().select("user_id", F.date_format("ts", "yyyy-MM").alias("month"), "n", "cents", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


BODY = "'[' || string_agg(to_json({'id': id, 'title': title, 'score': CASE WHEN id % 3 = 0 THEN NULL ELSE score::INT END}), ',' ORDER BY pub_date DESC, id DESC) || ']'"


@query(
    f"WITH {ITEMS}, p AS (SELECT * FROM item WHERE status = 'selected' ORDER BY pub_date DESC, id DESC LIMIT 50), b AS (SELECT {BODY} AS body FROM p) "
    "SELECT 200 AS status, '\"' || format('{:x}', list_reduce([0::BIGINT] || list_transform(range(1, length(body) + 1), lambda i: unicode(body[i])::BIGINT), lambda h, c: (h * 31 + c) % 4294967296)) || '\"' AS etag, body FROM b"
)
def item_answer(spark, sf):
    """The newest items as the public interface sends them, with the body's tag."""
    rows = listing.published(order_items(spark, sf)).withColumn("score", F.when(F.col("id") % 3 != 0, F.col("score").cast("int")))
    page = rows.orderBy(F.desc("pub_date"), F.desc("id")).limit(50)
    place = F.row_number().over(Window.orderBy(F.desc("pub_date"), F.desc("id"))) - 1  # of one page
    return answers.answer(page.withColumn("place", place), ("id", "title", "score"))


@query(f"WITH {REPORTS} SELECT wanted, max(report_date) AS report_date, max(report_date) < wanted AS is_stale FROM ask JOIN rep ON report_date BETWEEN wanted - 1 AND wanted GROUP BY wanted")
def report_asof_yesterday(spark, sf):
    """The report of the very day, else of the day before."""
    return reports.as_of(*_reports(spark, sf), within=1)
