"""Tables by month: the state after batches, what is rewritten, and runs that stop between rows and log."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators.durable import MonthTable, follow

SCHEMA = "id long, at timestamp, n long, s string"


def day(m, d=1):
    return dt.datetime(2024, m, d)


def begin(spark, tmp_path, rows):
    return MonthTable(spark, f"file://{tmp_path}/t", "id", "at").create(spark.createDataFrame(rows, SCHEMA))


def held(t):
    return sorted(((r.id, r.at, r.n, r.s) for r in t.read().collect()), key=repr)


def files(spark, tmp_path):
    rows = spark.read.parquet(f"file://{tmp_path}/t/rows").select("_month", F.input_file_name().alias("f")).distinct().collect()
    return {m: {r.f for r in rows if r._month == m} for m in {r._month for r in rows}}


ROWS = [(1, day(1), 1, "a"), (2, day(1, 9), 2, "b"), (3, day(2), 3, "c"), (4, day(3), 4, "d"), (None, None, 5, "e")]


def test_upsert_replaces_inserts_and_rewrites_touched_months_alone(spark, tmp_path):
    t = begin(spark, tmp_path, ROWS)
    before = files(spark, tmp_path)
    new = spark.createDataFrame([(2, day(3), 20), (9, day(1), 90)], "id long, at timestamp, n long")
    assert t.upsert(0, new) and not t.upsert(0, new)
    assert held(t) == sorted([(1, day(1), 1, "a"), (2, day(3), 20, "b"), (3, day(2), 3, "c"), (4, day(3), 4, "d"), (9, day(1), 90, None), (None, None, 5, "e")], key=repr)
    after = files(spark, tmp_path)
    assert {m for m in before if before[m] != after[m]} == {"2024-01"}


def test_null_key_and_insert_only(spark, tmp_path):
    t = begin(spark, tmp_path, ROWS)
    t.upsert(0, spark.createDataFrame([(None, day(5), 50, "x"), (1, day(1), 10, "x"), (7, day(7), 70, "x")], SCHEMA), insert_only=True)
    assert held(t) == sorted([*ROWS, (7, day(7), 70, "x")], key=repr)
    t.upsert(1, spark.createDataFrame([(None, day(5), 50, "x")], SCHEMA))
    assert (None, day(5), 50, "x") in held(t)


def test_update_and_delete(spark, tmp_path):
    t = begin(spark, tmp_path, ROWS)
    before = files(spark, tmp_path)
    assert t.update(0, F.col("n") >= 4, {"s": F.lit(None)})
    assert held(t) == sorted([r if r[2] < 4 else (*r[:3], None) for r in ROWS], key=repr)
    assert {m for m, f in files(spark, tmp_path).items() if before[m] != f} == {"2024-03", "none"}
    assert t.delete(1, F.col("at") < day(2, 1)) and not t.delete(1, F.lit(True))
    assert sorted(r[2] for r in held(t)) == [3, 4, 5]
    t.upsert(2, spark.createDataFrame([(1, day(1), 11, "back")], SCHEMA))  # into the month that was emptied
    assert (1, day(1), 11, "back") in held(t)
    t.delete(3, F.lit(True))
    assert held(t) == [] and t.read().columns == ["id", "at", "n", "s"]


class Stops(MonthTable):
    """A table whose log fails so many times, after the rows are written."""

    fails = 1

    def _log(self, batch):
        if self.fails:
            self.fails -= 1
            raise OSError("stopped")
        super()._log(batch)


def test_a_batch_that_stopped_before_its_log_adds_up_once(spark, tmp_path):
    begin(spark, tmp_path, ROWS)
    t = Stops(spark, f"file://{tmp_path}/t", "id", "at")
    new, add = spark.createDataFrame([(1, day(1), 10, "z"), (8, day(8), 80, "z")], SCHEMA), {"n": lambda a, b: a + b}
    with pytest.raises(OSError, match="stopped"):
        t.upsert(0, new, add)
    assert t.upsert(0, new, add)
    assert [r[2] for r in held(t) if r[0] in (1, 8)] == [11, 80]


def test_a_stream_that_stops_and_starts_again_equals_the_batch(spark, tmp_path):
    for k in range(4):
        spark.range(k * 50, k * 50 + 50).selectExpr("id % 7 AS id", "timestamp'2024-01-01' + make_interval(0, cast(id % 7 AS int)) AS at", "id AS n", "'s' AS s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    begin(spark, tmp_path, [])
    t = Stops(spark, f"file://{tmp_path}/t", "id", "at")

    def run():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        follow(source, t, f"file://{tmp_path}/state", lambda rows: rows.groupBy("id", "at", "s").agg(F.sum("n").alias("n")), {"n": lambda a, b: a + b})

    t.fails = 1
    with pytest.raises(Exception, match="stopped"):
        run()
    run()
    assert {r[0]: r[2] for r in held(t)} == {k: sum(i for i in range(200) if i % 7 == k) for k in range(7)}
    assert spark.read.parquet(f"file://{tmp_path}/t/log").count() == 4
