import datetime as dt

from tessera.operators import health
from tessera.plans import web

DAY = dt.datetime(2024, 1, 5)


def test_first_by_key_in_any_order_of_arrival(spark, tmp_path):
    for k in range(2):
        rows = [(10 * k + i, DAY + dt.timedelta(days=d - k), u) for i, (d, u) in enumerate([(9, 1), (3, 1), (8, None), (7, 2), (1, 2), (2, None)])]
        df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: r.first_ts for r in web.stream_first_by_key(spark, str(tmp_path)).collect()}
    assert got == {1: DAY + dt.timedelta(days=2), 2: DAY, None: DAY + dt.timedelta(days=1)}


def test_rate_limit_holds_no_history_in_a_row(spark):
    rows = spark.range(30_000).selectExpr("id as event_id", "if(id % 3 = 0, null, 1L) as user_id", "timestamp_seconds((id * 7919) % 30000) as ts")
    df = health.rate_limit(rows, "user_id", "ts", "event_id", 100, 2)
    assert "collect_list" not in df._jdf.queryExecution().toString()
    got = {r.event_id: (r.in_window, r.allowed) for r in df.collect()}
    want = {}
    for odd in (False, True):
        start, n = None, 0
        for t, i in sorted((i * 7919 % 30_000, i) for i in range(30_000) if (i % 3 == 0) == odd):
            start, n = (t, 1) if start is None or t - start > 100 else (start, n + 1)
            want[i] = (n, n <= 2)
    assert got == want


def test_windows_that_have_ended_leave_no_state(spark, tmp_path):
    import datetime as dt

    from tessera.streaming import jobs

    t0 = dt.datetime(2024, 1, 1)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ip long, id long, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(source)
    stream = jobs.rate_limit(spark.readStream.schema(schema).parquet(source), "ip", "ts", "id", 60, 1, late="10 seconds")
    left = []
    for batch in ([(1, 0, 0), (2, 1, 5), (1, 2, 30)], [(3, 3, 500)], [(1, 4, 505)], [(9, 5, 2000)], [(9, 6, 2001)]):
        spark.createDataFrame([(ip, i, t0 + dt.timedelta(seconds=s)) for ip, i, s in batch], schema).coalesce(1).write.mode("append").parquet(source)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.id, r.in_window) for r in spark.read.parquet(out).collect())
    assert got == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 1), (5, 1), (6, 2)]
    assert left[-1] == 1, left


def test_a_hot_key_is_held_as_numbers_only_and_streaks_that_end_leave_no_state():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from tessera.streaming import jobs

    class State:
        exists, value = False, None
        hasTimedOut = False

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

        def remove(self):
            self.exists, self.value = False, None

    n = 1_000_000
    place = np.random.default_rng(3).permutation(n)

    def batches():
        for i in range(0, n, 10_000):
            at = place[i : i + 10_000]
            yield pd.DataFrame({"micros": at * 1_000_000, "id": at, "failed": at % 5 != 4})

    state, at = State(), 0
    tracemalloc.start()
    for part in jobs._streaks((1,), batches(), state):
        assert (part.id == np.arange(at, at + len(part))).all() and (part.streak == (part.id + 1) % 5).all()
        at += len(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == n and peak < 100 << 20 and not state.exists
    limited = jobs._limited(9, 3, False)
    got = pd.concat(limited((1,), (b.drop(columns="failed") for b in batches()), state))
    assert (got.in_window == np.arange(n) % 10 + 1).all() and (got.allowed == (got.in_window <= 3)).all()


def test_links_out_of_order_and_forgotten_links(spark, tmp_path):
    from tessera.streaming import jobs

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "link string, n long, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(source)
    stream = jobs.first_by_link(spark.readStream.schema(schema).parquet(source), "link", "ts", "2 days")
    for batch in ([("a", 1, 5), ("b", 2, 5)], [("a", 3, 4), ("c", 4, 4)], [("z", 5, 20)], [("y", 6, 21), ("a", 7, 21)], [("a", 8, 21)]):
        spark.createDataFrame([(k, n, DAY + dt.timedelta(days=d)) for k, n, d in batch], schema).coalesce(1).write.mode("append").parquet(source)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 2, 4, 5, 6, 7]
