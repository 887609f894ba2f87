import math
from collections import defaultdict

import duckdb
import pytest

from tessera.llm import mixing

SCHEMA = "doc_id long, source string, text string, epoch string, s int, tokens int"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, "x", 1, 2) for i, s, t in rows], SCHEMA)


def rows_of(sizes, words=5):
    out, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            out.append((k, s, " ".join(["w"] * words)))
            k += 1
    return out


def passes(df):
    return {r.source: r for r in df.collect()}


def test_smallest_source_reaches_the_limit(spark):
    p = passes(mixing.source_passes(mixing.token_counts(frame(spark, rows_of({"big": 800, "mid": 200, "small": 50}))), max_passes=2.0))
    assert p["big"].passes_ppm == 1_000_000 and abs(p["small"].passes_ppm - 2_000_000) <= 1
    assert 1_000_000 < p["mid"].passes_ppm < 2_000_000
    assert sum(r.weight for r in p.values()) == pytest.approx(1)
    alpha = p["big"].alpha
    assert (50 / 800) ** (alpha - 1) == pytest.approx(2.0, abs=1e-6)


def test_entropy_target(spark):
    counts = mixing.token_counts(frame(spark, rows_of({"a": 900, "b": 90, "c": 10})))
    p = passes(mixing.source_passes(counts, entropy=1.0))
    assert -sum(r.weight * math.log(r.weight) for r in p.values()) == pytest.approx(1.0, abs=1e-6)
    even = passes(mixing.source_passes(counts, entropy=5.0))
    assert all(r.weight == pytest.approx(1 / 3, abs=1e-6) for r in even.values())
    assert passes(mixing.source_passes(counts, entropy=0.0))["a"].alpha == 1.0


def test_budget_and_limit(spark):
    counts = mixing.token_counts(frame(spark, rows_of({"a": 900, "b": 100})))
    p = passes(mixing.source_passes(counts, max_passes=3.0, budget=1000))
    assert sum(r.quota for r in p.values()) <= 1001 and p["b"].quota <= 1500
    p = passes(mixing.source_passes(counts, max_passes=1.5, budget=10**9))
    assert (p["a"].quota, p["b"].quota) == (6750, 750)


def test_draws_fill_their_quota_and_spread_over_blocks(spark):
    rows = rows_of({"big": 3000, "small": 300})
    out = mixing.mix_sources(frame(spark, rows), block_tokens=2000).collect()
    drawn = defaultdict(int)
    for r in out:
        drawn[r.doc_id] += 1
    assert all(drawn[i] == 1 for i, s, _ in rows if s == "big") and all(drawn[i] == 2 for i, s, _ in rows if s == "small")
    per = defaultdict(lambda: defaultdict(int))
    for r in out:
        per[r.mix_block][r.source] += r.n_tokens
    assert len(per) == 9
    assert all(abs(p["small"] / p["big"] - 0.2) < 0.02 for p in per.values())
    start = sorted((r.start, r.start + r.n_tokens) for r in out if r.source == "big")
    assert all(a[1] == b[0] for a, b in zip(start, start[1:], strict=False)) and start[0][0] == 0


def test_rows_drawn_equal_the_plan(spark):
    rows = [*rows_of({"big": 400, "mid": 150, "small": 30}), (2000, None, "a b"), (2001, None, None), (2002, "none", ""), (2003, "none", None), (7, "big", "w w w w w"), (None, "big", "w w")]
    df = frame(spark, rows)
    plan, docs = mixing.mix_sources(df).collect(), mixing.draw_documents(df)
    assert docs.columns == df.columns
    a, b = defaultdict(int), defaultdict(int)
    for r in plan:
        a[r.doc_id, r.source, r.n_tokens] += 1
    for r in docs.collect():
        b[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert a == b
    assert all(b[i, s, len((t or "").split())] >= 1 for i, s, t in rows)


def test_equal_to_sql(spark):
    rows = [*rows_of({"x": 60, "y": 7, "z": 30}, 3), (500, None, "a\tb"), (501, None, None), (502, "e", "")]
    got = sorted((tuple(r) for r in mixing.mix_sources(frame(spark, rows)).collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert got == sorted(con.execute(mixing.ORACLE).fetchall(), key=str)


def test_empty_table(spark):
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    assert mixing.draw_documents(frame(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    df = mixing.mix_sources(frame(spark, rows_of({"a": 20, "b": 5})))
    plan = df._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_equal_rows_at_the_cut_are_cut_by_number(spark):
    rows = [(7, "a b c", "small")] * 200 + [(i, "a b c", "big") for i in range(282)]
    docs = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, source string, _s int, epoch string").repartition(5)
    plan = mixing.mix_sources(docs).groupBy("source").count()
    drawn = mixing.draw_documents(docs)
    assert drawn.columns == docs.columns
    assert {r.source: r["count"] for r in drawn.groupBy("source").count().collect()} == {r.source: r["count"] for r in plan.collect()}
    per = {r._s: r["count"] for r in drawn.groupBy("_s").count().collect()}
    assert set(per) == set(range(482)) and set(per.values()) <= {1, 2}
