import random

import numpy as np
import pandas as pd

from tessera.llm import bits, ngram_join

SCHEMA = "doc_id long, text string, node string, gram int, component_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def sets(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, num, den):
    s = {i: sets(t, size) for i, t in rows}
    parent = {i: i for i in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies(rng, words, n, most):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [*near_copies(rng, base, 120, 9), *[" ".join(base)] * 20]
    rows += [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 80))) + " " + " ".join(base[:30]) for _ in range(60)]
    rows += ["", None, " \t\n", "one two", "ONE  two", "one two three", "a b c d", "A B C D", "a b c d e"]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 1))
    for size, num, den in ((4, 85, 100), (5, 80, 100), (2, 50, 100)):
        assert result(ngram_join.components(frame(spark, rows), size, num, den)) == brute(rows, size, num, den)


def test_chain_of_links_is_one_component(spark):
    w = [f"v{i}" for i in range(400)]
    rows = [(100 - k, " ".join(w[k * 5 : k * 5 + 200])) for k in range(30)]
    got = result(ngram_join.components(frame(spark, rows)))
    assert got == brute(rows, 4, 85, 100)
    assert {c for _, c in got.values()} == {71}


def test_large_group_beyond_the_frequent_threshold(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "IN_BATCH", 2)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = list(enumerate(near_copies(rng, base, 150, 3)))
    assert result(ngram_join.components(frame(spark, rows))) == brute(rows, 4, 85, 100)


def test_empty_table_and_rows_without_id(spark):
    assert ngram_join.components(frame(spark, [])).collect() == []
    got = ngram_join.components(frame(spark, [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e")])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(3, 2, 3), (3, 2, 3)]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(2, None)]


def test_frequent_ngrams_are_counted_across_batches(monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTED", 10)
    batches = [["a b c d e f g"] * 2, [None, "", "a b c d e f g"], ["x y z w"] * 2]
    found = list(ngram_join._frequent(4, iter([pd.DataFrame({"text": b}) for b in batches])))
    assert [f.c.tolist() for f in found] == [[3] * 4, []]
    assert set(found[0].h) == set(ngram_join.shingle_set("a b c d e f g", 4))


def test_an_ngram_of_few_documents_among_many_is_counted_as_frequent():
    long = [" ".join(f"{k}w{i}" for i in range(600_000)) for k in range(2)]
    texts = ["a b c d e f g", long[0], "a b c d e f g", long[1], "a b c d e f g"]
    found = list(ngram_join._frequent(4, iter([pd.DataFrame({"text": [t]}) for t in texts])))
    assert {h for f in found for h in f.h} == set(ngram_join.shingle_set("a b c d e f g", 4))


def test_columns_frequent_over_all_tasks_but_not_in_one_are_placed_last(spark, monkeypatch):
    rng = random.Random(9)
    common = " ".join(f"c{k}" for k in range(12))
    rows = [(i, f"{common} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(5))) for i in range(1, 41)]
    rows += [(50, rows[0][1]), (51, rows[0][1] + " end"), (52, None)]
    written = {}
    settle = ngram_join.settle
    monkeypatch.setattr(ngram_join, "settle", lambda df, name: written.setdefault(name, settle(df, name)) if name == "late" else settle(df, name))
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 22), "doc_id long, text string")
    assert result(ngram_join.components(df)) == brute(rows, 4, 85, 100)
    late = {r.h: r.c for r in written["late"].collect()}
    held = ngram_join.shingle_set(common, 4) & 0xFFFFFFFF
    assert late and set(late) <= set(held.tolist()) and min(late.values()) >= ngram_join.IN_ALL


def test_filter_of_few_values_lets_few_others_pass(spark):
    values = bits.id_hashes(np.arange(20_000))
    table = bits.bit_table(spark.createDataFrame(pd.DataFrame({"h": values})), len(values))
    assert bits.holds(table, values).all()
    assert bits.holds(table, bits.id_hashes(np.arange(20_000, 220_000))).mean() < 0.03
