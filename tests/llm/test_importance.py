import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tessera.llm import importance

SCHEMA = "doc_id long, text string, block string, n_words int, rank string"


def grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    counts = [[0] * 10_000 for _ in range(2)]
    for k, texts in enumerate(([t for _, t in docs], target)):
        for t in texts:
            for g in grams(t)[1]:
                counts[k][bucket(g)] += 1
    s_all, t_all = map(sum, counts)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10_000) / ((s + 1) * (t_all + 10_000)))) for s, t in zip(*counts, strict=True)]
    rows = []
    for i, text in docs:
        w, g = grams(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in g)
        rows.append((len(w) < 20, -(weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))), (i is None, i or 0), len(g), weight, i))
    n = 5 * sum(not r[0] for r in rows) // 100
    return sorted(((i, f, w, -s, k + 1 if k < n else None) for k, (_, s, _, f, w, i) in enumerate(sorted(rows))), key=repr)


def corpus():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdeéö😀9") for _ in range(rng.randrange(1, 5))) for _ in range(150)]
    speak = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = [(i, speak(rng.choice((3, 19, 20, 21, 60, 200)))) for i in range(220)]
    docs += [(300 + i, "The very same THE very same, the very same one two three " * 4) for i in range(90)]  # a group of copies and a hot pair
    docs += [(400, None), (401, ""), (402, "..."), (403, "one"), (404, "One two"), (405, "a\x00b_c d e-F"), (None, speak(40)), (7, speak(30)), (7, speak(30)), (8, docs[8][1]), (406, speak(30_000)), (407, "ÀÉ x2y ǅ " * 9)]
    return docs, [speak(30) for _ in range(8)] + [None, ""]


def frames(spark, docs, target):
    return spark.createDataFrame([(*r, "b", 1, "r") for r in docs], SCHEMA).repartition(5), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")


@pytest.mark.parametrize(("block", "chars"), [(1_000_000, 8_000_000), (700, 9_000)])
def test_equal_to_brute_force_and_to_sql(spark, monkeypatch, block, chars):
    monkeypatch.setattr(importance, "BLOCK_WORDS", block)
    monkeypatch.setattr(importance, "RANGE_CHARS", chars)
    docs, target = corpus()
    got = sorted((tuple(r) for r in importance.resample(*frames(spark, docs, target)).collect()), key=repr)
    assert got == brute(docs, target)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(target)))
    assert got == sorted(con.execute(importance.ORACLE).fetchall(), key=repr)


def test_each_distinct_string_is_hashed_once(spark):
    """A pair or run that many blocks hold is in one range, and hashed there once."""
    known, texts = {}, []
    for t in ("a b c a b", "b c", "", "a b c"):
        texts.append(importance.np.array([known.setdefault(w, len(known) + 1) for w in importance.words_of(t)], importance.np.int32))
    blobs = dict(importance._block(known, texts, 1))
    pdf = importance.pd.DataFrame({"block": ["x", "y"], "range": 0, "runs": [blobs[0]] * 2, "n_words": None, "doc_ids": None})
    calls = []
    real = zlib.crc32
    try:
        importance.zlib.crc32 = lambda *a: calls.append(a) or real(*a)
        out = importance._features(10_000)(pdf)
    finally:
        importance.zlib.crc32 = real
    assert len(calls) == 3 + len({("a", "b"), ("b", "c"), ("c", "a"), ("b", None), ("c", None)}) + len({"abc", "bca", "cab", "ab-", "b--", "bc-", "c--"})
    assert sum(out["sums"].dropna().iloc[0]) == 2 * sum(len(grams(t)[1]) for t in ("a b c a b", "b c", "", "a b c"))


def test_empty_tables(spark):
    docs, target = frames(spark, [], [])
    assert importance.resample(docs, target).collect() == []
    some, _ = frames(spark, [(1, "a b c"), (2, None)], [])
    assert [(r.doc_id, r.n_features, r.rank) for r in importance.resample(some, target).orderBy("doc_id").collect()] == [(1, 6, None), (2, 0, None)]


def test_draws_favour_the_target(spark):
    rng = random.Random(2)
    speak = lambda parts, n: " ".join(rng.choice(parts) for _ in range(n))
    one, two = [f"a{k}" for k in range(50)], [f"b{k}" for k in range(50)]
    docs = [(i, speak(one if i % 10 else two, 40)) for i in range(400)]
    rows = importance.resample(*frames(spark, docs, [speak(two, 200)]), percent=10).collect()
    assert {r.doc_id % 10 for r in rows if r.rank} == {0} and sum(r.rank is not None for r in rows) == 40


def test_a_blocks_runs_are_packed_without_a_loop_over_words():
    """op11: the rest of each word is taken by place; only the words of the whole block are gone through one by one, not those of each range."""
    texts = [b"a bb bbb a bb c".split(), [], b"c".split(), b"bbb\xc3\xa9 a a a bb".split()]
    known = importance._numbers()
    ids = [np.array([known[w] for w in t], np.int32) for t in texts]
    assert sorted(known.values()) == list(range(1, len(known) + 1))
    found = []
    for _, packed in importance._block(known, ids, 3):
        x = importance.unpack(packed)
        words = [b"", *importance.sorted_words(x["heads"], x["tails"].tobytes())]
        first = np.cumsum(x["first"].astype(np.int64))
        second = importance._summed(x["second"].astype(np.int64), x["first"])
        pairs = [(words[i], words[j]) for i, j in zip(first, second, strict=True)]
        runs = [(*p, words[k]) for p, k in zip([p for p, n in zip(pairs, x["n_runs"], strict=True) for _ in range(n)], x["third"], strict=True)]
        found += [r for r, n in zip(runs, x["counts"], strict=True) for _ in range(n)]
    assert sorted(found) == sorted(tuple([*t[i : i + 3], b"", b""][:3]) for t in texts for i in range(len(t)))
