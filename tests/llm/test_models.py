import random
import zlib

import numpy as np

from tessera.llm import language, toxicity


def speak(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


TONGUES = {"aa": ["the", "ing", "er", "on"], "bb": ["eau", "oi", "que", "ment"], "cc": ["heit", "ung", "sch", "ei"]}


def docs(rng, n):
    names = sorted(TONGUES)
    return [(i, speak(rng, TONGUES[names[i % 3]], rng.randrange(5, 60)), names[i % 3]) for i in range(n)]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths, size = np.array([3, 1, 4, 2]), 3
    lay = language.Layout(lengths)
    emit, moves, start = rng.standard_normal((lengths.sum(), size)), rng.standard_normal((size, size)), rng.standard_normal(size)
    p, expected, _ = language.forward_backward(lay, emit[lay.source], moves, start)
    want, moved, at = np.zeros_like(emit), np.zeros((size, size)), 0
    for n in lengths:
        paths = np.stack(np.meshgrid(*[range(size)] * n, indexing="ij"), -1).reshape(-1, n)
        s = start[paths[:, 0]] + emit[at + np.arange(n), paths].sum(1) + (moves[paths[:, :-1], paths[:, 1:]].sum(1) if n > 1 else 0)
        w = np.exp(s - s.max())
        w /= w.sum()
        for t in range(n):
            want[at + t] = np.bincount(paths[:, t], w, size)
        for t in range(n - 1):
            np.add.at(moved, (paths[:, t], paths[:, t + 1]), w)
        at += n
    back = np.empty_like(p)
    back[lay.source] = p
    assert np.allclose(back, want) and np.allclose(expected, moved)


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(0)
    rows = [(*r, "x", 0.5) for r in docs(rng, 240)]
    odd = [(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "123 ## 4", "aa", None, None), (None, "theering", "aa", None, None), (5, rows[5][1], "cc", "x", 0.5)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, score double")
    model = language.learn(df)
    got = language.identify(df, model).collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert held and np.mean([r.lang_pred == rows[r.doc_id][2] for r in held]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}
    kept = language.accepted(df, model)
    assert kept.columns == df.columns and kept.filter("doc_id in (1000, 1001, 1002)").count() == 0
    assert kept.filter("doc_id < 240").count() >= 240
    assert language.identify(df.limit(0), None).collect() == []
    assert {r.lang_pred for r in language.identify(df, None).collect()} == {"und"}


def test_switched_text_is_labelled_by_word():
    rng = random.Random(1)
    known = docs(rng, 150)
    model = language.fit([t for _, t, _ in known], [n for _, _, n in known])
    (name, score, words, switches), = language.predict(model, [speak(rng, TONGUES["aa"], 40) + " " + speak(rng, TONGUES["bb"], 15)])
    assert name == "aa" and 0.5 < score < 0.95 and words == 55 and switches >= 1


def test_long_text_equals_itself_in_parts_of_a_batch():
    rng = random.Random(2)
    known = docs(rng, 90)
    model = language.fit([t for _, t, _ in known], [n for _, _, n in known])
    texts = [speak(rng, TONGUES["cc"], 3000), "", None, speak(rng, TONGUES["aa"], 3)]
    alone = [language.predict(model, [t])[0] for t in texts]
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(alone, language.predict(model, texts), strict=True))


def test_severity_is_learned_in_order_and_held_out(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        grade = rng.choice([0] * 6 + [1, 2])
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 60))]
        words += rng.sample(["scumb", "morone", "idioty"], 2) if grade else []
        words += ["threaten"] if grade == 2 else []
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x", 1))
        if i < 1000:
            labels.append((i, grade))
    df = spark.createDataFrame([*rows, (5000, None, "x", 1), (5001, "", None, None)], "doc_id long, text string, toxic string, severity int")
    model = toxicity.learn(df, spark.createDataFrame([*labels, (None, 1), (3000, None)], "doc_id long, grade int"), "grade")
    assert (np.diff(model.cuts) > 0).all()
    got = {r.doc_id: r for r in toxicity.grade_documents(df, model).collect()}
    truth = {i: 2 if "threaten" in t else 1 if any(w in t for w in ("scumb", "morone", "idioty")) else 0 for i, t, *_ in rows}
    held = range(1000, 1500)
    assert np.mean([got[i].toxic == (truth[i] > 0) for i in held]) >= 0.97
    mean = [np.mean([got[i].severity for i in held if truth[i] == g]) for g in (0, 1, 2)]
    assert mean[0] < 0.3 < mean[1] < mean[2]
    assert not got[5000].toxic and not got[5001].toxic
    assert toxicity.grade_documents(df.limit(0), model).collect() == []
    assert toxicity.learn(df, spark.createDataFrame([], "doc_id long, grade int"), "grade") is None
    assert {r.severity for r in toxicity.grade_documents(df, None).collect()} == {0.0}


def test_numerals_are_no_letters():
    from tessera.llm.features import letter_runs

    assert letter_runs("½ ² ⅷ 3 _") == []
    assert letter_runs("a½b été² 漢字") == ["a", "b", "été", "漢字"]
    assert all(c.isalpha() for w in letter_runs("".join(map(chr, range(32, 0x3000)))) for c in w)
