import random

import corpus_pipeline
from tessera.llm import secrets
from tests.llm.test_ngram_join import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TONGUES = {"aa": ["the", "ing", "er", "on"], "bb": ["eau", "oi", "que", "ment"]}


def speak(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def write(spark, tmp_path, rows):
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)
    df.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def corpus():
    rng = random.Random(0)
    rows = [(i, speak(rng, TONGUES["aa" if i % 3 else "bb"], 60), "aa" if i % 3 else "bb", "s0" if i % 4 else f"s{i % 5}") for i in range(150)]
    copy = rows[10][1].split()
    rows += [(200 + k, " ".join(copy[:30] + [f"new{k}"] + copy[31:]), "aa", "s0") for k in range(12)]
    rows += [(300, rows[5][1], "aa", "s1"), (301, "## 12 34", "aa", "s1"), (302, None, None, "s1"), (303, "", None, None)]
    rows += [(304, speak(rng, TONGUES["aa"], 30) + " password = 'hunter2hunter2' " + speak(rng, TONGUES["aa"], 30), "aa", None)]
    return rows


def test_stages_act_on_all_that_is_left(spark, tmp_path):
    rows = corpus()
    sf = write(spark, tmp_path, rows)
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    columns = docs.columns
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        out = f"{tmp_path}/stage{i}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs.collect()
    ids = {n: sorted(r.doc_id for r in k) for n, k in kept.items()}
    assert ids["language"] == sorted(i for i, *_ in rows if i not in (301, 302, 303))
    linked = brute([(r.doc_id, r.text) for r in kept["language"]], 5, 80, 100)
    assert ids["near_duplicates"] == sorted({c for _, c in linked.values()})
    assert not {300, 200, 205} & set(ids["near_duplicates"])
    before = {r.doc_id: r for r in kept["near_duplicates"]}
    for r in kept["secrets"]:
        assert r.text == secrets.mask(before[r.doc_id].text) and r.n_chars == len(r.text)
    assert ids["secrets"] == ids["near_duplicates"] and "hunter2" not in str(kept["secrets"])
    assert set(ids["mixture"]) == set(ids["secrets"]) and len(ids["mixture"]) > len(ids["secrets"])


def test_run_gives_tokens_of_the_mixture(spark, tmp_path):
    got = corpus_pipeline.run(spark, write(spark, tmp_path, corpus())).collect()
    assert got and all(r.n_tokens == len(r.ids) and r.decodes for r in got)
    assert len({r.doc_id for r in got}) < len(got)


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).collect() == []


def test_repeated_rows_null_ids_very_long_texts_and_clashing_names(spark):
    rng = random.Random(3)
    long = speak(rng, TONGUES["aa"], 30_000)
    rows = [(1, long, "aa", "s0"), (1, long, "aa", "s0"), (1, long + " more", "aa", "s0"), (2, long, "aa", "s1"), (None, "the on ing", "aa", "s0"), (None, "the on ing", "aa", "s0"), (4, None, None, None), (5, "", None, "s0")]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), k, "x") for k, r in enumerate(rows)], f"{SCHEMA}, component_id int, node string")
    out = dict(corpus_pipeline.STAGES)
    kept = out["near_duplicates"](spark, df, "").collect()
    assert sorted(((r.doc_id or 0), r.component_id) for r in kept) == [(0, 4), (0, 5), (1, 0), (4, 6), (5, 7)]
    masked = out["secrets"](spark, df, "")
    assert masked.columns == df.columns and masked.count() == len(rows)
    drawn = out["mixture"](spark, df, "")
    assert drawn.columns == df.columns and {r.component_id for r in drawn.collect()} == set(range(len(rows)))
    assert len(out["tokens"](spark, df, "").collect()) == len(rows)
    assert out["language"](spark, df, "").columns == df.columns


def test_language_stage_keeps_what_the_model_accepts(spark):
    from tessera.llm import language

    rng = random.Random(4)
    rows = [(i, speak(rng, TONGUES["aa" if i % 2 else "bb"], 40), "aa" if i % 2 else "bb", "s0") for i in range(80)] + [(90, "12 ½", None, "s0"), (91, None, None, "s0")]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    model = language.learn(df)
    want = {i for (i, text, *_), (lang, score, _, _) in zip(rows, language.predict(model, [r[1] for r in rows]), strict=True) if lang != "und" and score >= 0.5}
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, df, "").collect()} == want == set(range(80))
