import hashlib
import json
import re

import duckdb
import pytest

from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, turns int, layout string, formatted string"
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
NASTY = [
    None, "", "\\", "\\\\s", "<s>", "<\\s>", "a<", "/s>", "<<s>>", "<|im_end|>\\", "[[INST]]", "x\n\ny\r\n", "$1 \\1 $0", "é😀<|im_sep|>😀", "".join(CONTROLS) * 2, "<\\|im_start|>", "<</SYS>></s>[/INST]",
    "<" * 30 + "[" * 30, "<s>\\" * 5_000,
]


def escape(text):
    return re.sub("|".join(re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in CONTROLS), lambda m: m[0] + "\\", (text or "").replace("\\", "\\\\"))


def brute(rows):
    convs = {}
    for i, turn, role, text in [*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        key = lambda v: (v is not None, v if v is not None else 0)
        convs.setdefault(i, []).append((key(turn), (role is not None, role or ""), (text is not None, text or "")))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for i, turns in convs.items():
        turns = [(r[1], t[1]) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"<|im_start|>{escape(r)}<|im_sep|>{escape(t)}<|im_end|>" for r, t in turns)
        out.append((i, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole)))
    return sorted(out, key=repr)


ROWS = [(k // 4, k, ("user", "assistant", "system", "assistant")[k % 4], t) for k, t in enumerate(NASTY * 3)]
ROWS += [(900, None, None, None), (900, 1, "assistant", "b"), (900, 1, "assistant", "a"), (900, 1, "assistant", "a"), (None, 0, "user", "x"), (None, 0, "<s>\n\\", "y"), (901, 5, "assistant", "word " * 40_000)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "l", "f") for r in rows], SCHEMA)


def test_equal_to_brute_force_and_to_sql(spark):
    got = sorted((tuple(r) for r in chat.digests(frame(spark, ROWS).repartition(3)).collect()), key=repr)
    assert got == brute(ROWS)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    assert got == sorted(con.execute(chat.ORACLE).fetchall(), key=repr)


def test_no_control_string_of_a_text_is_left_and_spans_hold_what_the_assistant_wrote(spark):
    template = chat.Template()
    rows = chat.formatted(chat.canonical_turns(frame(spark, ROWS))).collect()
    for r in rows:
        want = [t for t in sorted((x for x in ROWS if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert not any(c in r.formatted for c in template.others)
        assert [r.formatted.count(m) for m in CONTROLS[:3]] == [len(want)] * 3
        assert [re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start : s.end]) for s in r.loss_spans] == [t[3] or "" for t in want if t[2] == "assistant"]


def test_empty_table_holds_the_planted_conversation_and_the_plan_no_python(spark):
    df = chat.digests(frame(spark, []))
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in df.collect()] == [(-1, 2, 21)]
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))


HI = [("user", "hi"), ("assistant", "ho")]
RECORDS = [
    ({"messages": [{"role": "human", "content": "hi"}, {"role": "gpt", "content": "ho"}]}, HI),
    ({"messages": [{"content": "hi", "role": "user", "name": "x"}, {"role": "assistant", "content": "ho"}], "id": 5, "tags": [{"a": 1}]}, HI),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}], "system": "be"}, [("system", "be"), *HI]),
    ({"conversations": [{"from": "human", "value": None}], "system": None}, [("user", None)]),
    ({"instruction": "hi", "input": "", "output": "ho"}, HI),
    ({"instruction": "hi", "input": "it", "output": "ho"}, [("user", "hi\n\nit"), ("assistant", "ho")]),
    ({"instruction": "hi", "context": "it", "response": "ho", "category": "c"}, [("user", "hi\n\nit"), ("assistant", "ho")]),
    ({"prompt": "hi", "completion": "ho"}, HI),
    ({"system": "be", "question": "hi", "answer": "ho"}, [("system", "be"), *HI]),
    ({"turns": [{"role": "user", "text": "hi"}, {"role": "bot", "text": "ho"}]}, HI),
    ({"prompt": "hi"}, None),
    ({"messages": [{"role": "user"}]}, None),
    ({}, None),
    (None, None),
]


def test_records_of_many_layouts(spark):
    rows = [(k, json.dumps(r) if r is not None else None) for k, (r, _) in enumerate(RECORDS)] + [(98, "no json"), (99, "[1]"), (97, "")]
    got = {r.key: r for r in chat.record_turns(spark.createDataFrame(rows, "key long, record string"), "key", "record").collect()}
    assert len(got) == len(rows)
    for k, (_, want) in enumerate(RECORDS):
        assert (None if got[k].turns is None else [tuple(t) for t in got[k].turns]) == want, k
        assert (got[k].layout is None) == (want is None)
    assert all(got[k].turns is None for k in (97, 98, 99))


def test_typed_tables_by_fingerprint(spark):
    df = spark.createDataFrame([(1, [("user", "hi"), ("gpt", "ho")], 3), (2, None, 3)], "id long, messages array<struct<role: string, content: string>>, mark int")
    assert {r.id: [tuple(t) for t in r.turns] for r in chat.canonical_turns(df, "id").collect()} == {1: HI, 2: []}
    pair = spark.createDataFrame([(1, "hi", "ho", "be"), (2, "hi", "ho", None)], "id long, prompt string, response string, system string")
    assert {r.id: [tuple(t) for t in r.turns] for r in chat.canonical_turns(pair, "id").collect()} == {1: [("system", "be"), *HI], 2: HI}
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "id long, prompt string"), "id")
    assert len(chat.BY_PRINT) == len(chat.LAYOUTS)
