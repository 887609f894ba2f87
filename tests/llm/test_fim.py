import hashlib
import re

import duckdb

from tessera.llm import fim

SCHEMA = "text string, doc_id long, n int, form string, h string, units string"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc_id, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


TEXTS = [
    None, "", "a", "one two\nthree\r\nfour\x00five", "été 😀😀 naïve x", "has <P> inside", "<S", "<<S>", "x<M>y", "<P", "S>", "<" * 40, ">" * 40, "<S<P<M" * 9, "S>P>M>" * 9,
    "word " * 60_000, "12,34;\\n\\", "ab<\n>S",
]
ROWS = [(t, 100 * k + j) for k, t in enumerate(TEXTS) for j in range(12)] + [("a b c", None), ("a b c", None), ("a b c", 99_005), ("a b c", 99_005), ("x", -3)]


def frame(spark, rows):
    return spark.createDataFrame([(t, i, 1, "f", "h", "u") for t, i in rows], SCHEMA)


def test_equal_to_brute_force_and_to_sql(spark):
    got = sorted((tuple(r) for r in fim.digests(frame(spark, ROWS)).collect()), key=repr)
    assert got == sorted((brute(i, t) for t, i in ROWS), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, doc_id BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    assert got == sorted(con.execute(fim.ORACLE).fetchall(), key=repr)


def test_outputs_hold_what_the_form_says_and_are_restored(spark):
    rows = fim.transform(frame(spark, ROWS), seed=7, plain_percent=0, spm_percent=50)
    out = rows.withColumn("back", fim.restored(rows.output, rows.form)).collect()
    want = dict((i, t or "") for t, i in ROWS)
    assert all(r.back == want[r.doc_id] for r in out)
    for r in out:
        starts = {"plain": want[r.doc_id][:3], "psm": "<P>", "spm": "<S>"}[r.form]
        assert r.output.startswith(starts)
        assert (r.form == "plain") == (r.prefix_chars is None)
    assert {r.form for r in out if want[r.doc_id] == "a"} <= {"psm", "spm"}


def test_empty_table_and_no_python(spark):
    df = fim.digests(frame(spark, []))
    assert df.collect() == []
    assert not any(w in df._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))
