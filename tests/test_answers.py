"""Entity tags against the sequential recurrence, and answers."""

import json
import random

import pytest

from tessera.operators import answers, listing, reports


def sequential(body):
    h, raw = 0, body.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[i : i + 2])) & 0xFFFFFFFF
    return f'"{h:x}"'


@pytest.mark.parametrize("fold", [2, 3, 1000])
def test_tag_of_parts_equals_the_recurrence(spark, monkeypatch, fold):
    monkeypatch.setattr(answers, "FOLD", fold)
    monkeypatch.setattr(answers, "LEVELS", 6)
    rng = random.Random(fold)
    texts = ["".join(rng.choice("aé😀\n\"0z中") for _ in range(rng.randrange(0, 40))) for _ in range(50)] + [None, "", "x" * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "place long, text string").repartition(7)
    assert answers.etag(df).first().etag == sequential("".join(t or "" for t in texts))
    assert answers.etag(df.limit(0)).first().etag == '"0"'


def test_answers_keep_nulls_and_tell_what_has_not_changed(spark):
    page = spark.createDataFrame([(1, None, "b"), (0, 5, 'a "q" é')], "place long, n int, t string")
    got = answers.answer(page, ("n", "t")).first()
    assert json.loads(got.body) == [{"n": 5, "t": 'a "q" é'}, {"n": None, "t": "b"}]
    assert got.status == 200 and got.etag == sequential(got.body)
    again = answers.answer(page, ("n", "t"), known=got.etag).first()
    assert (again.status, again.etag, again.body) == (304, got.etag, None)
    assert answers.answer(page, ("n", "t"), known='"1"').first().status == 200
    empty = answers.answer(page.limit(0), ("n", "t")).first()
    assert (empty.body, empty.etag) == ("[]", sequential("[]"))


def test_a_cursor_that_cannot_be_read_is_an_error(spark):
    df = spark.createDataFrame([], "id long, pub_date timestamp, status string, category string, title string, score double")
    with pytest.raises(ValueError, match="no cursor"):
        listing.items_page(df, cursor="%%%")


def test_latest_report_is_found_without_a_window(spark):
    held = spark.sql("SELECT explode(array(date'2023-11-30', date'2024-01-05', date'2024-01-20', date'2024-04-01')) AS report_date")
    wanted = spark.sql("SELECT explode(array(date'2023-11-01', date'2023-12-31', date'2024-01-04', date'2024-01-20', date'2024-01-25', date'2024-03-31', date'2024-04-02')) AS wanted")
    out = reports.as_of(held, wanted, None)
    assert "Window" not in out._jdf.queryExecution().toString()
    assert {str(r.wanted): (str(r.report_date), r.is_stale) for r in out.collect()} == {
        "2023-12-31": ("2023-11-30", True), "2024-01-04": ("2023-11-30", True), "2024-01-20": ("2024-01-20", False), "2024-01-25": ("2024-01-20", True), "2024-03-31": ("2024-01-20", True), "2024-04-02": ("2024-04-01", True),
    }
