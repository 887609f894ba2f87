import random

import numpy as np
import pytest

from tessera.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
ALPHABET = "ab e  the\n\tÀé漢字😀_-—'\"0123 ing  "


@pytest.fixture(scope="module")
def proto():
    with open(pieces.default_model(), "rb") as f:
        return f.read()


def texts(seed, n, length):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(length))) for _ in range(n)] + ["", " ", "a", " a", "a   b  ", "\n\n", "aaaaaaaa" * 9, " " * 40]


def test_merge_model_equals_the_library(proto):
    model, library = pieces.Model(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    for t in texts(1, 400, 60):
        (ids,) = model.encode([t])
        assert ids.tolist() == library.encode(t), repr(t)
        assert model.decode(ids) == t == library.decode(ids.tolist())


def test_unigram_scores_equal_full_search(proto):
    model = pieces.Model(proto, pieces.UNIGRAM)

    def best(word):
        score = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            score[end] = score[end - 1] + model.least
            for n in range(1, min(end, 20) + 1):
                i = model.ids.get(word[end - n : end])
                if i is not None:
                    score[end] = max(score[end], score[end - n] + model.scores[i])
        return score[-1]

    rng = random.Random(2)
    words = sorted({"▁" + "".join(rng.choice("the ingérxq漢") for _ in range(rng.randrange(1, 12))).replace(" ", "") for _ in range(300)})
    for word, ids in model.encode_words(words).items():
        found = sum(model.scores[i] for i in ids if i not in model.bytes.values())
        unknown = sum(c not in model.ids for c in word)
        if not unknown:
            assert found == pytest.approx(best(word)), word
        assert model.decode(np.array(ids)) == word.replace("▁", " ")[1:]


def test_query_rows_and_round_trip(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts(3, 60, 200))] + [(900, None, "x", 1), (901, "e" * 50_000, "x", 1), (3, "again", None, None), (None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = pieces.encode_documents(df, pieces.default_model())
    got = out.collect()
    assert len(got) == len(rows) and all(r.decodes for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 900} == {0}
    back = {(r.doc_id, r.text) for r in pieces.decode_documents(out, pieces.default_model()).collect()}
    assert back == {(i, t or "") for i, t, *_ in rows}
    assert pieces.encode_documents(df.limit(0), pieces.default_model()).collect() == []


def test_text_with_the_mark_itself_says_so(proto):
    model = pieces.Model(proto)
    assert model.decode(model.encode(["a▁b"])[0]) == "a b"


def test_pairs_of_pieces_are_told_as_by_merging_and_kept_apart_from_words(proto):
    model, rng = pieces.Model(proto, remembered=10), random.Random(5)
    whole = [i for i in model.ids.values() if model.whole(i)]
    longer = {}
    for i in whole:
        longer.setdefault(model.pieces[i][:1], []).append(i)
    spaces = [i for i in whole if not model.pieces[i].strip(pieces.MARK)]
    pairs = [(rng.choice(whole), rng.choice(whole)) for _ in range(6_000)] + [(a, b) for a in spaces for b in [*spaces, *longer[pieces.MARK][:50]]]
    # pairs that overlap with a piece over the boundary: all ways to cut a piece or two in two pieces
    for i in rng.sample(whole, 3_000):
        text = model.pieces[i] + model.pieces[rng.choice(whole)]
        pairs += [(model.ids[text[:k]], model.ids[text[k:]]) for k in range(1, len(text)) if text[:k] in model.ids and text[k:] in model.ids]
    pairs = [(a, b) for a, b in pairs if model.whole(a) and model.whole(b)]
    merges, kinds = model.merged, set()
    for a, b in pairs:
        left, right = model.pieces[a], model.pieces[b]
        want = merges(left + right, len(left)) is not None
        assert model.neighbours(a, b) == want, (left, right)
        kinds.add(want)
    assert kinds == {True, False}
    # a task that remembers few words still remembers the pairs
    assert len(model._neighbours) == len(set(pairs)) > model.remembered
