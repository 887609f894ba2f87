"""Language identification by a linear-chain conditional random field over words.

A word's features are its character n-grams, prefixes and suffixes among them, and the word itself as a lexicon entry;
transitions between the languages of neighbouring words are learned with them. Forward-backward gives each word's
language probabilities over the whole text, so a text that switches language is labelled word by word, and a document
has the language with the largest share of letters.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only
from tessera.llm.features import SLOTS, Grams, pieces, words_of

#: Labelled documents to learn from (those first in a random order), passes, step and weight decay.
SAMPLE, STEPS, RATE, DECAY = 800, 14, 0.25, 1e-5
#: Words of a training sequence; a longer text is several. Prediction never cuts a text.
TRAIN_WORDS = 256
UNKNOWN = "und"


class Layout:
    """Words of several sequences by place: all first words, all second words, ..., longer sequences first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sorted_ = lengths[self.order]
        steps = int(sorted_[0]) if len(sorted_) else 0
        self.active = np.searchsorted(-sorted_, -np.arange(steps), side="left")  # sequences longer than t
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        starts = (np.cumsum(lengths) - lengths)[self.order]
        self.source = np.concatenate([starts[:m] + t for t, m in enumerate(self.active)]) if steps else np.empty(0, np.int64)
        self.sequence = np.concatenate([self.order[:m] for m in self.active]) if steps else np.empty(0, np.int64)

    def steps(self) -> Iterator[tuple[int, int, int]]:
        for t, m in enumerate(self.active):
            yield t, int(self.at[t]), int(m)


def forward_backward(lay: Layout, emit: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Each word's label probabilities (in the layout's order), expected moves, and the log likelihood's normaliser.

    ``emit`` has a row of scores for each word in the layout's order."""
    top = emit.max(1, keepdims=True)
    e, a = np.exp(emit - top), np.exp(moves)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e))
    for t, o, m in lay.steps():
        x = e[o : o + m] * (np.exp(start) if t == 0 else alpha[lay.at[t - 1] : lay.at[t - 1] + m] @ a)
        scale[o : o + m] = s = x.sum(1)
        alpha[o : o + m] = x / s[:, None]
    expected = np.zeros_like(a)
    for t in range(len(lay.active) - 2, -1, -1):
        o, n, m = int(lay.at[t]), int(lay.at[t + 1]), int(lay.active[t + 1])
        right = e[n : n + m] * beta[n : n + m] / scale[n : n + m, None]
        beta[o : o + m] = right @ a.T
        expected += alpha[o : o + m].T @ right
    p = alpha * beta
    return p / p.sum(1, keepdims=True), expected * a, float(np.log(scale).sum() + top.sum())


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """Maximum likelihood of the documents' labels, given to each of their words, by adaptive gradient steps."""
    names = sorted(set(labels))
    if not names:
        return None
    words, codes, counts = words_of(texts)
    lengths, owner = [], []
    for i, n in enumerate(counts):
        cut = [TRAIN_WORDS] * (int(n) // TRAIN_WORDS) + ([int(n) % TRAIN_WORDS] if n % TRAIN_WORDS else [])
        lengths += cut
        owner += [i] * len(cut)
    size = len(names)
    model = Model(names, np.zeros((SLOTS, size), np.float32), np.zeros((size, size)), np.zeros(size))
    if not lengths:
        return model
    lengths, y = np.array(lengths), np.array([names.index(labels[i]) for i in owner])
    lay, grams = Layout(lengths), Grams(words)
    truth, word = np.eye(size)[y[lay.sequence]], codes[lay.source]
    seen_moves, seen_start = np.diag(np.bincount(y, np.maximum(lengths - 1, 0), size)), np.bincount(y, minlength=size)
    total, memory = len(word), [0.0, 0.0, 0.0]
    params = [model.weights.astype(np.float64), model.moves, model.start]
    for _ in range(STEPS):
        p, expected, _ = forward_backward(lay, grams.sums(params[0])[word], params[1], params[2])
        gap = p - truth
        per_word = np.stack([np.bincount(word, gap[:, c], len(words)) for c in range(size)], 1)
        slopes = [grams.spread(per_word) / total + DECAY * params[0], (expected - seen_moves) / total, (p[: lay.active[0]].sum(0) - seen_start) / total]
        for k, g in enumerate(slopes):
            memory[k] = memory[k] + g * g
            params[k] = params[k] - RATE * g / (np.sqrt(memory[k]) + 1e-12)
    return Model(names, params[0].astype(np.float32), params[1], params[2])


def predict(model: Model | None, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
    """Language, its share of letters by word probabilities, words, and switches of language between words."""
    words, codes, counts = words_of(texts)
    out = [(UNKNOWN, 0.0, int(n), 0) for n in counts]
    if model is None or not words:
        return out
    lay, size = Layout(counts), len(model.labels)
    p, _, _ = forward_backward(lay, Grams(words).sums(model.weights)[codes[lay.source]], model.moves, model.start)
    letters = np.array([len(w) for w in words], float)[codes[lay.source]]
    mass = np.stack([np.bincount(lay.sequence, p[:, c] * letters, len(texts)) for c in range(size)], 1)
    best = np.empty(len(codes), np.int64)
    best[lay.source] = p.argmax(1)
    first = np.zeros(len(codes), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    switched = np.concatenate([[False], best[1:] != best[:-1]]) & ~first
    switches = np.bincount(np.repeat(np.arange(len(texts)), counts), switched, len(texts)).astype(int)
    for i in np.flatnonzero(counts):
        k = int(mass[i].argmax())
        out[i] = (model.labels[k], float(min(1.0, mass[i, k] / mass[i].sum())), int(counts[i]), int(switches[i]))
    return out


def _predicted(model, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part in pieces(pdf):
            got = pd.DataFrame(predict(model.value, list(part.text)), columns=["lang_pred", "score", "n_words", "n_switches"])
            got.insert(0, "doc_id", part.doc_id.to_numpy())
            yield got


HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, true)"


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled documents that are not held out: the first in the order of a hash of doc_id."""
    named = only(docs, "doc_id", "text", "lang").filter(f"text is not null and lang is not null and not {HELD_OUT}")
    chosen = named.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the ids alone are sorted; at most ``sample`` of them are broadcast to fetch the texts
    one = F.min(F.struct("text", "lang")).alias("r")  # one text an id, however many rows share it
    rows = named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text, r.lang))
    return fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words, n_switches of every row of ``docs`` (doc_id, text).

    A text that is null, empty or without letters is ``und`` with score 0, as is every text without a fitted model.
    Repeated rows are each predicted; columns of any other name are not read; very long texts are read whole; of languages
    with equal shares the first by name is given; an empty table gives no row. held_out is true where crc32(doc_id as text) mod 4 is
    2 or there is no doc_id.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SLOTS and the number of languages
    found = only(docs, "doc_id", "text").mapInPandas(functools.partial(_predicted, shared), "doc_id long, lang_pred string, score double, n_words long, n_switches long")
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def accepted(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a share of at least ``least`` of the letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pieces(pdf):
                ok = [lang != UNKNOWN and score >= least for lang, score, _, _ in predict(shared.value, list(part.text))]
                yield part[np.array(ok, bool)]

    return docs.mapInPandas(keep, docs.schema)
