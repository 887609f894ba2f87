"""Severity of toxic text by cumulative-link ordinal regression on sparse features.

P(grade <= k) = sigmoid(cut_k - w.x): one weight vector is shared by all thresholds, which are kept in order. x counts
hashed features of the text's distinct words: the word itself and the character n-grams at its start. The result is the
expected grade.
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
from tessera.llm.features import pieces, words_of

#: Labelled documents to learn from (those first in a random order), passes, step, and the pull of weights to zero, which
#: a feature overcomes only if the residuals of its documents sum to that share of all documents.
SAMPLE, STEPS, RATE, SPARSE = 6000, 120, 0.5, 1e-3
#: Lengths of word starts that are features beside the whole word, and hash slots of features.
STARTS, SLOTS = (4, 5, 6, 7), 1 << 20


def _slots(words: list[str]) -> np.ndarray:
    """A row of hash slots for each word; a word shorter than a start repeats itself there."""
    kinds = [words] + [[f"^{w[:n]}" for w in words] for n in STARTS]
    return np.stack([pd.util.hash_array(np.array(k, dtype=object), categorize=False) % np.uint64(SLOTS) for k in kinds], 1).astype(np.int64)


def distinct_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the batch's words; and the (text, word) pairs, each once."""
    words, codes, counts = words_of(texts)
    if not words:
        return np.empty((0, 1 + len(STARTS)), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    pairs = np.unique(np.repeat(np.arange(len(texts)), counts) * len(words) + codes)
    return _slots(words), pairs // len(words), pairs % len(words)


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray
    grades: np.ndarray  # ascending

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        upto = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - score[:, None], -500, 500)))
        return np.diff(np.hstack([np.zeros((len(score), 1)), upto, np.ones((len(score), 1))]), axis=1)


def _sums(weights: np.ndarray, slots: np.ndarray, text: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights[slots].sum(1)[word], n)


def _in_parts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """distinct_words of a long list, made part by part to spare memory."""
    slots, text, word, done = [], [], [], 0
    for part in pieces(pd.DataFrame({"text": texts, "i": range(len(texts))})):
        s, t, w = distinct_words(list(part.text))
        slots.append(s.astype(np.int32))
        text.append(t + part.i.iloc[0])
        word.append(w + done)
        done += len(s)
    return np.concatenate(slots), np.concatenate(text), np.concatenate(word)


def fit(texts: list[str], grades: list[int]) -> Model | None:
    """Maximum likelihood with sparse weights, by adaptive proximal steps over the whole sample."""
    values = np.unique(grades)
    if not len(values):
        return None
    y, n, levels = np.searchsorted(values, grades), len(grades), len(values)
    slots, text, word = _in_parts(texts)
    share = np.cumsum(np.bincount(y, minlength=levels))[:-1] / n
    cuts = np.log(share / (1 - share))
    w, seen, rate = np.zeros(SLOTS), np.zeros(SLOTS), RATE
    first, gaps = cuts[:1].copy(), np.log(np.maximum(np.diff(cuts), 1e-3))
    shape_memory = np.zeros(levels - 1)
    rows = np.arange(n)
    for _ in range(STEPS if levels > 1 else 0):
        cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        score = _sums(w, slots, text, word, n)
        upto = 1 / (1 + np.exp(-np.clip(cuts[None, :] - score[:, None], -30, 30)))
        edge = np.hstack([np.zeros((n, 1)), upto, np.ones((n, 1))])
        slope = edge * (1 - edge)
        p = np.maximum(edge[rows, y + 1] - edge[rows, y], 1e-12)
        pull = (slope[rows, y + 1] - slope[rows, y]) / p  # of -log p by the score
        per_word = np.bincount(word, pull[text], len(slots))
        g = np.bincount(slots.ravel(), np.repeat(per_word, slots.shape[1]), SLOTS) / n
        seen += g * g
        size = rate / (np.sqrt(seen) + 1e-9)
        w -= size * g
        w = np.sign(w) * np.maximum(np.abs(w) - size * SPARSE, 0)
        by_cut = np.array([(np.where(y == k, slope[:, k + 1] / p, 0) - np.where(y == k + 1, slope[:, k + 1] / p, 0)).sum() for k in range(levels - 1)]) / n
        g = -np.concatenate([[by_cut.sum()], np.exp(gaps) * np.cumsum(by_cut[::-1])[::-1][1:]])
        shape_memory += g * g
        step = rate * g / (np.sqrt(shape_memory) + 1e-9)
        first, gaps = first - step[:1], gaps - step[1:]
    cuts = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
    return Model(w.astype(np.float32), cuts, values)


def predict(model: Model | None, texts: list[str | None]) -> np.ndarray:
    """Expected grade and probability of each grade above the lowest, a row for each text."""
    if model is None:
        return np.zeros((len(texts), 2))
    p = model.probabilities(_sums(model.weights, *distinct_words(texts), len(texts)))
    return np.hstack([p @ model.grades[:, None], 1 - p[:, :1]])


def _graded(model, least: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part in pieces(pdf):
            got = predict(model.value, list(part.text))
            yield pd.DataFrame({"doc_id": part.doc_id.to_numpy(), "severity": got[:, 0], "p_toxic": got[:, 1], "toxic": got[:, 1] >= least})


def learn(docs: DataFrame, labels: DataFrame, grade: str, sample: int = SAMPLE) -> Model | None:
    """Fit on at most ``sample`` labelled documents, the first in the order of a hash of doc_id.

    ``grade`` is an SQL expression over ``labels`` that gives a whole number, higher for worse; rows where it is null
    are not labelled.
    """
    named = labels.select("doc_id", F.expr(grade).cast("int").alias("grade")).filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = only(docs, "doc_id", "text").filter("text is not null")
    one = F.min("text").alias("text")  # one text an id, however many rows share it
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(one).select("doc_id", "text", "grade").collect()  # ``sample`` rows
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in rows], [r.grade for r in rows])


def grade_documents(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """doc_id, severity (the expected grade), p_toxic (probability of a grade above the lowest), toxic, for every row.

    ``toxic`` is p_toxic >= ``least``. A null or empty text has no features and gets what the thresholds alone give; a
    missing model (no labelled row) gives 0. Repeated rows are each graded; columns of any other name are not read; very
    long texts are read whole; an empty table gives no row. ``toxic`` holds at the bound itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SLOTS
    return only(docs, "doc_id", "text").mapInPandas(functools.partial(_graded, shared, least), "doc_id long, severity double, p_toxic double, toxic boolean")
