"""Words of a batch of texts, each distinct one once, and hashed features of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd

from tessera.llm.common import mix64

LETTERS = re.compile(r"[^\W\d_]+")
#: Characters that count as parts of words there but are no letters: numerals such as fractions and Roman numbers.
NUMERAL = re.compile(r"[^\W\d_a-z]")
#: Hash slots of features, and characters of text that are handled together.
SLOTS, BATCH_CHARS = 1 << 18, 350_000


def pieces(pdf: pd.DataFrame, column: str = "text", chars: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """Parts of a batch with about so many characters; a longer text is a part of its own."""
    sizes = pdf[column].str.len().fillna(0).to_numpy(float)
    for _, part in pdf.groupby((np.cumsum(sizes) // chars).astype(int), sort=True):
        yield part


def letter_runs(text: str) -> list[str]:
    """Runs of letters; numerals that are no decimal digits part them as digits do."""
    if not text.isascii() and (numerals := {c for c in set(NUMERAL.findall(text)) if not c.isalpha()}):
        text = text.translate(dict.fromkeys(map(ord, numerals), " "))
    return LETTERS.findall(text)


def words_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct letter runs in lower case, the code of each word in order, and the number of words of each text."""
    found = [letter_runs(t.lower()) if t else [] for t in texts]
    counts = np.array([len(w) for w in found], np.int64)
    if not counts.sum():
        return [], np.empty(0, np.int64), counts
    codes, words = pd.factorize(np.array([w for ws in found for w in ws], dtype=object))
    return list(words), codes.astype(np.int64), counts


class Grams:
    """Hash slots of the character n-grams of words, with a mark at both ends: inner n-grams and affixes alike."""

    def __init__(self, words: list[str], sizes: tuple[int, ...] = (2, 3, 4)):
        lengths = np.array([len(w) + 2 for w in words], np.int64)
        chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.n, self.starts = len(words), np.cumsum(lengths) - lengths
        self.word = np.repeat(np.arange(len(words)), lengths)
        places = mix64(np.arange(101, 109, dtype=np.uint64)) | np.uint64(1)
        ends = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(chars))  # characters left in the word
        self.slots, self.valid = [], []
        for n in sizes:
            h = np.full(len(chars), np.uint64(n))
            with np.errstate(over="ignore"):
                for k in range(n):
                    h[: len(chars) - k] += chars[k:] * places[k]
            self.slots.append((mix64(h) & np.uint64(SLOTS - 1)).astype(np.int64))
            self.valid.append(ends >= n)
        # the whole word, as a lexicon entry
        whole = np.zeros(len(words), np.uint64)
        if len(words):
            with np.errstate(over="ignore"):
                powers = mix64(np.arange(len(chars), dtype=np.uint64) - np.repeat(self.starts, lengths).astype(np.uint64) + np.uint64(1000)) | np.uint64(1)
                whole = np.add.reduceat(chars * powers, self.starts)
        self.whole = (mix64(whole) & np.uint64(SLOTS - 1)).astype(np.int64)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """For each word the sum of its features' rows of ``weights``."""
        total = weights[self.whole].astype(np.float64)
        if self.n:
            for slots, valid in zip(self.slots, self.valid, strict=True):
                total += np.add.reduceat(weights[slots] * valid[:, None], self.starts, axis=0)
        return total

    def spread(self, rows: np.ndarray) -> np.ndarray:
        """The transpose of ``sums``: a row for each slot, summed over the words that have it."""
        out = np.empty((SLOTS, rows.shape[1]))
        for c in range(rows.shape[1]):
            out[:, c] = np.bincount(self.whole, rows[:, c], SLOTS)
            per = rows[:, c][self.word]
            for slots, valid in zip(self.slots, self.valid, strict=True):
                out[:, c] += np.bincount(slots[valid], per[valid], SLOTS)
        return out
