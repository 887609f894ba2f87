"""SentencePiece encoding and decoding with shared-prefix dynamic programming.

A text with white space marked falls into words that no piece crosses. The distinct words of a batch are sorted, so that
the words below one node of their trie follow each other; they are walked depth first, and the forward table of the
prefix that a word shares with the one before it is kept. The table holds, for each prefix, the score of its best path and that
path's last piece (Viterbi). In a unigram model a path scores the sum of its pieces' scores. In a merge model a step from
one piece to the next scores 0 if merging leaves the two side by side and minus infinity if it joins or parts them; only
the path that merging itself takes keeps a finite score, so the table needs no numbers, and its last pieces give the ids
of the model's own encoder.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import only

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Characters of text that are encoded together; words that a task remembers between batches, and pairs of pieces, which are
#: fewer and cost more to find again: more take more memory and spare work.
BATCH_CHARS, REMEMBERED, PAIRS = 300_000, 500_000, 300_000
UNKNOWN_PENALTY = 10.0


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = b[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, b[at : at + n]
        at += n


class Known(dict):
    """Words with a number each, in the order they came, and their ids one after the other; a new word gets its number when asked for."""

    def __init__(self):
        super().__init__()
        self.ids, self.sizes, self.uses = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def add(self, found: dict[str, tuple[int, ...]]) -> None:
        """The ids of the words that came since the last call, in any order."""
        new = [found[w] for w in itertools.islice(self, len(self.sizes), None)]
        sizes = np.array([len(x) for x in new], np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(new), np.int32, int(sizes.sum()))
        self.ids, self.sizes, self.uses = np.append(self.ids, ids), np.append(self.sizes, sizes), np.append(self.uses, np.zeros(len(new), np.int64))

    def keep(self, wanted: np.ndarray) -> None:
        words = [w for w, ok in zip(self, wanted.tolist(), strict=True) if ok]
        self.ids, self.sizes, self.uses = self.ids[np.repeat(wanted, self.sizes)], self.sizes[wanted], np.zeros(int(wanted.sum()), np.int64)
        self.clear()
        self.update(zip(words, range(len(words)), strict=True))


class Model:
    """Pieces of a SentencePiece model file whose normaliser is the identity."""

    def __init__(self, proto: bytes, model_type: int | None = None, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.pieces, self.scores, kinds, trainer, norm = [], [], [], {}, {}
        for number, value in _fields(proto):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(f.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.type = model_type or trainer.get(3, UNIGRAM)
        if self.type not in (UNIGRAM, BPE) or norm.get(2) or norm.get(4, 1) or trainer.get(24, 0):
            raise ValueError("only unigram and merge models without normalisation are supported")
        self.prefix = bool(norm.get(3, 1))
        self.unknown = kinds.index(2)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 6}
        self.fallback = bool(trainer.get(35, 0)) and len(self.bytes) == 256
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (1, 4)}
        self._suffixes()
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses words")
        alone = "" if any("\n" in p for p in self.ids) else "\n"
        self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + ("|\n" if alone else ""))
        self.raw = [p.replace(MARK, " ").encode() if k in (1, 4) else bytes([int(p[3:5], 16)]) if k == 6 else b" \xe2\x81\x87 " if k == 2 else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        self._neighbours: dict[int, bool] = {}
        self._halves: dict[int, tuple[int | None, int | None]] = {}
        self.alike = Counter(self.scores[i] for p, i in self.ids.items() if len(p) > 1)
        self._whole: dict[int, bool] = {}
        self._possible: list[tuple[tuple[int, int], ...] | None] = [None] * len(self.ends)
        self.known = Known()

    def _suffixes(self) -> None:
        """An automaton over the pieces: each state knows the pieces that end there, longest first.

        A move's key is the state and the character in one number, which takes far less room than a table for each state."""
        moves: dict[int, int] = {}
        own, above, level, order = [-1], [(0, 0)], [0], []
        for text, piece in self.ids.items():
            at = 0
            for c in text:
                key = at << 21 | ord(c)
                to = moves.get(key)
                if to is None:
                    to = moves[key] = len(own)
                    own.append(-1)
                    above.append((at, ord(c)))
                    level.append(level[at] + 1)
                at = to
            own[at] = piece
        self._moves, self._fail = moves, [0] * len(own)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        order = np.argsort(np.array(level), kind="stable").tolist()
        for at in order[1:]:
            up, c = above[at]
            self._fail[at] = back = self.move(self._fail[up], c) if up else 0
            self.ends[at] = (((own[at], len(self.pieces[own[at]])),) if own[at] >= 0 else ()) + self.ends[back]

    def move(self, state: int, c: int) -> int:
        """The state after one more character: along the trie, or from the longest suffix that has such a move."""
        moves, key = self._moves, state << 21 | c
        while (to := moves.get(state << 21 | c)) is None and state:
            state = self._fail[state]
        if len(moves) < len(self._fail) + self.remembered // 2:
            moves[key] = to or 0
        return to or 0

    def merged(self, text: str, apart: int = 0, most: int = 1) -> list[str] | None:
        """The text's pieces by merging the best-scored neighbours, leftmost first, until there are ``most``; None if that joins
        what lies on both sides of the place ``apart``."""
        parts, ids, scores = list(text), self.ids, self.scores
        found = [ids.get(a + b) for a, b in itertools.pairwise(parts)]
        worth = [None if i is None else scores[i] for i in found]
        while True:
            best, at = None, -1
            for i, score in enumerate(worth):
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None or len(parts) <= most:
                return parts
            if apart and sum(map(len, parts[: at + 1])) == apart:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del worth[at]
            for i in (at - 1, at):
                if 0 <= i < len(worth):
                    piece = ids.get(parts[i] + parts[i + 1])
                    worth[i] = None if piece is None else scores[piece]

    def whole(self, piece: int) -> bool:
        if (got := self._whole.get(piece)) is None:
            got = self._whole[piece] = self.merged(self.pieces[piece]) == [self.pieces[piece]]
        return got

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters gives the two pieces."""
        if (got := self._neighbours.get(left << 32 | right)) is None:
            if len(self._neighbours) >= PAIRS:
                self._neighbours.clear()
            got = self._neighbours[left << 32 | right] = self.apart(left, right)
        return got

    def half(self, piece: int, side: int) -> int | None:
        """The left (0) or right (1) piece of the last merge that makes a piece; None if that merge's time can't be told from
        scores: another piece has the same score, or a half a worse one."""
        if (got := self._halves.get(piece)) is None:
            two = self.merged(self.pieces[piece], most=2)
            halves = [self.ids.get(x) for x in two]
            plain = len(two) == 2 and None not in halves and self.alike[self.scores[piece]] == 1
            plain = plain and all(len(x) == 1 or self.scores[i] > self.scores[piece] for x, i in zip(two, halves, strict=True))
            got = self._halves[piece] = tuple(halves) if plain else (None, None)
        return got[side]

    def apart(self, left: int, right: int) -> bool:
        """Whether the two pieces' characters merge to the two pieces: back in time, of the two pieces at the boundary the one
        merged last is halved, and a merge over the boundary must not come before it (of equal ones the leftmost is first)."""
        pieces, ids, scores, a, b, after, tie = self.pieces, self.ids, self.scores, left, right, -math.inf, False
        while True:
            over = ids.get(pieces[a] + pieces[b])
            if over is not None and (scores[over] > after or tie and scores[over] == after):
                return False
            one, other = (-math.inf if len(pieces[x]) == 1 else -scores[x] for x in (a, b))
            if one == other == -math.inf:
                return True
            tie = one <= other
            part = self.half(b, 0) if tie else self.half(a, 1)
            if part is None:
                whole = pieces[left]
                return self.merged(whole + pieces[right], len(whole)) is not None
            a, b, after = (a, part, -other) if tie else (part, b, -one)

    def char(self, c: str) -> tuple[int, ...]:
        """The ids of a character that is no piece."""
        return tuple(self.bytes[b] for b in c.encode()) if self.fallback else (self.unknown,)

    def possible(self, state: int) -> tuple[tuple[int, int], ...]:
        """The pieces (and their lengths) that may end at a state, longest first; of merges only those that merging yields."""
        found = self.ends[state]
        if self.type == BPE:
            found = tuple(x for x in found if self.whole(x[0]))
        self._possible[state] = found
        return found

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each distinct word: a depth-first walk of the trie of the sorted words.

        For the first i characters of a word ``last[i]`` is the last piece of the best path (negative: the beginning or an
        unknown character), ``path[i]`` its ids, ``score[i]`` its score and ``states[i]`` the automaton's state.
        """
        moves, possible, allowed, scores, bpe, least = self._moves, self._possible, self._neighbours, self.scores, self.type == BPE, self.least
        last, path, score, states = [-1], [()], [0.0], [0]
        before, out = "", {}
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], path[shared + 1 :], score[shared + 1 :], states[shared + 1 :]
            state = states[-1]
            for end in range(shared + 1, len(word) + 1):
                c = ord(word[end - 1])
                to = moves.get(state << 21 | c)
                state = self.move(state, c) if to is None else to
                ends = possible[state]
                if ends is None:
                    ends = self.possible(state)
                piece, length = -1, 1
                if bpe:
                    for got, n in ends:
                        left = last[end - n]
                        if left >= 0:  # after an unknown character any piece may stand
                            fits = allowed.get(left << 32 | got)
                            if not (self.neighbours(left, got) if fits is None else fits):
                                continue
                        piece, length = got, n
                        break
                else:
                    best = score[end - 1] + least
                    for got, n in ends:
                        if (s := score[end - n] + scores[got]) > best:
                            piece, length, best = got, n, s
                    score.append(best)
                last.append(piece)
                path.append(path[end - length] + ((piece,) if piece >= 0 else self.char(chr(c))))
                states.append(state)
            out[word] = path[-1]
            before = word
        return out

    def marked(self, texts: list[str]) -> list[list[str]]:
        """The marked words of each text."""
        return [self.words.findall((MARK if self.prefix and t else "") + t.replace(" ", MARK)) for t in texts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; distinct words are encoded once and then dealt out by their place in the texts."""
        marked = self.marked(texts)
        counts = np.array([len(w) for w in marked], np.int64)
        flat = list(itertools.chain.from_iterable(marked))
        if len(self.known) > self.remembered:
            self.known.keep(self.known.uses > 2)
        before = len(self.known)
        codes = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        if len(self.known) > before:
            self.known.add(self.encode_words(list(self.known)[before:]))
        self.known.uses += np.bincount(codes, minlength=len(self.known))
        each = self.known.sizes[codes]
        upto = np.cumsum(each)
        # the first id of each word among the known ones, less where the word begins in the output
        shift = np.repeat((np.cumsum(self.known.sizes) - self.known.sizes)[codes] - (upto - each), each)
        ids = self.known.ids[shift + np.arange(len(shift))]
        return np.split(ids, np.concatenate([[0], upto])[np.cumsum(counts)[:-1]]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _encoded(proto, model_type: int | None, remembered: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # the model lives as long as its task: a worker goes on to other work without it
    model = Model(proto.value, model_type, remembered)
    for pdf in batches:
        lengths = pdf.text.str.len().fillna(0).to_numpy(float)
        for _, part in pdf.groupby((np.cumsum(lengths) // BATCH_CHARS).astype(int), sort=True):
            texts = [t or "" for t in part.text]
            ids = model.encode(texts)
            yield pd.DataFrame(
                {
                    "doc_id": part.doc_id.to_numpy(),
                    "n_tokens": [len(x) for x in ids],
                    "ids": ids,
                    "ids_sha256": [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids],
                    "decodes": [model.decode(x) == t for x, t in zip(ids, texts, strict=True)],
                }
            )


def _decoded(proto, model_type: int | None, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    model = Model(proto.value, model_type)
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf.doc_id.to_numpy(), "text": [None if x is None else model.decode(np.asarray(x)) for x in pdf.ids]})


def _file(spark: SparkSession, path: str):
    """The model file's bytes, on every executor; a vocabulary's size does not depend on the input."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, model_path: str, model_type: int | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 (of the ids as little-endian 32-bit integers) and decodes, for every row.

    ``model_type`` overrides the kind that the file names (1 unigram, 2 merges); ``remembered`` bounds the memory of a task
    and changes no result. A null or empty text has no ids. ``decodes`` says whether the ids give back the text; only a text
    that holds the mark character itself may not. Repeated rows are each encoded; other columns are not read; a very long
    text is encoded whole; an empty table gives no row.
    """
    proto = _file(docs.sparkSession, model_path)
    return only(docs, "doc_id", "text").mapInPandas(functools.partial(_encoded, proto, model_type, remembered), "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decodes boolean")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); null ids give a null text."""
    proto = _file(encoded.sparkSession, model_path)
    return only(encoded, "doc_id", "ids").mapInPandas(functools.partial(_decoded, proto, None), "doc_id long, text string")


def default_model() -> str:
    """The public 32,000-piece model of this machine's tokenizer folder."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
