"""Secret scan with a recursive decoding worklist.

Three fixed patterns are matched over every whole text. Then each layer of a text is unwrapped - URL escapes and Unicode
escapes and wide characters in place, base64 runs (of one line or of several) and what is compressed inside them as layers
of their own - and each new layer is scanned and unwrapped in turn until none is new. A layer's characters know the span of
the text that they came from, so matches inside layers are reported as spans of the text. A layer already seen at the same
span is not opened again, which ends cycles; the same layer at another place of the text is.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import only

# The patterns and their least lengths.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")

URL_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: References by name to the characters that the patterns can use, those of HTML; a space that doesn't break counts as one.
NAMED = {name[:-1]: c for name, c in html5.items() if name.endswith(";") and len(c) == 1 and c < "\x7f"} | {"nbsp": " ", "NonBreakingSpace": " "}
NAME = "|".join(sorted(NAMED, key=lambda n: (-len(n), n)))
CODE = r"[\\%]u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});" + f"|&({NAME});"
ONE_ESCAPE = re.compile(CODE)
UNICODE_ESCAPE = re.compile(f"(?:{re.sub(r'[(](?=[^?])', '(?:', CODE)})+")
#: An escape that ends here, the characters that may end one, and the most that one has.
LAST_ESCAPE = re.compile(rf"(?:{CODE}|%([0-9A-Fa-f]{{2}}))\Z")
ENDS_ESCAPE = frozenset("0123456789abcdefABCDEF;")
LONGEST = max(10, 2 + max(map(len, NAMED)))


def _code(m: re.Match) -> int:
    """The character that an escape stands for."""
    if m[6]:
        return ord(NAMED[m[6]])
    code = int(m[5], 10) if m[5] else int(next(g for g in m.groups() if g), 16)
    return 0x20 if code == 0xA0 else code


BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
PART = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")
#: Base64 broken into lines (line breaks as such or as written in strings); the last line may be short.
BREAK = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*")
LINES = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}+(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
#: Characters of UTF-16 or UTF-32, as far as the patterns can use them, read as bytes.
WIDE = re.compile(r"(?:[\t\n\r\x20-\x7e]\x00{3}){4,}|(?:\x00{3}[\t\n\r\x20-\x7e]){4,}|(?:[\t\n\r\x20-\x7e]\x00){4,}|(?:\x00[\t\n\r\x20-\x7e]){4,}")
#: What is compressed is read in windows of so many bytes, each of which begins with the last bytes of the one before. All
#: matches in it have the span of what holds it, so a match of any length that a window cuts is still found.
WINDOW, SHARED = 1 << 24, 1 << 20
#: Escapes within escapes: so many layers are scanned one by one, what is deeper is unwrapped to its end in one pass.
DEPTH = 8


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the base patterns, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _opener(raw: bytes):
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] == 0x78 and (raw[0] * 256 + raw[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _stream(raw: bytes, rest: list[bytes]) -> Iterator[bytes]:
    """What the compressed members of a block hold, part by part; what follows them, or the first broken one, goes to ``rest``.

    Of a broken member what can be read before the break is given too."""
    while (d := _opener(raw)) is not None:
        at = 0
        try:
            while at < len(raw) and not d.eof:
                piece = raw[at : at + 65_536]
                at += len(piece)
                while True:
                    if got := d.decompress(piece, SHARED):
                        yield got
                    piece = getattr(d, "unconsumed_tail", b"")
                    if d.eof or not piece and (not got or getattr(d, "needs_input", False)):
                        break
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            break
        if not d.eof:
            break
        raw = (d.unused_data + raw[at:]).lstrip(b"\0")  # members may be padded
    rest.append(raw)


def _windows(raw: bytes, rest: list[bytes]) -> Iterator[bytes]:
    held = bytearray()
    fresh = False
    for part in _stream(raw, rest):
        held += part
        fresh = True
        if len(held) >= WINDOW:
            yield bytes(held)
            del held[: len(held) - SHARED]
            fresh = False
    if fresh:
        yield bytes(held)


def _as_text(raw: bytes) -> tuple[str, np.ndarray]:
    """Bytes as UTF-8, else one character for each byte; the place of each character's first byte, and the end."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1"), np.arange(len(raw) + 1)
    return text, np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))


def _in_place(text: str, pattern: re.Pattern, decode) -> tuple[str, np.ndarray, np.ndarray, np.ndarray] | None:
    """The text with its escapes decoded; each character's start and end in ``text``, and whether it was decoded."""
    parts, starts, ends, fresh, at = [], [], [], [], 0
    for m in pattern.finditer(text):
        got = decode(m[0])
        if got is None:
            continue
        plain = np.arange(at, m.start())
        parts += [text[at : m.start()], "".join(c for c, _, _ in got)]
        starts += [plain, np.array([m.start() + a for _, a, _ in got], np.int64)]
        ends += [plain + 1, np.array([m.start() + b for _, _, b in got], np.int64)]
        fresh += [np.zeros(len(plain), bool), np.ones(len(got), bool)]
        at = m.end()
    if not at:
        return None
    plain = np.arange(at, len(text))
    parts.append(text[at:])
    return "".join(parts), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1]), np.concatenate([*fresh, np.zeros(len(plain), bool)])


def _spread(raw: bytes, width: int, start: int = 0) -> list[tuple[str, int, int]] | None:
    """Characters of UTF-8 bytes, each of which was written with ``width`` characters."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return [(c, start + i * width, start + (i + 1) * width) for i, c in enumerate(text)]
    out, at = [], 0
    for c in text:
        n = len(c.encode("utf-8"))
        out.append((c, start + at * width, start + (at + n) * width))
        at += n
    return out


def _url(run: str) -> list[tuple[str, int, int]] | None:
    return _spread(bytes.fromhex(run.replace("%", "")), 3)


def _unicode(run: str) -> list[tuple[str, int, int]] | None:
    out = []
    for m in ONE_ESCAPE.finditer(run):
        code = _code(m)
        if out and 0xDC00 <= code < 0xE000 and len(out[-1][0]) == 1 and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, a, _ = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), a, m.end()))
        else:
            out.append((chr(code) if code < 0x110000 else "�", m.start(), m.end()))
    return out or None


def _deepest(text: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray] | None:
    """As _in_place, for URL and Unicode escapes however deep: each decoded character may end an escape in turn.

    Bytes beyond ASCII become one character each, which no pattern asks for."""
    chars, starts, ends, fresh, some = [], [], [], [], False
    for i, c in enumerate(text):
        chars.append(c)
        starts.append(i)
        ends.append(i + 1)
        fresh.append(False)
        while chars[-1] in ENDS_ESCAPE and (m := LAST_ESCAPE.search("".join(chars[-LONGEST:]))):
            n = len(m[0])
            code = _code(m)
            first, last = starts[-n], ends[-1]
            del chars[-n:], starts[-n:], ends[-n:], fresh[-n:]
            chars.append(chr(code) if code < 0x110000 else "\ufffd")
            starts.append(first)
            ends.append(last)
            fresh.append(True)
            some = True
    return ("".join(chars), np.array(starts, np.int64), np.array(ends, np.int64), np.array(fresh, bool)) if some else None


def _wide(run: str) -> list[tuple[str, int, int]] | None:
    held = [i for i, c in enumerate(run) if c != "\0"]
    width = len(run) // len(held)
    return [(run[i], k * width, (k + 1) * width) for k, i in enumerate(held)]


def _pieces(text: str) -> Iterator[list[tuple[int, int]]]:
    """Spans whose characters, joined, may be base64: each run alone, and runs that line breaks part.

    Of lines that follow each other all together are tried, all but the first (which may end something else), and each
    block of lines of one length with the shorter line that ends it."""
    for m in BASE64.finditer(text):
        yield [m.span()]
        # a name and a joint before the run itself: the joint is base64 too, of the other alphabet
        if len(parts := PART.findall(m[0])) and parts != [m[0]]:
            yield from ([(m.start() + p.start(), m.start() + p.end())] for p in PART.finditer(m[0]))
    for m in LINES.finditer(text):
        cuts = [m.start(), *(m.start() + x for b in BREAK.finditer(m[0]) for x in b.span()), m.end()]
        lines = list(zip(cuts[::2], cuts[1::2], strict=True))
        n, sizes = len(lines), [b - a for a, b in lines]
        tried = {(0, n), (1, n)}
        i = 0
        while i < n:
            j = i + 1
            while j < n and sizes[j] == sizes[i]:
                j += 1
            j += j < n and sizes[j] < sizes[i]
            tried.add((i, j))
            i = j
        yield from (lines[i:j] for i, j in sorted(tried) if j - i > 1)


def _runs(text: str) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Bytes of base64 runs, and the start and end in ``text`` of the characters that hold each byte."""
    for spans in _pieces(text):
        body = "".join(text[a:b] for a, b in spans).rstrip("=").replace("-", "+").replace("_", "/")
        body = body[: len(body) - (len(body) % 4 == 1)]
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            continue
        if not raw:
            continue
        places = np.concatenate([np.arange(a, b) for a, b in spans])
        byte = np.arange(len(raw)) // 3 * 4  # three bytes in four characters
        yield raw, places[byte], places[np.minimum(byte + 4, len(places)) - 1] + 1


def _at(places: np.ndarray, index: np.ndarray) -> np.ndarray:
    """``places[index]``; places that are all one, as those of compressed layers, stay one number."""
    return np.broadcast_to(places[0], len(index)) if len(places) and places.strides == (0,) else places[index]


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base matches, all matches (start, kind, end), layers opened."""
    text = text or ""
    base = matches(text)
    spans, seen, opened = set(base), set(), 0
    work: list[tuple[str, np.ndarray | None, np.ndarray | None, int]] = [(text, None, None, 0)]  # None: the text itself

    def push(layer: str, starts: np.ndarray, ends: np.ndarray, fresh: np.ndarray | None, depth: int) -> None:
        nonlocal opened
        if not layer:
            return
        key = (hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest(), int(starts.min()), int(ends.max()))
        if key in seen or layer == text:
            return
        seen.add(key)
        opened += 1
        for a, kind, b in matches(layer):
            if fresh is None or fresh[a:b].any():
                spans.add((int(starts[a:b].min()), kind, int(ends[a:b].max())))
        work.append((layer, starts, ends, depth))

    def unwrap(layer: str, starts: np.ndarray | None, ends: np.ndarray | None, depth: int) -> None:
        escapes = ("%", lambda t: _in_place(t, URL_ESCAPE, _url)), ("\\&%", lambda t: _in_place(t, UNICODE_ESCAPE, _unicode))
        if depth >= DEPTH:
            escapes = (("%\\&", _deepest),)
        for marks, decoded in (*escapes, ("\0", lambda t: _in_place(t, WIDE, _wide))):
            if any(c in layer for c in marks) and (got := decoded(layer)):
                new, a, b, fresh = got
                push(new, a if starts is None else _at(starts, a), b if ends is None else _at(ends, b - 1), fresh, depth + 1)

    while work:
        layer, starts, ends, depth = work.pop()
        unwrap(layer, starts, ends, depth)
        for raw, a, b in _runs(layer):
            packed = [(raw, a if starts is None else _at(starts, a), b if ends is None else _at(ends, b - 1))]
            while packed:
                raw, a, b = packed.pop()
                if not raw:
                    continue
                lo, hi = int(a.min()), int(b.max())
                if _opener(raw) is None:
                    new, at = _as_text(raw)
                    push(new, _at(a, at[:-1]), _at(b, at[1:] - 1), None, 0)
                    continue
                key = ("bytes", hashlib.sha256(raw).digest(), lo, hi)
                if key in seen:
                    continue
                seen.add(key)
                rest: list[bytes] = []
                windows = _windows(raw, rest)
                first, second = next(windows, None), next(windows, None)
                if second is None:
                    inside = b[: len(b) - len(rest[0])]
                    packed.append((first or b"", *_one_place(lo, int(inside.max()) if len(inside) else hi, len(first or b""))))
                else:  # one window at a time is held; what it holds is opened before the next
                    for window in itertools.chain((first, second), windows):
                        spans.update((lo, kind, hi) for kind in scan_layer(window))
                left = rest[0], a[len(a) - len(rest[0]) :], b[len(b) - len(rest[0]) :]
                if _opener(left[0]) is None:
                    packed.append(left)
                else:  # broken, or it only began like something compressed
                    new, at = _as_text(left[0])
                    push(new, _at(left[1], at[:-1]), _at(left[2], at[1:] - 1), None, 0)
    return base, sorted(spans), opened


def scan_layer(raw: bytes) -> set[int]:
    """The kinds of secrets in a window of what is compressed, its own layers included."""
    if _opener(raw) is not None:
        raw = base64.b64encode(raw)
    return {kind for _, kind, _ in scan(raw.decode("latin-1"))[1]}


def _one_place(lo: int, hi: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.broadcast_to(np.int64(lo), n), np.broadcast_to(np.int64(hi), n)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _report(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text in pdf.text:
            base, spans, layers = scan(text)
            counts = np.bincount([k for _, k, _ in base], minlength=3)
            rows.append((*map(int, counts), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), layers))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"])
        out.insert(0, "doc_id", pdf.doc_id.to_numpy())
        yield out


REPORT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every row: counts and digest of the base matches, and all spans with those found in layers.

    A null or empty text has no spans (digest of the empty string). Spans are in code points, end exclusive, ordered by
    start and kind; a secret in a compressed layer has the span of the run that holds it. Repeated rows are each
    reported; columns beside the two are not read; an empty table gives no row. n_layers counts the layers opened. Escapes
    nested deeper than DEPTH are unwrapped to their end at once. A very long text is taken whole; what unpacks to more
    than WINDOW bytes is read window by window.
    """
    named = only(docs, id_col, text_col).toDF("doc_id", "text")
    return named.mapInPandas(_report, REPORT)


def mask(text: str | None, word: str = "[SECRET]") -> str | None:
    """The text with every span of a secret, merged where they overlap, replaced by ``word``."""
    if not text:
        return text
    spans = scan(text)[1]
    if not spans:
        return text
    out, at, open_to = [], 0, -1
    for a, _, b in spans:
        if a >= open_to:
            out += [text[at:a] if a >= at else "", word]
        open_to = max(open_to, b)
        at = open_to
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def masked(texts: pd.Series) -> pd.Series:
    return texts.map(mask, na_action="ignore")
