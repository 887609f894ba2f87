import base64
import bz2
import gzip
import hashlib
import lzma
import re
import struct
import zlib

from tessera.llm import secrets

AKIA = "AKIA" + "B7" * 8
KEY = f"password = '{'s3cr3t' * 2}'"


def brute(text):
    text = text or ""
    found = []
    for kind, p in enumerate((r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+")):
        for m in re.finditer(p, text, re.A):
            if (kind == 0 and len(m[1]) >= 6) or (kind == 1 and len(m[0]) >= 20) or (kind == 2 and len(m[0]) >= 24):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


TEXTS = [
    None, "", "no secret", KEY, f"é{KEY} and {AKIA}, {'0a' * 12}!", "token=abc", "API_KEY: \"abcdef\" ſecret=abcdefgh", f"{'AKIA'}SHORT {'f' * 23} {'f' * 24}g", "secret=secret=abcdefgh",
    "x" * 200_000 + KEY, "passwd:  'a.b_c-d=' token\t= abcdef",
]


def test_base_matches_equal_plain_patterns():
    for t in TEXTS:
        assert secrets.scan(t)[0] == brute(t), t


def spans(text):
    base, every, _ = secrets.scan(text)
    return [(text[a:b], secrets.KINDS[k]) for a, k, b in every if (a, k, b) not in base]


def test_nested_layers_are_found_and_mapped():
    inner = base64.b64encode(KEY.encode()).decode()
    assert spans(f"see {inner} here") and all(s in inner for s, _ in spans(f"see {inner} here"))
    url = "".join(f"%{b:02x}" for b in KEY.encode())
    assert spans(f"a {url} b") == [(url[: 3 * KEY.rindex("'")], "assign")]
    uni = "".join(f"\\u{ord(c):04x}" for c in AKIA)
    assert spans(f"a {uni} b") == [(uni, "access")]
    packed = base64.b64encode(gzip.compress(f"the {KEY}".encode())).decode().rstrip("=")
    assert spans(f"a {packed} b")[0][0].rstrip("=") == packed
    twice = base64.b64encode(f"x {base64.b64encode(zlib.compress(url.encode())).decode()} y".encode()).decode()
    assert [k for _, k in spans(f"a {twice} b")] == ["assign"]


def test_cycles_and_broken_layers_end():
    for t in ("%25" * 100, "%2525252541", "%" * 50, "\\u00", "A" * 5000, "H4sIAAAAAAAA" * 20, base64.b64encode(b"\x1f\x8b" + b"0" * 60).decode()):
        secrets.scan(t)


def test_query_rows(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, KEY, "x", 1), (None, KEY, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int")
    got = secrets.scan_documents(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            base = brute(TEXTS[r.doc_id])
            joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
            assert set(joined.split(",")) <= set(r.spans.split(","))
    assert secrets.scan_documents(df.limit(0)).collect() == []


def test_masking_takes_every_secret_out():
    t = f"keep {KEY} and {base64.b64encode(KEY.encode()).decode()} {AKIA} end"
    m = secrets.mask(t)
    assert m.startswith("keep [SECRET]") and m.endswith(" end") and not secrets.scan(m)[1]
    assert secrets.mask(None) is None and secrets.mask("plain") == "plain"


def coded(raw):
    return base64.b64encode(raw).decode()


def test_a_gzip_that_unpacks_to_itself_ends(monkeypatch):
    real = secrets._stream

    def stream(raw, rest):
        if raw[:4] != b"\x1f\x8b\x08Q":
            yield from real(raw, rest)
        else:
            yield raw
            rest.append(b"")

    monkeypatch.setattr(secrets, "_stream", stream)
    assert secrets.scan(coded(b"\x1f\x8b\x08Q" + bytes(60)))[1] == []


def test_layers_of_many_windows_are_read_to_their_end(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 10_000)
    monkeypatch.setattr(secrets, "SHARED", 1_000)
    for at in (0, 9_990, 25_000, 39_000):
        body = b"." * at + f" {KEY} ".encode() + b"." * (40_000 - at)
        for raw in (gzip.compress(body), zlib.compress(zlib.compress(body)), bz2.compress(body) + gzip.compress(b"tail"), gzip.compress(coded(gzip.compress(f" {KEY}".encode())).encode() + body[:at])):
            assert [k for _, k in spans(f"a {coded(raw)} b")] == ["assign"], at
    assert spans(f"a {coded(gzip.compress(bytes(30_000)) + f' {KEY}'.encode())} b")


def test_a_bomb_is_read_in_windows():
    body = bytes(20_000_000) + f" {KEY}".encode()
    assert [k for _, k in spans(coded(zlib.compress(body)))] == ["assign"]


def test_escapes_within_escapes_take_linear_time():
    import time

    for text in ("%" + "25" * 300_000 + "41", "%25" * 200_000, "\\u0025" * 50_000 + "41", "%5Cu0025" * 50_000):
        began = time.time()
        secrets.scan(text)
        assert time.time() - began < 20
    deep = "".join(f"%{ord(c):02x}" for c in KEY)
    for _ in range(30):
        deep = deep.replace("%", "%25")
    assert [k for _, k in spans(deep)] == ["assign"]


def test_base64_behind_a_name():
    for joint in ("key_", "x-y-", "id_"):
        assert "assign" in [k for _, k in spans(f"a {joint}{coded(KEY.encode())} b")]


def test_every_member_and_what_follows_is_read():
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        for body in (pack(b"nothing") + pack(KEY.encode()), pack(KEY[:8].encode()) + pack(KEY[8:].encode()), pack(b"nothing") + f" {KEY}".encode(), pack(pack(b"a") + pack(KEY.encode()))):
            assert [k for _, k in spans(f"a {coded(body)} b")] == ["assign"]
    assert spans("a " + coded(bz2.compress(bytes(100_000)) + gzip.compress(b"x" * 300_000 + f" {AKIA}".encode())))


def test_base64_over_lines():
    for nl in ("\n", "\r\n", "\n    ", "\\n"):
        for raw in (b"x" * 50 + KEY.encode(), gzip.compress(bytes(range(256)) * 2 + f" {KEY}".encode(), 0)):
            body = coded(raw)
            text = "key: " + nl.join(body[i : i + 76] for i in range(0, len(body), 76)) + "\nThe end"
            assert "assign" in [k for _, k in spans(text)]
            assert secrets.mask(text).startswith("key: ") and secrets.mask(text).endswith("\nThe end")
    # the span of a secret across two lines
    body = coded(b"x" * 50 + AKIA.encode())
    text = f"{body[:76]}\n{body[76:]} b"
    (a, kind, b), = secrets.scan(text)[1]
    assert (kind, a, b) == (1, 64, len(text) - 2)


def test_layers_that_are_not_plain_text_are_scanned():
    for raw in (b"\0\1".join([b"\xff\xfe", KEY.encode(), bytes(90)]), KEY.encode("utf-16"), KEY.encode("utf-16-be"), KEY.encode("utf-32"), struct.pack("<9d", *range(9)) + KEY.encode()):
        assert [k for _, k in spans(f"a {coded(raw)} b")] == ["assign"], raw


def test_the_same_layer_twice_is_found_twice():
    assert len(spans(f"{coded(KEY.encode())} and {coded(KEY.encode())}")) == 2


def test_url_unicode_escapes_and_named_references():
    for text in ("%u0070assword=abc123def", "password&nbsp;=&quot;abc123def&quot;", "password&#160;&equals;&apos;abc123def", "secret&colon;abc123def", "api&lowbar;key=abc123def", "%u0070%u0061ss%77ord&equals;abc123def"):
        assert [k for _, k in spans(text)] == ["assign"], text
    (a, _, b), = secrets.scan("a password&nbsp;=&quot;abc123def&quot; b")[1]
    assert (a, b) == (2, 32)
    deep = "password&equals;abc123def"
    for _ in range(12):
        deep = deep.replace("&", "&amp;")
    assert [k for _, k in spans(deep)] == ["assign"]
    assert spans("password &unknown; abc123def &amp; &; %u00 %uzzzz") == []
