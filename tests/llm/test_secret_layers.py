"""Layers that are compressed, binary or large, and all secrets in one layer."""

import base64
import gzip
import json
import random
import urllib.parse
import zlib

from noticeweave.llm import secrets
from noticeweave.llm.secrets import scan

INNER = "password=hunter2hunter2"


def packed() -> bytes:
    draw = random.Random(8)
    return gzip.compress((" ".join(str(draw.random()) for _ in range(40)) + f" {INNER} ").encode(), mtime=0)


def test_streams_in_escapes():
    data = packed()
    thin = zlib.compress(f"a {INNER} b".encode())
    latin = data.decode("latin-1")
    cases = [(urllib.parse.quote(data), "url>compressed"), (urllib.parse.quote_plus(data), "url>compressed"), (urllib.parse.quote(thin), "url>compressed")]
    cases += [(repr(data)[2:-1], "unicode>compressed"), (json.dumps(latin)[1:-1], "unicode>compressed"), ("".join(f"&#{b};" for b in data), "unicode>compressed")]
    cases += [(urllib.parse.quote(urllib.parse.quote(data)), "url>url>compressed"), (base64.b64encode(urllib.parse.quote(data).encode()).decode(), "base64>url>compressed")]
    for coded, via in cases:
        for text in (f"Ü: {coded} end", f"Ü: x={coded}&y=2"):
            hits = [x for x in scan(text) if x[0] == "assign" and x[3] == INNER]
            assert any(h[5] == via for h in hits), (via, coded[:60], hits)
            assert all(3 <= h[1] < h[2] <= 6 + len(coded) for h in hits)


def test_binary_layers():
    for inner in (f"a\x00b\x1b[0m {INNER} c".encode(), f"Ünïcode façade {INNER} ñ".encode("latin-1"), f"\x7f {INNER} \x85".encode()):
        for coded, via in ((base64.b64encode(inner), "base64"), (base64.b64encode(gzip.compress(inner)), "base64>compressed")):
            text = f"é {coded.decode()} é"
            assert [x[5] for x in scan(text) if x[3] == INNER] == [via]
    a, b = next((a, b) for _, a, b, v, *_ in scan("xx " + base64.b64encode(b"\xe9" * 30 + INNER.encode() + b"\xe9" * 3).decode()) if v == INNER)
    assert (a, b) == (3 + 40, 3 + 40 + 31)


def test_large_layers(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 1 << 16)
    monkeypatch.setattr(secrets, "LAYER_BYTES", 1 << 18)
    monkeypatch.setattr(secrets, "BLOCK", 1 << 14)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 12)
    lines = "".join(f"line {i} of many\n" for i in range(60_000)) + f"{INNER}\n"
    bare = "a " * 400_000 + INNER + " b" * 10
    for inner in (lines, bare):
        for data in (gzip.compress(inner.encode()), gzip.compress(gzip.compress(inner.encode())), gzip.compress(inner[:70_000].encode()) + gzip.compress(inner[70_000:].encode())):
            assert INNER in [x[3] for x in scan(base64.b64encode(data).decode())]


def test_all_secrets_of_a_layer():
    values = [f"password=value{i}value" for i in range(5)]
    coded = base64.b64encode(gzip.compress("\n".join([*values, *values]).encode())).decode()
    got = scan(f"x {coded} y")
    assert sorted(x[3] for x in got) == values and len({x[1:3] for x in got}) == 1
