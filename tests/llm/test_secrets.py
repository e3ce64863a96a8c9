"""Secret scans against plain loops over the base patterns, and planted nested secrets."""

import base64
import gzip
import hashlib
import random
import urllib.parse
import zlib

from noticeweave.llm.queries import QUERIES
from noticeweave.llm.secrets import matches, scan, scan_secrets


def slow(text: str) -> list[tuple[str, int, int]]:
    """The base spans, character by character."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    found = []
    i = 0
    value = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-")
    while i < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, i):
                for quote in (1, 0):
                    j = i + len(word)
                    if quote and text[j : j + 1] not in ("'", '"'):
                        continue
                    j += quote
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] not in (":", "="):
                        continue
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] in ("'", '"'):
                        j += 1
                    k = j
                    while k < len(text) and text[k] in value:
                        k += 1
                    if k > j:
                        end = (j, k)
                        break
                break
        if end:
            if end[1] - end[0] >= 6:
                found.append(("assign", i, end[1]))
            i = end[1]
        else:
            i += 1
    for kind, head, chars, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            k = i + len(head)
            if text.startswith(head, i) and text[k : k + 1] in chars and k < len(text):
                while k < len(text) and text[k] in chars:
                    k += 1
                if k - i >= least:
                    found.append((kind, i, k))
                i = k
            else:
                i += 1
    return sorted(found)


def test_base_patterns():
    draw = random.Random(3)
    bits = ["password", "PassWD", "secret", "ſecret", "toKen", "toKen", "api_key", "APIkey", "=", ":", " ", "  ", '"', "'", "abc", "a1b2c3", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "\n", "==", "x"]
    for _ in range(4000):
        text = "".join(draw.choices(bits, k=draw.randrange(1, 25)))
        assert sorted(matches(text)) == slow(text), text


def test_nested():
    inner = "password=hunter2hunter2"
    b64 = base64.b64encode(inner.encode()).decode()
    cases = {
        urllib.parse.quote(inner, safe="").replace("p", "%70"): "url",
        "".join(f"\\u{ord(c):04x}" for c in inner): "unicode",
        b64: "base64",
        base64.b64encode(gzip.compress(inner.encode())).decode(): "base64>compressed",
        base64.urlsafe_b64encode(zlib.compress(zlib.compress(inner.encode()))).decode(): "base64>compressed>compressed",
        urllib.parse.quote(base64.b64encode(b64.encode()).decode(), safe="").replace("d", "%64"): "url>base64>base64",
    }
    for coded, via in cases.items():
        text = f"Über: {coded} end"
        hits = [x for x in scan(text) if x[4] > 0]
        assert any(kind == "assign" and v == inner and w == via for kind, _, _, v, _, w in hits), (coded, hits)
        for _, a, b, *_ in hits:
            assert 6 <= a < b <= 6 + len(coded)
    a, b = next((a, b) for _, a, b, _, d, _ in scan(f"xx {b64} yy") if d)
    assert (a, b) == (3, 3 + len(b64.rstrip("=")))
    # an assignment half of which is escaped: its span has the escape
    assert ("assign", 3, 22) in [x[:3] for x in scan("aa password%3Dabcdef99 b")]


def test_cycles_and_growth():
    nested = "token=abcdef99"
    for _ in range(30):
        nested = nested.replace("%", "%25") if "%" in nested else nested.replace("=", "%3D")
    assert [x[:3] + x[4:5] for x in scan(nested) if x[0] == "assign"] == [("assign", 0, len(nested), 30)]
    assert scan("%2525252541 " * 50) == []


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "token: abcdef1", "x"), (None, "token: abcdef1", "x"), (5, "y" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string")
    got = scan_secrets(df)
    assert got.columns == ["doc_id", "text", "secrets"]
    assert sorted(len(r.secrets) for r in got.collect()) == [0, 0, 0, 1, 1]
    assert scan_secrets(df.limit(0)).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op5_secrets"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and sum(r.n_assign + r.n_access for r in got) > 5
    for r in got:
        base = sorted(slow(docs[r.doc_id]), key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")]
        assert set(said.split(",")) <= set(r.spans.split(","))
