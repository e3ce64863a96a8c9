"""Secrets behind path parts, in cut or joined streams, with odd bytes, and under very many levels of escapes."""

import base64
import bz2
import gzip
import lzma
import random
import time
import urllib.parse
import zlib

import pytest

from noticeweave.llm.secrets import scan

INNER = b"x token=abcdefgh1234 y"


def values(text: str) -> set[str]:
    return {s[3] for s in scan(text)}


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


@pytest.mark.parametrize("before", ["/a/", "/", "//", "key-", "x_y/", "abc/def/", ""])
def test_alignment(before):
    text = f"see {before}{b64(INNER)} end"
    assert "token=abcdefgh1234" in values(text)
    start, end = next((s[1], s[2]) for s in scan(text) if s[4])
    assert text.index(b64(INNER)[:4]) <= start + 3 and end <= len(text) - 4
    packed = f"see {before}{b64(gzip.compress(b'a' * 50 + INNER))} end"
    assert "token=abcdefgh1234" in values(packed)


@pytest.mark.parametrize("data", [b"\x01" + INNER, b"\xe9" + INNER, gzip.compress(b"one") + gzip.compress(INNER), b"\x00\x1b[0m" + INNER])
def test_odd_bytes_and_members(data):
    assert "token=abcdefgh1234" in values(f"a {b64(data)} b")


def test_cut_and_damaged_streams():
    noise = bytes(range(256)) * 8
    for pack in (gzip.compress, zlib.compress):
        whole = pack(INNER + b" " + noise * 3 + bytes(reversed(noise)))
        assert "token=abcdefgh1234" in values(f"a {b64(whole[: len(whole) - 9])} b")
        assert "token=abcdefgh1234" in values(f"a {b64(whole[:-40] + bytes(30))} b")


def test_wrapped_lines():
    data = gzip.compress(bytes(i * 7 % 251 for i in range(90)) + INNER + bytes(i * 11 % 241 for i in range(90)))
    lines = base64.encodebytes(data).decode()
    assert lines.count("\n") > 2 and "token=abcdefgh1234" in values(f"key:\n{lines}\nend")


def test_very_many_levels():
    for text in ("%" + "25" * 500_000 + "41 x", "\\u005c" + "u005c" * 180_000 + "u0041 x", "&#38;" + "#38;" * 200_000 + "#65; x"):
        began = time.time()
        scan("password" + text)
        assert time.time() - began < 30
    deep = "token%" + "25" * 400 + "3Dabcdefgh1234"
    assert "token=abcdefgh1234" in values(deep)
    assert "token=abcdefgh1234" in values("token%3Dabcdefgh1234") and "token=abcdefgh1234" in values("token%253Dabcdefgh1234")
    assert "token=abcdefgh1234" in values("token\\u005cu005cu003dabcdefgh1234")


def test_a_thousand_streams_in_each_other():
    data = INNER
    for _ in range(1010):
        data = zlib.compress(data, 0)
    assert "token=abcdefgh1234" in values(b64(data))


def test_short_tokens_after_other_characters():
    """The shortest secret is 16 base64 characters, whatever stands directly before them."""
    token = base64.b64encode(b"token=abcdef").decode()
    for before in ("", "/", "x/", "ab", "abc", "abcd", "a" * 50):
        assert "token=abcdef" in [s[3] for s in scan(f"say {before}{token} more")], before


def test_cut_and_damaged_streams_of_twelve_bytes():
    whole = zlib.compress(b"token=abc123")
    assert [s[3] for s in scan(base64.b64encode(whole[:-4]).decode())] == ["token=abc123"]
    for n in range(200):
        text = b"token=abc123" + bytes(i % 7 + 97 for i in range(n)) + b" "
        bad = bytearray(zlib.compress(text + bytes(range(1, 60))))
        bad[-3] ^= 0x55  # only the checksum
        assert any(s[3].startswith("token=abc123") for s in scan("x " + base64.b64encode(bytes(bad)).decode())), n


def test_other_compressions():
    secret = b"and here password = hunter2hunter2 it is"
    for pack in (bz2.compress, lzma.compress, gzip.compress, zlib.compress):
        assert [s[3] for s in scan(base64.b64encode(pack(secret)).decode())] == ["password = hunter2hunter2"]
        assert [s[3] for s in scan(base64.b64encode(pack(zlib.compress(secret))).decode())] == ["password = hunter2hunter2"]
        assert values(urllib.parse.quote(pack(secret))) == {"password = hunter2hunter2"}


def test_bytes_that_are_no_text():
    """Secrets and codings within binary are found where they stand."""
    draw = random.Random(2)
    junk = lambda n: bytes(draw.randrange(128, 256) for _ in range(n))
    for inner in (b"secret: hunter22", b"AKIA" + b"A1" * 9, b"0123456789abcdef01234567", b"%74oken=abcdef", rb"token=abcdef", base64.b64encode(b"token=abcdef"), rb"tok\x65n=abcdef"):
        for n in (1, 2, 3, 40):
            found = scan(base64.b64encode(junk(n) + b"\n" * (n == 40) + inner + junk(7)).decode())
            assert found, (inner, n)


def test_images_take_little_time():
    text = base64.b64encode(random.Random(1).randbytes(380_000)).decode()
    began = time.process_time()
    scan(text)
    assert time.process_time() - began < 3
