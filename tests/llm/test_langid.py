"""Language ID: brute-force scores, odd rows, held-out accuracy."""

import math
from collections import Counter

import numpy as np
import pytest

from noticeweave.llm import langid
from noticeweave.llm.queries import QUERIES


def test_pieces_don_t_matter(spark, monkeypatch):
    texts = ["Ab  c%%d é", "x", "Hello wonderful world " * 40]
    whole = [Counter(np.concatenate(b.buckets).tolist()) for t in texts for b in langid.blocks([t], 1 << 15)]
    monkeypatch.setattr(langid, "PIECE", 3)
    pieces = [sum((Counter(np.concatenate(b.buckets).tolist()) for b in langid.blocks([t], 1 << 15)), Counter()) for t in texts]
    for a, b in zip(whole, pieces, strict=True):
        a.pop(1 << 15), b.pop(1 << 15)
        assert a == b
    assert sum(whole[1].values()) == 2  # x, and it after a space


def test_scores_by_hand(spark):
    rows = [(1, "aa ab", "x"), (2, "bb ba", "y"), (3, "aab", "x"), (4, None, "x"), (5, "zz", None), (5, "bbb", "y"), (5, "bbb", "y")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=64)
    assert model.langs == ["x", "y"]
    grams = {"x": Counter(), "y": Counter()}
    n = Counter()
    for _, t, lang in rows:
        if t and lang:
            n[lang] += 1
            for b in langid.blocks([t], 64):
                grams[lang].update(x for k in b.buckets for x in k.tolist() if x < 64)
    for text in ("abba", "bb", "a"):
        got = next(langid.score([text], model))
        sums = {}
        for lang, seen in grams.items():
            total = sum(seen.values()) + 0.5 * 64
            own = [x for b in langid.blocks([text], 64) for k in b.buckets for x in k.tolist() if x < 64]
            sums[lang] = math.log(n[lang] / sum(n.values())) + sum(math.log((seen[x] + 0.5) / total) for x in own)
        best = max(sorted(sums), key=sums.get)
        assert got[0] == best and got[1] == pytest.approx(1 / sum(math.exp(v - sums[best]) for v in sums.values()), rel=1e-4)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 %% 3"), (None, "hallo"), (None, "hallo")], "doc_id long, text string")
    none = langid.train(df.selectExpr("text", "cast(null as string) lang"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    model = langid.train(spark.createDataFrame([("hallo welt", "de"), ("hello world", "en")], "text string, lang string"))
    got = langid.predict(df.selectExpr("*", "'mine' score"), model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert sorted((r.lang_pred, r.score > 0) for r in got.collect()) == [("de", True)] * 2 + [("und", False)] * 3
    assert langid.predict(df.limit(0), model).count() == 0
    with pytest.raises(Exception, match="languages"):
        langid.train(spark.range(300).selectExpr("'a' text", "string(id) lang"))


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean([r.lang_pred == docs[r.doc_id] for r in held]) > 0.97


def plain_grams(text: str | None, buckets: int) -> list[int]:
    """Buckets of all n-grams, one character after the other."""
    chars = [" "]
    for c in text or "":
        low = c.lower()
        letter = (low if len(low) == 1 else c) if c.isalpha() else " "
        if letter != " " or chars[-1] != " ":
            chars.append(letter)
    bits, out = (buckets - 1).bit_length(), []
    for i in range(1, len(chars)):
        h = 0
        for order in range(3):
            if i - order < 0:
                break
            h = ((h ^ ord(chars[i - order])) * 0x9E3779B1 + order + 1) & 0xFFFFFFFF
            out.append((((h ^ h >> 15) * 0x85EBCA77) & 0xFFFFFFFF) >> 32 - bits)
    return out


def test_query_like_a_plain_model(spark):
    """The whole query on sf0.001, with n-grams, counts, priors and posteriors made anew."""
    import zlib

    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    seen, n = {}, Counter()
    for i, t, lang in rows:
        if not held[i] and t is not None and lang is not None:
            n[lang] += 1
            seen.setdefault(lang, Counter()).update(plain_grams(t, 1 << 15))
    logs = {g: (sum(c.values()) + 0.5 * (1 << 15), c) for g, c in seen.items()}
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        assert got[i].held_out == held[i]
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        own = Counter(plain_grams(t, 1 << 15))
        sums = {g: math.log(n[g] / sum(n.values())) + sum(k * math.log((c[x] + 0.5) / total) for x, k in own.items()) for g, (total, c) in logs.items()}
        best = max(sorted(sums), key=sums.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(math.exp(min(0, v - sums[best])) for v in sums.values()), rel=1e-2)
