"""Source divergence audit: plain loops, odd rows and slices."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticeweave.llm import divergence
from noticeweave.llm.divergence import divergences, scaled


def slow(rows, least=3, ranks=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    counts, docs, whole, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        sources[lang].add(source)
        found = terms(text or "")
        counts[lang, source].update(found)
        whole[lang].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        p = {s: [1 + 10**9 * (counts[lang, s][t] + 1) // (sum(counts[lang, s][x] for x in kept) + v) for t in kept] for s in own}
        q = [1 + 10**9 * (whole[lang][t] + 1) // (sum(whole[lang][x] for x in kept) + v) for t in kept]
        for s in own:
            two = [(-sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in own - {s}]
            one = [(-((a - b) ** 2 // b), t.encode()) for t, a, b in zip(kept, p[s], q, strict=True) if counts[lang, s][t] and a > b]
            out += [(lang, s, "pair", o.decode(), -n, k) for k, (n, o) in enumerate(sorted(two), 1)]
            out += [(lang, s, "term", t.decode(), -n, k) for k, (n, t) in enumerate(sorted(one)[:ranks], 1)]
    return sorted(out)


def found(df, **more):
    return sorted((r.lang, r.source, r.part, r.item, r["value"], r["rank"]) for r in divergences(df, **more).collect())


def draw_rows(seed, n):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "b", "Été", "É", "中文", "x1y", "don't", "z-", "", "A1"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(draw.choices(vocabulary, k=draw.randrange(30))), draw.choice(["en", "fr", None, ""]), draw.choice(["s", "t", "u", None, "V"])) for _ in range(n)]
    return rows + [(None, "en", "none"), ("", "xx", "p"), ("1 2 3", "xx", "q"), ("only once", "yy", "alone"), ("same same", "en", "s"), ("same same", "en", "s"), ("same", "en", None)]


@pytest.mark.parametrize(("slice_bytes", "pairs"), [(16 << 20, 1 << 20), (200, 7)])
def test_like_a_loop(spark, monkeypatch, slice_bytes, pairs):
    monkeypatch.setattr(divergence, "SLICE", slice_bytes)
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    rows = draw_rows(3, 150)
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"id": F.lit(1), "docs": F.lit("x"), "value": F.lit(0)})
    assert found(df.repartition(5)) == slow(rows)
    assert found(df, ranks=2, least=5) == slow(rows, least=5, ranks=2)


def test_partial_runs_of_a_slice_go_on_over_batches(spark, monkeypatch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(divergence, "SLICE", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = draw_rows(5, 60)
        df = spark.createDataFrame(rows, "text string, lang string, source string")
        assert found(df.repartition(2)) == slow(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_odd_rows(spark):
    kind = "text string, lang string, source string"
    assert found(spark.createDataFrame([], kind)) == []
    assert found(spark.createDataFrame([(None, None, None)], kind)) == []
    nothing = [(None, None, None), ("", "", "b"), ("12", None, "c")]
    assert found(spark.createDataFrame(nothing, kind)) == slow(nothing)
    long = [("word " * 300_000 + "Rest", "en", "a"), ("word rest", "en", "b"), ("word", "en", "b")]
    assert found(spark.createDataFrame(long, kind)) == slow(long)


def test_groups_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 2)
    df = spark.createDataFrame([("a", "l", s) for s in "xyz"], "text string, lang string, source string")
    with pytest.raises(ValueError, match="3 groups"):
        divergences(df)


def test_scaled_is_exact_for_large_counts():
    draw = random.Random(1)
    pairs = [(n, d) for d in (draw.randrange(1, 9 * 10**15) for _ in range(200)) for n in (1, d, draw.randrange(1, d + 1))]
    got = scaled(np.array([n for n, _ in pairs]), np.array([d for _, d in pairs]))
    assert got.tolist() == [1 + 10**9 * n // d for n, d in pairs]
