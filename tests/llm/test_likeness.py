"""Alike texts against all pairs."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from noticeweave.llm import likeness
from noticeweave.llm.simhash import fingerprint
from tests.llm.test_simhash import groups, slow


def five(text: str) -> set[str]:
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def like(a: str, b: str) -> bool:
    x, y = five(a), five(b)
    return bool(x) and 5 * len(x & y) >= 4 * len(x | y)


def made() -> list[tuple[int, str]]:
    draw = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    shared = " ".join(draw.choices(words, k=30))
    out = []
    for _ in range(20):
        base = draw.choices(words, k=draw.choice((8, 20, 60, 150, 400)))
        for share in (0, 0.004, 0.006, 0.008, 0.01, 0.015, 0.03):
            w = [draw.choice(words) if draw.random() < share else x for x in base]
            out.append(" ".join(w) + (" " + shared if draw.random() < 0.4 else ""))
    draw.shuffle(out)
    return list(enumerate([*out, *out[:5], "", "one two", "One two"]))


def connected(n: int, pairs) -> list[int]:
    top = list(range(n))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in pairs:
        x, y = sorted((root(i), root(j)))
        top[y] = x
    return [root(i) for i in range(n)]


def test_connected_like_all_pairs(spark, monkeypatch):
    """A chain, groups of edits of edits and texts with one common passage: the links connect what all pairs do, with fewer of them."""
    draw = random.Random(8)
    words = [f"v{i}" for i in range(500)]
    data = made()
    texts = [t for _, t in data]
    base = draw.choices(words, k=90)
    for k in range(60):  # each is like the next ones, the ends are not alike
        base = [*base[:k], draw.choice(words), *base[k + 1 :]]
        texts.append(" ".join(base))
    base = draw.choices(words, k=70)
    texts += [" ".join(draw.choice(words) if draw.random() < 0.012 else x for x in base) for _ in range(60)]
    passage = " ".join(draw.choices(words, k=40))
    texts += [passage + " " + " ".join(draw.choices(words, k=draw.randrange(4, 30))) for _ in range(40)]
    prints = [fingerprint(t, 5) for t in texts]
    place = {}
    for i, f in enumerate(prints):
        place.setdefault(f, i)
    same = [(place[f], i) for i, f in enumerate(prints)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if like(texts[i], texts[j])]
    monkeypatch.setattr(likeness, "SAMPLE", 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = likeness.connect(df, spark.createDataFrame([], "a long, b long")).distinct().collect()
    known = {frozenset((prints[i], prints[j])) for i, j in pairs}
    assert all(frozenset((r.a, r.b)) in known for r in got)
    assert connected(len(texts), same + [(place[r.a], place[r.b]) for r in got]) == connected(len(texts), same + pairs)
    assert 50 < len(got) < len(known)


def test_all_pairs(spark, monkeypatch):
    data = made()
    monkeypatch.setattr(likeness, "SAMPLE", 2)
    got = likeness.links(spark.createDataFrame([*data, (999, None)], "doc_id long, text string").repartition(5)).collect()
    want = set()
    for i, a in data:
        for _, b in data[:i]:
            x, y = sorted((fingerprint(a), fingerprint(b)))
            if like(a, b) and ((x ^ y) & (1 << 64) - 1).bit_count() > 4:
                want.add((x, y))
    assert len(want) > 40 and {tuple(r) for r in got} == want


def test_stage_merges_alike_texts(spark):
    data = made()
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("lang", F.lit("en"))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    top = list(range(len(data)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    bits = groups([slow(t, 5) for _, t in data])
    for i, a in data:
        for j, b in [*data[:i], (bits[i], a)]:
            if j == bits[i] or like(a, b):
                x, y = sorted((root(i), root(j)))
                top[y] = x
    assert kept == {root(i) for i, _ in data} and len(kept) < len(set(bits))


def test_counts_bound_what_sets_share():
    draw = np.random.default_rng(4)
    for _ in range(400):
        n = int(draw.integers(1, 900))
        a = np.unique(draw.integers(-(1 << 63), (1 << 63) - 1, n))
        kept = a[draw.random(len(a)) < draw.random()]
        b = np.unique(np.concatenate([kept, draw.integers(-(1 << 63), (1 << 63) - 1, int(draw.integers(1, 900)))]))
        assert likeness.at_most(likeness.counted(a), likeness.counted(b)) >= len(np.intersect1d(a, b))
    assert likeness.at_most(b"", likeness.counted(a)) > 1 << 60


def test_shingles_are_never_broadcast(spark):
    # what a text's array of shingles holds isn't in Spark's estimate of the rows made of it
    keys = spark.range(1000).select("id", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("key"))
    left = keys.select("key", F.col("id").alias("root"), F.col("id").alias("h"), F.lit(60).alias("n"), F.lit(0).alias("pos"))
    plan = likeness._rest(left)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
