"""SimHash keys and groups against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from noticeweave.llm import golay
from noticeweave.llm.queries import QUERIES
from noticeweave.llm.simhash import dedup, fingerprint, links, near_duplicates


def test_golay_code():
    words = np.arange(1 << 23, dtype=np.int64)
    found = golay.decode(words)
    assert np.array_equal(np.bincount(found), np.full(4096, 2048))
    draw = np.random.default_rng(1)
    for bits in (21, 22, 23):
        a = draw.integers(0, 1 << bits, 4000)
        b = a ^ 1 << draw.integers(0, bits, 4000) ^ 1 << draw.integers(0, bits, 4000)
        x, y = golay.near(a, bits), golay.near(b, bits)
        assert ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any((1, 2)).all()
        assert (x >= 0).sum(1).max() <= 6


def slow(text: str, k: int = 4) -> int:
    words, w = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [w] if w else []
            w = ""
        else:
            w += c.lower() if "A" <= c <= "Z" else c
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int]) -> list[int]:
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(prints))]


@pytest.mark.parametrize("wide", [False, True])
def test_all_links(spark, wide):
    draw = random.Random(2)
    made = {draw.getrandbits(64) for _ in range(60)}
    for f in list(made):
        for k in (1, 2, 3, 4, 4, 4, 5, 6):
            made.add(f ^ sum(1 << b for b in draw.sample(range(64), k)))
    signed = sorted(np.array(sorted(made), np.uint64).view(np.int64).tolist())
    got = links(spark.createDataFrame([(f,) for f in signed], "f long"), wide).distinct().collect()
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert {(r.a, r.b) for r in got} == want and len(want) > 400


def rows():
    draw = random.Random(4)
    words = ["Ab", "bc", "É", "dé", "x\x1fy", "tok", "Z\x85z", "q"]
    base = [" ".join(draw.choices(words, k=k)) for k in (0, 1, 3, 4, 5, 40, 60, 80, 200)]
    made = base + base[3:] + [None, "  \n", "\x85"]
    for t in base[5:]:
        for _ in range(6):
            w = t.split(" ")
            w[draw.randrange(len(w))] = "new"
            made.append("\t ".join(w))
    return [(i, t) for i, t in enumerate(made)]


def test_groups(spark):
    data = rows()
    prints = [slow(t or "") for _, t in data]
    assert [fingerprint(t) & (1 << 64) - 1 for _, t in data] == prints
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"f": F.lit(1), "fingerprint": F.lit("x")})
    named = {r.f: r.component_id for r in near_duplicates(df.select(F.col("doc_id").alias("f"), F.col("text").alias("id")), id_col="f", text_col="id").collect()}
    got = sorted(near_duplicates(df.repartition(3)).collect())
    assert named == {r.doc_id: r.component_id for r in got}
    want = groups(prints)
    assert [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got] == [(i, prints[i], want[i]) for i in range(len(data))]
    kept = dedup(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (7, "a b"), (7, "a b"), (None, "zz"), (None, "zz"), (8, None), (8, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (None, None), (8, 8), (8, 8)], key=str)
    assert sorted(map(tuple, dedup(df).collect()), key=str) in (
        sorted([(7, "a b"), (None, "zz"), (8, None)], key=str),
        sorted([(7, "a b"), (None, "zz"), (8, "")], key=str),
    )
    assert near_duplicates(df.limit(0)).count() == 0 and dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["0.001"])
def test_query(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect())
    prints = [slow(t) for _, t in docs]
    want = groups(prints)
    got = sorted(QUERIES["op1_simhash"](spark, f"/root/testdata/sf{sf}").collect())
    assert [tuple(r) for r in got] == [(docs[i][0], f"{prints[i]:016x}", docs[want[i]][0]) for i in range(len(docs))]


def test_keys_are_never_broadcast(spark):
    # each fingerprint has dozens of keys, of which Spark's estimate knows nothing
    prints = spark.range(1000).select(F.xxhash64("id").alias("f"))
    for wide in (False, True):
        plan = links(prints, wide)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
