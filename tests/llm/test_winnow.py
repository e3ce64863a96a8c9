"""Winnowing against a plain loop over every window."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from noticeweave.llm.winnow import K, W, as_string, compare_edits, fingerprint


def slow(text: str, k: int = K, w: int = W) -> list[tuple[int, int]]:
    data = text.encode()
    if not data:
        return []
    grams = [data[i : i + k] for i in range(max(1, len(data) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) >> 1 & ~511 for g in grams]
    chosen = set()
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i : i + w]
        least = min(window)
        j = max(j for j, h in enumerate(window) if h == least)
        chosen.add((i + j, least >> 32))
    return sorted(chosen)


def near(a, b) -> float:
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got, k, w):
    docs = sorted(((i, xxhash.xxh64_intdigest((t or "").encode(), 42), t or "") for i, t in {(i, t) for i, t in rows}), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] - (1 << 64) * (r[1] >= 1 << 63)))
    wanted = {}
    for n, (i, _, t) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][2]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        own, other = slow(t, k, w), slow(edited, k, w)
        said = [" ".join(f"{h:X}@{p}".lower() for p, h in x) for x in (own, other)]
        wanted[i, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *said, pytest.approx(near(own, other)), pytest.approx(near(own, slow(after, k, w))))
    seen = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.f, r.e, r.near_edited, r.near_next) for r in got), key=str)
    want = sorted(((i, *wanted[i, t or ""]) for i, t in rows), key=str)
    assert len(seen) == len(want)
    for a in seen:
        assert a in want


@pytest.mark.parametrize(("k", "w"), [(K, W), (3, 7)])
def test_like_a_loop(spark, k, w):
    draw = random.Random(5)
    rows = [(i, "".join(draw.choices(["ab", "é", "a", " ", "日", "\n"], k=draw.choice([0, 1, 3, 20, 150, 400])))) for i in range(40)]
    rows += [(None, "null id"), (50, None), (50, "twice"), (50, "twice"), (51, "a" * 900), (52, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash")).repartition(3)
    got = compare_edits(df, k=k, w=w).select("*", as_string(F.col("fingerprint")).alias("f"), as_string(F.col("edited_fingerprint")).alias("e"))
    check(rows, got.collect(), k, w)


def test_small_tables(spark):
    one = spark.createDataFrame([(3, "only one here")], "doc_id long, text string")
    r = compare_edits(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert compare_edits(one.limit(0)).count() == 0
    assert [(p.pos, p.hash) for p in fingerprint(one).first().fingerprint] == slow("only one here")


def test_query(spark):
    from noticeweave.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = QUERIES["op7_fingerprints"](spark, "/root/testdata/sf0.001").withColumnsRenamed({"fingerprint": "f", "edited_fingerprint": "e"}).collect()
    check(rows, got, K, W)
