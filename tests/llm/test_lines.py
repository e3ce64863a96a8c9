"""Line dedup, license scans and decontamination: odd rows and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from noticeweave.llm.decontaminate import find_contamination, words
from noticeweave.llm.licenses import TEMPLATES, scan_licenses
from noticeweave.llm.lines import dedup_lines


def slow(docs):
    seen = {}
    for i, t in sorted(docs):
        lines = t.split("\n")
        for k in range(len(lines) - 2):
            seen.setdefault(tuple(lines[k : k + 3]), (i, k))
    out = {}
    for i, t in docs:
        lines = t.split("\n")
        gone = {k + j for k in range(len(lines) - 2) if seen[tuple(lines[k : k + 3])] != (i, k) for j in range(3)}
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone), sum(k - 1 not in gone for k in gone))
    return out


def test_lines_like_a_loop(spark):
    draw = random.Random(8)
    docs = [(i, "\n".join(draw.choices(["a", "b", "", "é c"], k=draw.randrange(0, 14)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"first": F.lit(1), "runs": F.lit("r"), "a": F.lit(0)})
    got = dedup_lines(df.repartition(4), report=True)
    assert got.columns == [*df.columns, "n_lines", "n_removed", "n_runs"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_runs) for r in got.collect()} == slow(docs)


def test_lines_odd_rows(spark):
    rows = [(None, "x\ny\nz"), (1, "x\ny\nz"), (2, None), (3, ""), (4, "p\nq\nr"), (4, "p\nq\nr"), (5, "p\nq")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in dedup_lines(df).collect()), key=str)
    assert got == sorted([(None, "x\ny\nz"), (1, ""), (2, None), (3, ""), (4, "p\nq\nr"), (4, "p\nq\nr"), (5, "p\nq")], key=str)
    assert dedup_lines(df.limit(0)).count() == 0


def test_licenses(spark):
    rows = [(i, t, "mine") for i, t in enumerate(TEMPLATES.values())]
    rows += [(90, None, "x"), (91, "", "x"), (92, "word", "x"), (93, "One\n\nReleased under the\nMIT License\n\nmore words here", "x"), (94, "some all rights reserved", "x"), (95, "z " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = {r.doc_id: {(m.template, m.unit, m["index"]) for m in r.licenses} for r in scan_licenses(df).collect()}
    for i, name in enumerate(TEMPLATES):
        assert (name, "text", 0) in got[i]
    assert got[90] == got[91] == got[92] == got[95] == set() and got[93] == {("mit", "paragraph", 1)}
    assert got[94] == {("all-rights-reserved", "text", 0)}
    assert scan_licenses(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [10, 500_000])
def test_contamination_like_a_loop(spark, block):
    draw = random.Random(6)
    word = lambda k: " ".join(draw.choices(["a", "B", "c9", "é", "d-e"], k=k))
    items = [(str(i), word(draw.choice([1, 2, 3, 5, 8]))) for i in range(12)] + [("3", word(4)), (None, "a"), ("x", None), ("y", "--")]
    docs = [(i, word(draw.randrange(0, 60))) for i in range(40)] + [(None, None), (50, "-"), (51, word(300)), (51, word(300))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("clash"))
    got = find_contamination(df, spark.createDataFrame(items, "item_id string, text string"), window=4, block_words=block)
    seen = sorted(((r.text or "", r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()), key=str)
    want = []
    for _, t in docs:
        w, hit, who = words(t), set(), set()
        for i, x in items:
            p = words(x) if i is not None else []
            m = min(4, len(p))
            for a in range(len(p) - m + 1 if p else 0):
                for k in range(len(w) - m + 1):
                    if w[k : k + m] == p[a : a + m]:
                        hit.update(range(k, k + m))
                        who.add(i)
        want.append((t or "", len(w), len(hit), tuple(sorted(who)), bool(hit) and 20 * len(hit) >= len(w)))
    assert seen == sorted(want, key=str)
    assert find_contamination(df.limit(0), spark.createDataFrame(items[:1], "item_id string, text string")).count() == 0
    none = find_contamination(df, spark.createDataFrame([], "item_id string, text string"))
    assert none.where("contaminated or n_hit > 0").count() == 0


def test_blocks_of_a_benchmark_like_one(spark):
    """A benchmark of many blocks gives what one block gives, for copies, nulls and clashing columns too."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(draw.choices(words, k=draw.choice((2, 5, 13, 14, 20))))) for i in range(60)] + [(60, None), (61, ""), (5, "w1 w2 w3")]
    texts = [" ".join([*draw.choices(words, k=20), draw.choice(items[:60])[1], *draw.choices(words, k=draw.randrange(300))]) for _ in range(40)] + [None, "", "w1"]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:9])), "doc_id long, text string").withColumns({"h": F.lit(1), "spans": F.lit("s"), "items": F.lit(0)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (find_contamination(docs, bench, block_words=n) for n in (10**6, 50))
    assert one.columns == many.columns
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated, r.h, r.spans)
    assert sorted(map(key, one.collect())) == sorted(map(key, many.collect()))
    assert sum(r.contaminated for r in many.collect()) > 10 and find_contamination(docs.limit(0), bench, block_words=50).count() == 0
