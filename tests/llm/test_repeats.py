"""Suffix sort and removal of repeats against plain loops."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticeweave.llm import repeats
from noticeweave.llm.queries import QUERIES
from noticeweave.llm.repeats import Anchors, remove_repeats
from noticeweave.llm.suffixes import Prefixes, repeated, sort_suffixes


def test_suffix_sort():
    draw = random.Random(1)
    for _ in range(30):
        data = "".join(draw.choices("ab", [9, 1], k=600)).encode()
        starts = np.array(draw.sample(range(540), draw.randrange(1, 200)))
        segment = np.sort(np.array([draw.randrange(4) for _ in starts]))
        most = draw.choice([1, 7, 60])
        text = Prefixes(np.frombuffer(data, np.uint8))
        got = [(int(segment[i]), data[starts[i] : starts[i] + most]) for i in sort_suffixes(text, starts, segment, most)]
        assert got == sorted(got)
        n = Counter(got)
        want = [n[int(s), data[p : p + most]] > 1 for s, p in zip(segment, starts, strict=True)]
        assert repeated(text, starts, segment, most).tolist() == want


def slow(texts: list[str | None], length: int) -> list[tuple[int, int, int, bytes]]:
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if n[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, bytes(b for b, g in zip(d, gone[:-1], strict=True) if not g)))
    return out


def rows() -> list[tuple[int | None, str | None]]:
    draw = random.Random(3)
    word = lambda k: "".join(draw.choices("abcdé ", k=k))
    shared, base = word(70), word(300)
    made = [word(draw.randrange(0, 200)) for _ in range(20)]
    made += [word(60) + shared + word(50) for _ in range(8)] + [word(9) + shared[:48] + word(9) for _ in range(8)]
    for _ in range(25):
        t = list(base)
        for _ in range(draw.randrange(3)):
            t[draw.randrange(len(t))] = draw.choice("xyz")
        made.append("".join(t))
    made += ["q" * 500, "qz" * 120, None, "", base, base, "w" * 39, "w" * 40, "v" * 41]
    data: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(made)]
    return data + [(None, word(99)), (3, made[3]), (None, None), (7, word(120))]


@pytest.mark.parametrize(("most", "widths"), [(128, (48, 6, 1)), (3, (12, 4, 1)), (1, (5, 1))])
def test_like_a_loop(spark, most, widths):
    data = rows()
    want = sorted(zip((str(i) for i, _ in data), slow([t for _, t in data], 40), strict=True))
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"id": F.lit(1), "h": F.lit("x"), "kept": F.lit(0)})
    got = remove_repeats(df.repartition(3), length=40, gram=8, most=most, widths=widths)
    assert got.columns == ["doc_id", "text", "id", "h", "n_bytes", "spans", "kept"]
    seen = sorted((str(r.doc_id), (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept))) for r in got.collect())
    assert seen == want


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = sorted(QUERIES["op10_suffix_dedup"](spark, "/root/testdata/sf0.001").collect())
    want = slow([t for _, t in docs], 400)
    assert [tuple(r) for r in got] == [(i, n, m, s, hashlib.sha256(k).hexdigest(), m > 0) for (i, _), (n, m, s, k) in zip(docs, want, strict=True)]
    assert sum(r.n_removed for r in got) > 1000


def test_many_equal_rows_and_one_page(spark):
    """5,000 rows of one id and text, and a page that many other documents have."""
    draw = random.Random(6)
    page = " ".join(str(draw.randrange(10**6)) for _ in range(90))
    data = [(1, page + "x")] * 5000 + [(i, f"{i} " * 30 + page) for i in range(10, 400)] + [(2, "short"), (3, page[:390])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = remove_repeats(df.repartition(8), keep=["doc_id"]).collect()
    assert len(got) == len(data)
    for r in got:
        spans = [(s.start, s.end) for s in r.spans]
        if r.doc_id == 1:
            assert spans == [(0, len(page) + 1)]
        elif r.doc_id >= 10:
            start = len(f"{r.doc_id} " * 30)
            assert spans == [(start - 1, start + len(page))] or spans == [(start, start + len(page))] or spans[0][1] == start + len(page)
        else:
            assert spans == []


def test_units_are_found_in_little_memory():
    """Of 2 MB in one text and in many, with the same units whatever is looked at together."""
    draw = random.Random(8)
    texts = [draw.randbytes(2_000_000), *(draw.randbytes(2_000) for _ in range(1_000))]
    finder = Anchors(400, 64)
    tracemalloc.start()
    starts = sum(int(n.sum()) for _, _, n, *_ in finder.find(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert starts == sum(len(t) - 399 for t in texts)
    assert peak < 40e6


def test_units_of_few_starts_are_sorted_by_the_megabyte():
    """100,000 units of one start and 400 bytes, which are 40 MB, as stretches of large groups are."""
    batch = pa.RecordBatch.from_pylist([{"key": i // 50, "key2": 0, "n": 1, "text": bytes(400)} for i in range(20_000)])
    bundles = list(repeats._bundles(batch for _ in range(5)))
    assert sum(map(len, bundles)) == 100_000
    assert max(sum(len(r["text"]) for r in b) for b in bundles) < 1 << 20
    for b, c in zip(bundles[:-1], bundles[1:], strict=True):
        assert b[-1]["key"] != c[0]["key"]


def test_batches_are_bounded_in_bytes(spark, monkeypatch):
    """Texts that Python gets at once in the search for units, and what one batch of copies becomes when it is cut."""
    pieces = list(repeats._filled(((i, bytes(5_000)) for i in range(2_000)), "key long, text binary"))
    assert [x for b in pieces for x in b.column(0).to_pylist()] == list(range(2_000))
    assert max(b.nbytes for b in pieces) < 2 * repeats.BATCH
    assert list(repeats._filled(iter(()), "key long, text binary")) == []

    class Told(Anchors):
        def find(self, texts):
            assert sum(map(len, texts)) < 2 * repeats.BATCH, "too many bytes at once"
            return super().find(texts)

    monkeypatch.setattr(repeats, "Anchors", Told)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    long = spark.range(0, 1_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 150).alias("text"))
    got = remove_repeats(long, keep=["doc_id"]).select("doc_id", "n_bytes", F.size("spans").alias("n"), F.length("kept").alias("kept")).collect()
    assert sorted(map(tuple, got)) == [(i, 9_600, 1, 0) for i in range(1_000)]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
