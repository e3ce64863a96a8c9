"""Sharding: plain prefix sums, odd rows and files."""

import random
import zlib

from pyspark.sql import functions as F

from noticeweave.llm.shards import assign_shards, write_shards


def draw_docs(spark, n=300):
    draw = random.Random(4)
    ids = draw.sample(range(10_000), n)
    rows = [(i, draw.choice([None, "", "é" * draw.randrange(50), "x" * draw.randrange(3000)])) for i in ids]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(9), "size": F.lit("s"), "total": F.lit(0), "place": F.lit(1)})


def slow(rows, shards):
    size = lambda t: len((t or "").encode()) + 8
    total, before, out, slots = sum(size(t) for _, t in rows), 0, {}, {}
    for i, t in sorted(rows):
        k = (2 * before + size(t)) * shards // (2 * total)
        out[i] = (size(t), zlib.crc32((t or "").encode()), k, slots.setdefault(k, 0))
        slots[k] += 1
        before += size(t)
    return out


def test_like_a_loop(spark):
    rows, df = draw_docs(spark)
    for n in (1, 7, 24, 2000):
        got = {r.doc_id: (r["size"], r.text_crc32, r.shard, r.slot) for r in assign_shards(df.repartition(6), shards=n).collect()}
        assert got == slow(rows, n)


def test_shards_are_near_equal(spark):
    rows, df = draw_docs(spark)
    sizes = [r[0] for r in assign_shards(df, shards=12).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 12 and max(sizes) - min(sizes) <= 2 * max(len((t or "").encode()) + 8 for _, t in rows)


def test_odd_rows(spark):
    kind = "doc_id long, text string"
    assert assign_shards(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, "b"), (None, None), (3, "x"), (3, "x"), (3, "x"), (3, "y"), (5, None), (1, "z" * 500_000)]
    got = assign_shards(spark.createDataFrame(rows, kind), shards=4).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0, r["size"]) for r in got)) == sorted((i is not None, i or 0, len(t or "") + 8) for i, t in rows)
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())  # gapless, equal rows too
    place = {(r.doc_id, r.shard) for r in got}
    assert {s for i, s in place if i is None} == {0} and next(s for i, s in place if i == 1) == 1  # nulls come first; the long one has its middle just below half


def test_one_row_many_times(spark):
    """A third of all rows that are equal is cut like others."""
    df = spark.createDataFrame([(7, "same")] * 300 + [(i, "other") for i in range(600)], "doc_id long, text string")
    n = [r["count"] for r in assign_shards(df, shards=9).groupBy("shard").count().collect()]
    assert len(n) == 9 and max(n) - min(n) <= 12


def test_files(spark, tmp_path):
    rows, df = draw_docs(spark)
    path = str(tmp_path / "out")
    write_shards(df, path, shards=5, file_bytes=20_000)
    got = {(r.doc_id, r.text, r.shard) for r in spark.read.parquet(path).select("doc_id", "text", "shard").collect()}
    want = slow(rows, 5)
    assert got == {(i, t, want[i][2]) for i, t in rows}
    nulls = spark.createDataFrame([(None, "a"), (None, None), (2, "b"), (3, "c")], "doc_id long, text string")
    write_shards(nulls, str(tmp_path / "nulls"), shards=2)
    assert {(r.doc_id, r.shard) for r in spark.read.parquet(str(tmp_path / "nulls")).collect()} == {(None, 0), (2, 1), (3, 1)}
    write_shards(df.limit(0), str(tmp_path / "none"), shards=2)
