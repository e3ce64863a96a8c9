"""Sources, prefix sums, positions and cursors against plain loops."""

import datetime as dt
import gzip
import random

from pyspark.sql import functions as F

from noticeweave.operators import graphs, hierarchy, schedule, scope, windows
from noticeweave.sources import files
from noticeweave.streaming import events


def test_whole_cache_like_a_loop(spark):
    draw = random.Random(8)
    for limit in (0, 30, 400):
        data = [(i, draw.randrange(40), draw.randrange(9), draw.random() < 0.1) for i in range(200)]
        total, gone = sum(s for _, _, s, _ in data), set()
        for i, _, size, stale in sorted(data, key=lambda r: (r[1], r[0])):
            if stale or (limit and total > limit):
                gone.add(i)
                total -= size
        df = spark.createDataFrame(data, "i int, at int, size int, stale boolean").repartition(5)
        assert {r.i for r in windows.evictions_of_all(df, [F.col("at"), F.col("i")], "size", limit, F.col("stale")).collect()} == gone
    assert windows.evictions_of_all(df.limit(0), [F.col("at")], "size", 5, F.col("stale")).count() == 0


def test_positions(spark):
    draw = random.Random(2)
    data = [(i, draw.randrange(5)) for i in range(300)]
    want = {i: n for n, (_, i) in enumerate(sorted((p, i) for i, p in data))}
    got = schedule.positions(spark.createDataFrame(data, "id int, p int").repartition(7), [F.col("p"), F.col("id")], "id").collect()
    assert {r.id: r.ahead for r in got} == want


def test_limits_go_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    draw = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    data = [(k, start + dt.timedelta(seconds=draw.randrange(400))) for k in (1, 2, 3) for _ in range(40)]
    want = []
    for k in (1, 2, 3):
        times = sorted(t for j, t in data if j == k)
        got, _, _ = events.count_in_window([t.timestamp() for t in times], None, 0, 3, 60)
        want += [(k, t, a) for t, a in zip(times, got, strict=True)]
    rows = windows.limited(spark.createDataFrame(data, "k int, at timestamp"), "k", "at", 3, 60).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.k, r.at, r.allowed) for r in rows) == sorted(want)


def test_cursor_stream(spark, tmp_path):
    assert events.advance(0, 0, 0, False, [True, False, True, True, True, True], 3) == (1, 4, 3, True)
    rows = [(1, 1, 0, False), (1, 1, 1, True), (1, 2, 0, True), (1, 2, 1, True), (1, 3, 0, False), (2, 1, 0, True), (2, 2, 0, False)]
    spark.createDataFrame(rows, "source long, page int, nth int, known boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("source long, page int, nth int, known boolean").parquet(f"{tmp_path}/in")
    run = events.cursor_stream(stream).writeStream.format("memory").queryName("cursors").outputMode("update").option("checkpointLocation", f"{tmp_path}/c")
    run.trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("cursors").collect()} == {(1, 2, 3, 3, True), (2, 2, 1, 0, False)}


def test_evidence_catalogs_and_attachments(spark, tmp_path):
    rows = spark.createDataFrame([("a", "u1", 1), ("b", "u2", 2), ("b", "u3", 3)], "site_key string, url string, n int")
    files.write_evidence(rows, f"{tmp_path}/e")
    wanted = files.read_evidence(spark, f"{tmp_path}/e", ["b"])
    assert {r.url for r in wanted.collect()} == {"u2", "u3"}
    packed = spark.createDataFrame([(1, gzip.compress(b'{"x": 5}')), (2, b"no"), (3, None)], "k int, z binary")
    assert {r.k: r.x for r in files.unpacked_report(packed, "z", "x int").collect()} == {1: 5, 2: None, 3: None}
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "whole.pdf").write_bytes(b"%PDF-1.4\n" + b"x" * 3000 + b"\n%%EOF\n")
    (tmp_path / "pdf" / "cut.pdf").write_bytes(b"%PDF-1.4\n" + b"x" * 3000)
    (tmp_path / "pdf" / "empty.pdf").write_bytes(b"")
    assert {r.name: (r.size, r.whole) for r in files.attachments(spark, f"{tmp_path}/pdf").collect()} == {"whole.pdf": (3016, True), "cut.pdf": (3009, False)}
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.json").write_text('{"name": "x", "rank": 1}\nbroken\n{"name": "y"}\n')
    assert {(r.name, r["rank"]) for r in files.profiles(spark, f"{tmp_path}/rules", "name string, rank int").collect()} == {("x", 1), ("y", None)}


def test_graphs_with_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "parent long, child long")
    pages = spark.createDataFrame([(0, "root"), (1, "m"), (2, "m"), (3, "m"), (4, "m"), (5, "m"), (6, "m")], "url long, kind string")
    got = {r.url: (r.top, r.reason) for r in hierarchy.trails(pages, edges).collect()}
    assert got[6] == (6, "no_parent") and got[0] == (0, "root_reached") and all(got[i] == (None, "cycle") for i in (1, 2, 3, 4, 5))
    assert {tuple(r) for r in scope.reachable_pairs(edges, spark.createDataFrame([(1,), (4,), (5,)], "node long")).collect()} == {(1, 2), (1, 3), (1, 4)}
    draw = random.Random(1)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)]
    top = list(range(200))
    for _ in range(200):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    found = {r.node: r.component for r in hierarchy.connected(spark.createDataFrame(links, "a int, b int")).collect()}
    assert found == {i: top[i] for a, b in links if a != b for i in (a, b)}
    assert hierarchy.all_chains(edges, spark.createDataFrame([(4,)], "node long")).count() == 0 and graphs.degrees(edges).count() == 5


def test_arguments():
    assert scope.normalised({"view": "archived", "mailbox": "trash"}) == {"period": "all", "mailbox": "inbox"}
    assert scope.normalised({"view": "focus", "mailbox": "archived", "period": "week"}) == {"period": "week", "mailbox": "inbox"}
    assert scope.normalised({"view": "focus", "mailbox": "saved"}) == {"mailbox": "saved", "period": "all"}
    assert scope.normalised({}) == {"mailbox": "inbox", "period": "week"} and scope.normalised({"view": "trash", "period": "x"})["period"] == "week"
    assert [schedule.route_turn(n, 4, 3) for n in (1, 3, 4, 12)] == ["rank", "branch", "oldest", "oldest"]


def test_merges_touch_some_buckets(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    first = [(k, start, 0) for k in range(40)]
    df = spark.createDataFrame(first, "k long, at timestamp, v int")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for number, rows in enumerate(([*first], [(3, start + dt.timedelta(1), 1), (99, start, 2)], [(3, start - dt.timedelta(1), 5)])):
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events.merge_stream(stream, f"{tmp_path}/out", ["k"], "at", f"{tmp_path}/c").awaitTermination()
        got = {r.k: r.v for r in events.merged(spark, f"{tmp_path}/out", df.schema, number).collect()}
        assert got == ({k: 0 for k in range(40)} if number == 0 else {k: 0 for k in range(40)} | {3: 1, 99: 2})
    assert len(list((tmp_path / "out" / "version=1").glob("bucket=*"))) <= 2
