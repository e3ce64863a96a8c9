"""Operators that the tables don't show: eviction against a loop, paths, pages, files and streams."""

import datetime as dt
import random

from pyspark.sql import functions as F

from noticeweave.functions.html import canonical, parse, resolve
from noticeweave.operators import graphs, hierarchy, windows
from noticeweave.sources import files
from noticeweave.streaming import events


def test_evictions_like_a_loop(spark):
    draw = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = [(k, i, start + dt.timedelta(days=draw.randrange(30)), draw.randrange(5)) for k in range(40) for i in range(draw.randrange(12))]
    cutoff = start + dt.timedelta(days=3)
    want = set()
    for k in range(40):
        mine = sorted((r[2], r[1], r[3]) for r in data if r[0] == k)
        total = sum(s for *_, s in mine)
        for at, i, size in mine:
            if at < cutoff or total > 9:
                want.add((k, i))
            if total > 9 or at < cutoff:
                total -= size
    df = spark.createDataFrame(data, "k int, i int, at timestamp, size int")
    got = {(r.k, r.i) for r in windows.evictions(df, ["k"], ["at", "i"], "size", 9, cutoff, "at").collect()}
    assert got == want


def test_paths_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (6, 6)], "parent long, child long")
    root = spark.createDataFrame([(1,)], "node long")
    reached = graphs.descendants(edges, root)
    assert {(r.node, r.hops) for r in reached.collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)}
    assert {(r.node, r.parent) for r in graphs.shortest_parents(edges, reached).collect()} == {(2, 1), (3, 1), (4, 2), (4, 3), (5, 4)}
    assert sorted(r.path for r in graphs.bounded_paths(edges, root).collect()) == [[1], [1, 2], [1, 2, 4], [1, 2, 4, 5], [1, 3], [1, 3, 4], [1, 3, 4, 5]]
    assert len(graphs.bounded_paths(edges, root, depth=8, per_node=1).collect()) == 5


def test_all_paths_by_default(spark):
    # four diamonds in a row, and three ways on from the last: 48 to one node
    edges = [(3 * i + a, 3 * i + b) for i in range(4) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3))]
    edges = spark.createDataFrame([*edges, *((12, 20 + i) for i in range(9)), *((20 + i, 30) for i in range(3))], "parent long, child long")
    found = graphs.bounded_paths(edges, spark.createDataFrame([(0,)], "node long"), depth=10)
    assert found.where("node = 30").count() == 48 and found.where("node = 12").count() == 16 and found.distinct().count() == found.count()


def test_tree_begins_at_parents_that_are_no_sources(spark):
    sources = spark.createDataFrame([(5,), (6,), (7,)], "id long")
    directory = spark.createDataFrame([(1, 5), (5, 6)], "parent long, child long")
    got = {(r.id, tuple(r.path)) for r in hierarchy.source_tree(sources, directory, F.lit("all")).collect()}
    assert got == {(5, (1, 5)), (6, (1, 5, 6)), (7, (7,))}


def test_pages():
    page = parse('<title>A &amp; b</title><nav><a href="/x">X</a></nav><script>"</p>"</script><h1>Head</h1><p>One<a href="?a=1">two</a>')
    assert page.title == "A & b" and page.heading == "Head" and page.links == [("/x", "X", True), ("?a=1", "two", False)]
    assert resolve("http://a.b/c/d", "../e") == "http://a.b/e" and resolve("http://a.b/", "javascript:x") == ""
    assert canonical("HTTP://Ä.Example:80/a?utm_x=1&b=2&a=1#top") == "http://xn--4ca.example/a?a=1&b=2"
    assert canonical("https://u:p@a.b/") == "" and canonical("https://a.b:444#/r") == "https://a.b:444/#/r"


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10), (1, 11), (None, 12), (2, 99)], "id long, ref long")
    files.publish(rows.limit(1), f"{tmp_path}/t", 0)
    files.publish(rows, f"{tmp_path}/t", 1)
    assert files.current(spark, f"{tmp_path}/t").count() == 4
    files.export_json(rows, f"{tmp_path}/j", ["id", "ref"])
    back = files.import_json(spark, f"{tmp_path}/j", "id long, ref long").collect()
    assert sorted((r.id or 0, r.ref) for r in back if r._bad is None) == [(0, 12), (1, 10), (1, 11), (2, 99)]
    refs = {"ref": (spark.createDataFrame([(10,), (11,), (12,)], "k long"), "k")}
    assert {r.fault: r.n for r in files.faults(rows, "id", refs).collect()} == {"repeated key": 1, "no key": 1, "ref leads nowhere": 1}


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, start + dt.timedelta(seconds=s), s) for s in (0, 1, 2, 3, 10, 11)] + [(2, start, 0)], "k long, at timestamp, v int")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    events.merge_stream(stream, f"{tmp_path}/out", ["k"], "at", f"{tmp_path}/c1").awaitTermination()
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out/version=0").collect()} == {(1, 11), (2, 0)}
    limited = events.limit_stream(stream, "k", "at", 2, 10)
    limited.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("limited").where("key = 1").orderBy("at").select("allowed").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True]
    assert events.count_in_window([0.0, 5.0], None, 0, 1, 10)[0] == [True, False]
    counted = events.event_windows(rows, "at", "k", "10 seconds", "1 minute").select(F.sum("n")).first()[0]
    assert counted == 7
