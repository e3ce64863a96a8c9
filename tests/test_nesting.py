"""Elements in elements like loops over random trees, and a page of 50,000 elements."""

import random
import time

from pyspark.sql import functions as F

from noticeweave.functions import elements as E
from noticeweave.operators import nesting as N
from noticeweave.operators import pages as P


def trees(seed, pages=6, most=60):
    """Rows of key, node, last, tag: random trees in document order."""
    draw, rows = random.Random(seed), []
    for key in range(pages):
        n = draw.randrange(1, most)
        parent = [-1] + [draw.choice(range(max(0, i - 5), i)) for i in range(1, n)]
        children = {}
        for i, p in enumerate(parent):
            children.setdefault(p, []).append(i)
        order, last = [], {}

        def walk(i):
            order.append(i)
            for c in children.get(i, []):
                walk(c)
            last[i] = len(order) - 1

        walk(0)
        for node, i in enumerate(order):
            rows.append((key, node, last[i], draw.choice("abc"), draw.randrange(9)))
    return rows


def test_like_loops(spark):
    for seed in (1, 2):
        rows = trees(seed)
        df = spark.createDataFrame(rows, "key int, node int, last int, tag string, v int").repartition(3)
        inside = lambda x, o, own: x[0] == o[0] and (o[1] <= x[1] if own else o[1] < x[1]) and x[1] <= o[2]
        a, b = [r for r in rows if r[3] == "a"], [r for r in rows if r[3] == "b"]
        for own in (False, True):
            got = {(r.key, r.node) for r in df.withColumn("in", N.covered("key", F.col("tag") == "a", own=own)).where("in").collect()}
            assert got == {x[:2] for x in rows if any(inside(x, o, own) for o in a)}
        owners, items = df.where("tag = 'a'"), df.where("tag in ('a', 'b')")
        pairs = sorted((r.key, r.node, r.owner) for r in N.enclosing(owners, items, "key").collect())
        assert pairs == sorted((*x[:2], o[1]) for x in a + b for o in a if inside(x, o, True))
        near = sorted((r.key, r.node, r.owner if r.owner is not None else -1, r.level) for r in N.nearest(owners, items, "key").collect())
        assert near == sorted((*x[:2], max((o[1] for o in a if inside(x, o, True)), default=-1), sum(inside(x, o, True) for o in a)) for x in a + b)
        sums = sorted((r.key, r.node, r.s, r.n) for r in N.sums_inside(df, "key", s=F.col("v"), n=F.when(F.col("tag") == "b", 1)).collect())
        assert sums == sorted((*o[:2], sum(x[4] for x in rows if inside(x, o, False)), sum(inside(x, o, False) for x in b)) for o in rows)
        first = sorted((r.key, r.node, r.found) for r in N.first_inside(owners, df.where("tag = 'b'"), "key", F.col("v")).collect())
        assert first == sorted((*o[:2], min(x for x in b if inside(x, o, True))[4]) for o in a if any(inside(x, o, True) for x in b))
        low = sorted((r.key, r.node) for r in N.innermost(owners, "key").collect())
        assert low == sorted(o[:2] for o in a if not any(inside(x, o, False) for x in a))


def test_empty(spark):
    none = spark.createDataFrame([], "key int, node int, last int, tag string, v int")
    for out in (N.enclosing(none, none, "key"), N.nearest(none, none, "key"), N.sums_inside(none, "key", s=F.col("v")), N.first_inside(none, none, "key", F.col("v")), N.innermost(none, "key")):
        assert out.count() == 0


def test_page_of_50000_elements(spark):
    """A list of 12,000 items in one container beside 3,000 nested menus: detectors take steps for rows, not for pairs."""
    item = "".join(f'<li class="it"><a href="/n/{i}.htm">Notice number {i}</a><span>2024-03-{i % 28 + 1:02}</span></li>' for i in range(12_000))
    menu = "".join(f"<li><a href='/m{i}'>Menu {i}</a><ul><li><a href='/s{i}'>Sub {i}</a></li></ul></li>" for i in range(3_000))
    page = f"<html><body><div class=menu><ul>{menu}</ul></div><div id=main><ul class=list>{item}</ul></div></body></html>"
    texts = spark.createDataFrame([(1, page)], "k int, html string")
    rows = E.elements(E.page_texts(texts, "k", "html"), "k").cache()
    assert rows.count() > 50_000
    began = time.time()
    assert P.notice_lists(P.repeating_blocks(rows, "k"), rows, "k").select("count").collect()[0][0] == 12_000
    assert P.navigation(rows, "k").agg(F.max("level")).collect()[0][0] == 2
    assert P.test_selectors(rows, "k", "ul.list li.it", 20_000).where("warning = ''").count() == 12_000
    assert P.structure(rows, "k").where("relation = 'menu_group'").count() == 3_000
    assert P.main_content(rows, "k").count() <= 1
    assert time.time() - began < 120
    rows.unpersist()
