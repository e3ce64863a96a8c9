"""Shown trees: entrances merge, equal branches fold, redundant ones go, publishers stay."""

import random

from noticeweave.operators import displays as D

UNIT = "tree int, unit string, parent string, nth int, name string, basis string, expandable boolean, url string, navigation string, preset boolean"


def unit(name, parent=None, *, label=None, basis=D.DISPLAY, url="", record="", nth=0, wide=True, preset=False):
    return (1, name, parent, nth, label or name.rstrip("0123456789"), basis, wide, url, record, preset)


def shown(spark, units, sources, how=D.display_tree):
    u = spark.createDataFrame(units, UNIT)
    s = spark.createDataFrame([(1, x, n) for x, n in sources], "tree int, unit string, source int")
    return {r.unit: (r.above, list(r.own)) for r in how(u, s).collect()}


def test_same_entrance_unions_sources_and_children(spark):
    units = [unit("a1", url="/x"), unit("a2", url="/x", nth=1), unit("c1", "a1", url="/k"), unit("c2", "a2", url="/k", nth=1), unit("d1", "a2", nth=2)]
    got = shown(spark, units, [("a1", 1), ("a2", 1), ("a2", 2), ("c1", 3), ("c2", 4), ("d1", 5)])
    assert got == {"a1": (None, [1, 2]), "c1": ("a1", [3, 4]), "d1": ("a1", [5])}


def test_other_entrances_and_names_stay_apart(spark):
    units = [unit("a1", url="/x"), unit("a2", url="/y", nth=1), unit("b1", url="/x", nth=2), unit("a3", record="record:1", nth=3), unit("a4", record="record:1", nth=4)]
    got = shown(spark, units, [(f"a{i}", i) for i in range(1, 5)] + [("b1", 9)])
    assert got == {"a1": (None, [1]), "a2": (None, [2]), "b1": (None, [9]), "a3": (None, [3, 4])}


def test_publishers_are_never_merged(spark):
    units = [unit("a1", basis=D.VERIFIED, url="/x"), unit("a2", basis=D.VERIFIED, url="/x", nth=1)]
    assert shown(spark, units, [("a1", 1), ("a2", 1)]) == {"a1": (None, [1]), "a2": (None, [1])}


def test_equal_branches_fold_from_the_leaves(spark):
    branch = lambda i: [unit(f"a{i}", nth=i), unit(f"b{i}", f"a{i}"), unit(f"b{i}0", f"a{i}", nth=1), unit(f"c{i}", f"b{i}")]
    own = lambda i, n: [(f"c{i}", n), (f"b{i}", 7)]
    got = shown(spark, branch(1) + branch(2) + branch(3), own(1, 5) + own(2, 5) + own(3, 6))
    assert got == {"a1": (None, []), "b1": ("a1", [7]), "b10": ("a1", []), "c1": ("b1", [5]), "a3": (None, []), "b3": ("a3", [7]), "b30": ("a3", []), "c3": ("b3", [6])}


def test_presets_take_the_only_address(spark):
    units = [unit("a1", url="/x"), unit("a2", preset=True, nth=1), unit("b1", url="/y"), unit("b2", url="/z", nth=1), unit("b3", preset=True, nth=2)]
    got = shown(spark, units, [("a1", 1), ("a2", 2), ("b1", 3), ("b2", 4), ("b3", 5)])
    assert got == {"a1": (None, [1, 2]), "b1": (None, [3]), "b2": (None, [4]), "b3": (None, [5])}


def test_redundant_branches_retire(spark):
    units = [unit("a1", basis=D.VERIFIED), unit("a2", url="/x", nth=1), unit("a3", url="/y", nth=2), unit("b1", nth=3, url="/z"), unit("l1", wide=False), unit("l2", wide=False), unit("k", "a1")]
    got = shown(spark, units, [("a1", 1), ("k", 2), ("a2", 1), ("a2", 2), ("a3", 1), ("a3", 3), ("b1", 1), ("l1", 3), ("l2", 4)])
    # a2 says what a1 shows; a3 has one more; b1 has another name; l1 is in a3, l2 nowhere else
    assert set(got) == {"a1", "k", "a3", "b1", "l2"}


def test_odd_trees(spark):
    assert shown(spark, [], []) == {}
    assert shown(spark, [unit("a1"), unit("x", "gone")], [("zz", 1)]) == {"a1": (None, [])}
    deep = [unit("u0"), *(unit(f"u{i}", f"u{i - 1}") for i in range(1, 12))]
    assert len(shown(spark, deep, [("u11", 1)])) == 12


def test_contained_sets_like_a_loop(spark):
    draw = random.Random(3)
    sets = {(k, o): frozenset(draw.choices(range(12), k=draw.randrange(1, 6))) for k in "xy" for o in range(40)}
    df = spark.createDataFrame([(k, o, i) for (k, o), s in sets.items() for i in s], "k string, o int, i int")
    for proper in (False, True):
        got = {(r.k, r.o) for r in D.contained_sets(df.where("o < 20"), df.where("o >= 20"), ["k"], "o", "i", proper=proper).collect()}
        assert got == {(k, o) for (k, o), s in sets.items() if o < 20 and any((s < t if proper else s <= t) for (j, p), t in sets.items() if j == k and p >= 20)}
