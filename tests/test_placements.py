"""Placements and owners: prefixes by equality, shared websites, conflicts and odd rows."""

from pyspark.sql import functions as F

from noticeweave.operators import placements as P

ROOT = "https://example.edu.cn/"
NODES = "array<struct<kind: string, relation: string, name: string, url: string>>"
PATHS = f"source long, path long, basis string, website_url string, entry_nodes array<string>, nodes {NODES}"


def source(ident=21, name="通知公告", group="地球学院", url=ROOT + "earth/notices/"):
    return (ident, 1, ROOT, name, group, url)


def route(ident=21, path=1, group="院系设置", names=("地球学院",), urls=(ROOT + "earth/",), basis="official_website_entry", entries=(), relation="page_identity", site=None):
    nodes = [("group", relation, group, ROOT + "colleges/"), *(("unit", "directory_entry", n, u) for n, u in zip(names, urls, strict=True))]
    return (ident, path, basis, site, list(entries), nodes)


def ways(spark, sources, paths, groups=("院系设置", "组织机构"), how=P.source_placements):
    s = spark.createDataFrame(sources, "id long, school long, school_url string, name string, group_name string, url string")
    p = spark.createDataFrame(paths, PATHS)
    g = spark.createDataFrame([(1, x) for x in groups], "school long, group string")
    return sorted((r.id, r.group, [u.name for u in r.way], r.path) for r in how(s, p, g).collect())


def test_units_and_groups(spark):
    assert ways(spark, [source()], [route()]) == [(21, "院系设置", ["地球学院"], 1)]
    assert ways(spark, [source(group="")], [route()], groups=("x",)) == [(21, "院系设置", ["地球学院"], 1)]  # the only group, though not established
    assert ways(spark, [source(group="")], [route(), route(path=2, group="组织")], groups=("x",)) == []  # two that aren't conflict
    assert ways(spark, [source(group="")], [route(), route(path=2, group="组织")]) == [(21, "院系设置", ["地球学院"], 1)]
    both = [route(), route(path=2, group="组织机构")]
    assert ways(spark, [source(group="")], both) == [(21, "组织机构", ["地球学院"], 2), (21, "院系设置", ["地球学院"], 1)]
    assert ways(spark, [source(group="组织机构")], both) == [(21, "组织机构", ["地球学院"], 2)]  # its own group goes first
    assert ways(spark, [source(group="招生")], [route(group="其他")]) == []
    assert ways(spark, [source()], [route(entries=("a", "b")), route(path=2, entries=("a",))])[0][3] == 2  # the nearest way


def test_what_places_nothing(spark):
    major = route()
    major = (*major[:5], [*major[5], ("major", "x", "专业", "")])
    for bad in (major, route(basis="other"), route(relation="shared_table_row"), route(names=(" ",)), route(urls=(ROOT + "moon/",), names=("月球学院",)), route(urls=(ROOT,), names=("月球学院",))):
        assert ways(spark, [source()], [bad]) == []
    assert ways(spark, [source(url=ROOT)], [route()]) == ways(spark, [source(url=None)], [route()]) == []
    assert ways(spark, [source()], []) == ways(spark, [], [route()]) == []
    entrance = (21, 9, "school_website_entry", None, [], [])
    assert ways(spark, [source()], [route(), entrance]) == []  # the school links the page
    assert ways(spark, [source(url=ROOT + "earth/")], [route(), entrance]) == [(21, "院系设置", ["地球学院"], 1)]  # but for a unit's homepage


def test_routed_units_own_their_page_only(spark):
    unit = ROOT + "list?unit=3"
    assert ways(spark, [source(name="x", group="", url=unit)], [route(urls=(unit,))]) == [(21, "院系设置", ["地球学院"], 1)]
    assert ways(spark, [source(name="x", group="", url=ROOT + "list")], [route(urls=(unit,))]) == []


def test_shared_websites(spark):
    shared = ROOT + "shared/"
    parent, child = route(names=("甲学院",), urls=(shared,)), route(path=2, names=("甲学院", "乙系"), urls=(shared, shared))
    at = shared + "notices/"
    for name, group in (("乙系-通知公告", "院系设置"), ("甲学院-乙系—新闻", "院系设置"), ("通知公告", "乙系")):
        assert ways(spark, [source(name=name, group=group, url=at)], [parent, child]) == [(21, "院系设置", ["甲学院", "乙系"], 2)]
    # nobody is named: what all have in common, if it has that website
    assert ways(spark, [source(group="", url=at)], [parent, child]) == [(21, "院系设置", ["甲学院"], 1)]
    away = [route(names=("甲学院", n), urls=(ROOT + "a/", shared), path=i) for i, n in enumerate(("乙系", "丙系"))]
    assert ways(spark, [source(group="", url=at)], away) == []
    siblings = [route(names=(n,), urls=(shared,), path=i) for i, n in enumerate(("甲学院", "乙学院"))]
    assert ways(spark, [source(group="", url=at)], siblings) == []
    assert ways(spark, [source(group="乙学院", url=at)], siblings) == [(21, "院系设置", ["乙学院"], 1)]
    assert ways(spark, [source(name="甲学院-x", group="乙学院", url=at)], siblings) == []  # two claims


def test_bridge_by_unit_identity(spark):
    stored = source(30, name="地球学院", group="院系设置", url=ROOT + "earth/")
    other = [route(ident=21), route(ident=22, path=5)]
    rows = [stored, source(21), source(22)]
    assert ways(spark, rows, other, how=P.bridged_placements) == [(30, "院系设置", ["地球学院"], 1)]
    assert ways(spark, [source(31, name="地球学院", group="院系设置", url=ROOT + "moved/"), *rows[1:]], other, how=P.bridged_placements) == []
    two = [*other, route(ident=22, path=6, urls=(ROOT + "earth/index.htm",))]
    assert ways(spark, rows, two, how=P.bridged_placements) == []  # two identities


def test_owners_like_a_loop(spark):
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a//b", "/a/b/c.html", "/x/" + "y/" * 300]
    rows = spark.createDataFrame([(h, i, p) for h in "st" for i, p in enumerate(paths, ord(h) * 100)], "host string, id long, path string")
    inside = lambda p, q: p == q.rstrip("/") or p.startswith(q.rstrip("/") + "/")
    want = {(i, o) for h in "st" for i, p in enumerate(paths, ord(h) * 100) for o, q in enumerate(paths, ord(h) * 100) if inside(p, q)}
    assert {tuple(r) for r in P.contained(rows, rows, "host").collect()} == want
    units = spark.createDataFrame([("s", 1, "/a/"), ("s", 2, "/a/b"), ("s", 3, "/x"), ("s", 4, "/x/"), ("t", 5, "")], "host string, id long, path string")
    got = {r.source - 11500: r.unit for r in P.website_owners(rows.where("host = 's'"), units).collect()}
    assert got == {2: 1, 3: 1, 4: 2, 6: 1, 7: 2}  # /x has two owners, which is none
    assert {r.unit for r in P.website_owners(rows.where("host = 't'"), units).collect()} == {5}
    names = spark.createDataFrame([(1, "k", "a-b-c"), (2, "k", "a"), (3, "k", None), (4, "k", "a--"), (5, "j", "a-b")], "id long, key string, name string")
    owners = spark.createDataFrame([("k", 10, "a"), ("k", 11, "a-b"), ("k", 12, "a-"), ("j", 13, "a"), ("j", 14, "a")], "key string, id long, name string")
    assert {r.id: r.owner_id for r in P.longest_owner(names, owners, "key").collect()} == {1: 11, 2: None, 3: None, 4: 12, 5: None}


def test_a_hot_host_makes_no_pairs(spark):
    """20,000 paths of one host under one owner each: as many rows as paths are deep, counted in the plan's join."""
    n = 20_000
    sources = spark.range(n).select(F.lit("h").alias("host"), "id", F.concat(F.lit("/u"), "id", F.lit("/p")).alias("path"))
    units = spark.range(n).select(F.lit("h").alias("host"), "id", F.concat(F.lit("/u"), "id", F.lit("/")).alias("path"))
    assert P.website_owners(sources, units).where("source = unit").count() == n
