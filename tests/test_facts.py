"""Typed facts: proofs, gaps, bindings and what follows, on small sites."""

from pyspark.sql import functions as F

from noticeweave.operators import facts

PAGES = "site int, url string, state string, content_hash string, checked_at string, retained boolean"
DEPARTMENTS = "site int, id int, kind string, structure_key string, url string, config string, config_at string"
CLAIM = "site int, reference string, locator string, hash string, at string"
RECORDS = CLAIM + ", node_key string, parent_key string, relation string, url string, department int"
ENTRIES = CLAIM + ", id int, parent int, child int, type string, observed string, node_key string, config string, receipt string, writer string, assertion struct<kind: string, predicate: string, direction: string, locator: string, child_locator: string, entry_url: string>"
HEADER = ("explicit_table_header", "subordinate_unit", "parent_to_child", "th", "td", None)
OWNER = ("explicit_publisher_identity", "publication_owner", "publisher_to_source", "h1", "a", "s")
UNITS = [(1, 1, "unit", "A", None, None, None), (1, 2, "unit", "B", None, None, None), (1, 3, "column", None, "s", "c", None), (1, 4, "unit", "A2", None, None, None)]


def build(spark, *, pages=((1, "p", "fetched", "h", "t", None),), departments=UNITS, records=(), edges=(), entries=(), receipts=((1, 3, "c", "r"),)):
    df = lambda rows, kind: spark.createDataFrame(list(rows), kind)
    r, g = facts.structure_facts(
        df(pages, PAGES), df(departments, DEPARTMENTS), df(records, RECORDS), df(edges, CLAIM + ", target string"), df(entries, ENTRIES), df(receipts, "site int, department int, config string, receipt string")
    )
    return {(x.source, x.target, x.type, len(x.proofs)) for x in r.collect()}, sorted((x.code, x.subject, x.other) for x in g.collect())


def claim(at="p", locator="x", digest="h", when=None):
    return (1, at, locator, digest, when)


def entry(ident, parent, child, kind, assertion, locator, *, observed="sub_unit", digest="h", writer="hand", config="c", receipt="r", node_key=None):
    return (*claim(locator=locator, digest=digest), ident, parent, child, kind, observed, node_key, config, receipt, writer, assertion)


def test_links_need_their_material(spark):
    edges = [(*claim(locator="a"), "q"), (*claim(locator="b"), "q"), (*claim(digest="old"), "q"), (*claim(locator=" "), "q"), (*claim(at="no", when="t"), "q"), (*claim(), "p")]
    rows, gaps = build(spark, edges=edges)
    links = [r for r in rows if r[2] == "navigation_link"]
    assert len(links) == 1 and links[0][3] == 2  # two proofs of one relation; nothing links itself
    assert [g[0] for g in gaps] == ["incomplete_web_evidence", "stale_or_unavailable_material", "stale_or_unavailable_material"]
    assert any(r[1:3] == ("source:3", "source_on_page") for r in rows)
    _, gone = build(spark, edges=[(*claim(), "q")], pages=[(1, "p", "fetched", "h", "t", False)])
    assert [g[0] for g in gone] == ["original_material_not_retained"]


def record(key, relation="directory_entry", parent=None, locator="li", url="", department=None):
    return (*claim(locator=locator), key, parent, relation, url, department)


def test_records_are_bound_by_keys_only(spark):
    rows, gaps = build(spark, records=[record("A", url="w"), record("Z", locator="z"), record("A", parent="nobody", locator="y")])
    listed = {r[:2] for r in rows if r[2] == "directory_listing"}
    assert {t.split(":")[0] + t[-2:] * t.startswith("entity") for _, t in listed} == {"entity:A", "observation"} and ("entity:1:A", "entity_page") in {(r[0], r[2]) for r in rows}
    assert gaps == [("missing_or_ambiguous_structural_parent", "entity:1:A", "p")]
    twice = [*UNITS, (1, 5, "unit", "A", None, None, None)]  # two entities with one key: none
    rows, _ = build(spark, departments=twice, records=[record("A")])
    assert {r[1].split(":")[0] for r in rows if r[2] == "directory_listing"} == {"observation"}
    _, gaps = build(spark, records=[record("A", department=3), record("A", department=99, locator="k")])
    assert [g[:2] for g in gaps] == [("unresolved_entity_binding", "3"), ("unresolved_entity_binding", "99")]


def test_memberships_need_one_material_for_header_and_child(spark):
    good = [entry(7, 1, 2, "organization_membership", HEADER, at) for at in ("th", "td")]
    raw = [record("A"), record("B", "sub_unit", parent="A")]
    rows, gaps = build(spark, entries=good, records=raw)
    assert ("entity:1:A", "entity:1:B", "organization_membership", 2) in rows and gaps == []  # which settles the record's raw claim
    _, gaps = build(spark, entries=good[:1], records=raw)
    assert [g[0] for g in gaps] == ["organization_assertion_unverified"] * 2
    for change, code in ((dict(kind="other"), "legacy_membership_without_evidence"), (dict(child=99), "missing_membership_endpoint"), (dict(child=3), "invalid_organization_endpoints"), (dict(observed=None), "organization_claim_not_explicit")):
        told = {"kind": "organization_membership", "child": 2, "observed": "sub_unit"} | change
        both = [entry(7, 1, told["child"], told["kind"], HEADER, at, observed=told["observed"]) for at in ("th", "td")]
        assert [g[0] for g in build(spark, entries=both)[1]] == [code]


def test_ownership_needs_a_current_receipt_and_places(spark):
    own = lambda **more: [entry(8, 1, 3, "source_ownership", OWNER, at, writer="official_structure", **more) for at in ("h1", "a")]
    rows, gaps = build(spark, entries=own())
    assert ("entity:1:A", "source:3", "source_ownership", 2) in rows and gaps == []
    assert [g[0] for g in build(spark, entries=own(receipt="other"))[1]] == ["ownership_receipt_not_current"]
    assert [g[0] for g in build(spark, entries=own()[:1])[1]] == ["publisher_identity_assertion_unverified"]


def test_what_follows_ends_in_cycles(spark):
    kind = "site int, source string, target string, type string"
    chain = [(1, f"e{i}", f"e{i + 1}", "organization_membership") for i in range(9)] + [(1, "e9", "e0", "organization_membership"), (1, "e9", "s", "source_ownership"), (2, "e3", "s", "source_ownership")]
    got = {(r.source, r.target, r.type): r.steps for r in facts.derived(spark.createDataFrame(chain, kind)).where("site = 1").collect()}
    assert {k: v for k, v in got.items() if k[2] == "source_below"} == {(f"e{i}", "s", "source_below"): 10 - i for i in range(9)}
    assert got[("e0", "e2", "organization_ancestry")] == 2 and got[("e1", "e0", "organization_ancestry")] == 9
    assert facts.derived(spark.createDataFrame([], kind)).count() == 0
    ways = facts.derived(spark.createDataFrame(chain[:2], kind)).select(F.explode("ways").alias("w")).select("w.middle").collect()
    assert [w.middle for w in ways] == ["e1"]
