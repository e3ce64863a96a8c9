"""Typed facts of structure: pages, entities and sources, relations with sets of proofs, gaps that say what is missing, and what follows from relations.

A claim counts if the page that it refers to still has the material that it was made from. Claims that don't count aren't dropped: each is a gap
with its reason. Identities come from stored keys and checked bindings only, never from names or addresses that look alike; where several fit, none does.
Relations of one kind between the same two are one row with all their proofs. What follows from relations is derived in rounds, each joining only what the last
round found with what is known, until a round finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeweave.operators.graphs import _kept

# Relations of records that list, that claim a place in an organisation, that group, and that are links; relations that an entry may have.
LISTINGS = (
    "directory_entry", "directory_entry_no_link", "nested_directory_entry", "campus_directory_entry", "non_entity_directory_entry", "directory_companion_entry", "hidden_directory_entry",
)
ORGANISATIONS = ("sub_unit", "attached_unit")
GROUPS = ("page_identity", "menu_group", "directory_group", "academic_group", "campus_group", "publication_group")
LINKS = ("menu_group", "navigation_entry", "unit_channel", "publication_column", "website_entrance", "directory_entry", "hidden_directory_entry", "nested_directory_entry")
ENTRIES = ("directory_listing", "organization_membership", "source_ownership", "cross_entity_reference")
#: What follows: of a fact of the first type that ends where one of the second begins, one of the third.
RULES = (
    ("organization_membership", "organization_membership", "organization_ancestry"),
    ("organization_ancestry", "organization_membership", "organization_ancestry"),
    ("organization_membership", "source_ownership", "source_below"),
    ("organization_ancestry", "source_ownership", "source_below"),
    ("source_ownership", "source_preview", "preview_below"),
)
_PROOF = ("reference", "locator", "hash", "at")
_RELATION = ["site", "source", "target", "type", "observed", "proof"]
_GAP = ["site", "code", "subject", "other"]


def page_id(site: Column, url: Column) -> Column:
    return F.when(url != "", F.concat(F.lit("page:"), site.cast("string"), F.lit(":"), F.substring(F.sha2(url, 256), 1, 24)))


def checked(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """claims with fault: null, or why they don't count, and at from the page where the claim has none.

    claims: site, reference, locator, hash, at, and more; pages: site, url (once each), state, content_hash, checked_at, retained.
    """
    p = pages.select("site", F.col("url").alias("reference"), "state", "content_hash", "checked_at", "retained")
    rows = claims.join(p, ["site", "reference"], "left").withColumn("at", F.coalesce("at", "checked_at"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fault = F.when(blank("reference") | blank("hash") | blank("locator") | F.col("at").isNull(), "incomplete_web_evidence")
    fault = fault.when(F.coalesce((F.col("state") != "fetched") | (F.col("content_hash") != F.col("hash")), F.lit(True)), "stale_or_unavailable_material")
    return rows.withColumn("fault", fault.when(~F.coalesce("retained", F.lit(True)), "original_material_not_retained")).drop("state", "content_hash", "checked_at", "retained")


def _relation(rows: DataFrame, source: Column, target: Column, kind: str, observed: Column | None = None) -> DataFrame:
    told = F.lit(None).cast("string") if observed is None else observed
    return rows.select("site", source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), told.alias("observed"), F.struct(*_PROOF).alias("proof")).where("source <> target")


def _gaps(rows: DataFrame, code: Column | str, subject: Column, other: Column | None = None) -> DataFrame:
    told = F.lit(code) if isinstance(code, str) else code
    return rows.select("site", told.alias("code"), subject.cast("string").alias("subject"), (F.lit(None) if other is None else other).cast("string").alias("other"))


def entities(departments: DataFrame) -> DataFrame:
    """site, department, node, kind (source, organization or directory_group), structure_key, url and config of configured rows."""
    stable = F.coalesce(F.nullif(F.col("structure_key"), F.lit("")), F.col("id").cast("string"))
    column = F.coalesce("kind", F.lit("column")) == "column"
    node = F.when(column, F.concat(F.lit("source:"), F.col("id"))).otherwise(F.concat(F.lit("entity:"), F.col("site"), F.lit(":"), stable))
    kind = F.when(column, "source").when(F.col("kind") == "unit", "organization").otherwise("directory_group")
    return departments.select("site", F.col("id").alias("department"), node.alias("node"), kind.alias("kind"), "structure_key", F.coalesce("url", F.lit("")).alias("url"), "config", "config_at")


def only(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and value where there is one value only."""
    return rows.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__most")).where(F.col(value) == F.col("__most")).drop("__most")


def observed_records(records: DataFrame, pages: DataFrame, known: DataFrame, entries: DataFrame) -> DataFrame:
    """records that count, with node: the page they name, the entity that they are bound to, or an observation of their own; and bound.

    A record is bound by its department, else by the only checked entry of its node on that page, else by the only entity with its key. Sources are never bound.
    """
    good = checked(records, pages).where("fault is null")
    told = F.sha2(F.to_json(F.struct("reference", "node_key", "locator", "parent_key")), 256)
    by_id = known.select("site", "department", F.col("node").alias("by_id"), F.col("kind").alias("id_kind"))
    saved = entries.where("node_key is not null and node_key <> ''").join(known.where("kind <> 'source'").select("site", F.col("department").alias("child"), "node"), ["site", "child"])
    saved = only(saved, ["site", "reference", "node_key"], "node").withColumnRenamed("node", "by_entry")
    keyed = known.where("kind <> 'source' and structure_key <> ''").groupBy("site", F.col("structure_key").alias("node_key")).agg(F.min("node").alias("by_key"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    rows = good.join(by_id, ["site", "department"], "left").join(saved, ["site", "reference", "node_key"], "left").join(keyed, ["site", "node_key"], "left")
    bound = F.when(F.col("department").isNotNull(), F.when(F.col("id_kind") != "source", F.col("by_id"))).otherwise(F.coalesce("by_entry", "by_key"))
    own = F.concat(F.lit("observation:"), F.col("site"), F.lit(":"), F.substring(told, 1, 24))
    node = F.when(F.col("relation") == "page_identity", page_id(F.col("site"), F.col("reference"))).otherwise(F.coalesce(bound, own))
    return rows.withColumns({"bound": bound, "node": node}).drop("by_id", "id_kind", "by_entry", "by_key")


def structure_facts(pages: DataFrame, departments: DataFrame, records: DataFrame, edges: DataFrame, entries: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations (site, id, source, target, type, observed, proofs) and gaps (site, code, subject, other) of many sites at once.

    pages: see checked; departments: site, id, kind, structure_key, url, config (digest), config_at; records: site, reference, node_key, parent_key, relation, url, department and the
    claim's locator, hash, at; edges: site, reference, target and the same; entries: site, parent, child, type, observed, node_key, config, receipt, writer, assertion
    (kind, predicate, direction, locator, child_locator, entry_url) and a claim each: the rows of one entry (id) are its evidence; receipts: site, department, config, receipt.
    """
    known = _kept(entities(departments))
    proofs = _kept(checked(entries, pages))
    seen = _kept(observed_records(records, pages, known, proofs.where("fault is null")))
    relations, gaps = [], []

    # Configurations say where a source is read; edges and records with an address are links of the page they are on.
    configured = known.where("kind = 'source' and url <> '' and config is not null").select(
        "site", "node", "url", F.col("url").alias("reference"), F.concat(F.lit("departments:"), "department").alias("locator"), F.col("config").alias("hash"), F.col("config_at").alias("at")
    )
    relations.append(_relation(configured, page_id(F.col("site"), F.col("url")), F.col("node"), "source_on_page"))
    links = checked(edges, pages)
    here = page_id(F.col("site"), F.col("reference"))
    relations.append(_relation(links.where("fault is null"), here, page_id(F.col("site"), F.col("target")), "navigation_link"))
    relations.append(_relation(seen.where(F.col("relation").isin(*LINKS) & (F.col("url") != "")), here, page_id(F.col("site"), F.col("url")), "navigation_link"))
    relations.append(_relation(seen.where((F.col("relation") != "page_identity") & F.col("bound").isNotNull() & (F.col("url") != "")), F.col("bound"), page_id(F.col("site"), F.col("url")), "entity_page"))
    for claims in (links, checked(records, pages), proofs):
        gaps.append(_gaps(claims.where("fault is not null"), F.col("fault"), F.col("reference"), F.col("locator")))
    gaps.append(_gaps(seen.where("department is not null and bound is null"), "unresolved_entity_binding", F.col("department"), F.col("reference")))

    # A record stands below the only node of its parent on the same page, or below the page.
    parents = only(seen.select("site", "reference", F.col("node_key").alias("parent_key"), F.col("node").alias("above")), ["site", "reference", "parent_key"], "above")
    listed = seen.where(F.col("relation").isin(*LISTINGS, *ORGANISATIONS)).join(parents, ["site", "reference", "parent_key"], "left")
    listed = listed.withColumn("above", F.when(F.coalesce("parent_key", F.lit("")) == "", page_id(F.col("site"), F.col("reference"))).otherwise(F.col("above")))
    gaps.append(_gaps(listed.where("above is null"), "missing_or_ambiguous_structural_parent", F.col("node"), F.col("reference")))
    listed = _kept(listed.where("above is not null"))
    relations.append(_relation(listed, F.col("above"), F.col("node"), "directory_listing", F.col("relation")))
    organised = listed.where(F.col("relation").isin(*ORGANISATIONS))
    kinds = known.where("kind = 'organization'").select("site", "node").distinct()
    above, below = kinds.withColumnRenamed("node", "above").withColumn("a", F.lit(1)), kinds.withColumn("b", F.lit(1))
    organised = organised.join(above, ["site", "above"], "left").join(below, ["site", "node"], "left")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    gaps.append(_gaps(organised.where(~both), "organization_identity_not_bound", F.col("above"), F.col("node")))
    unverified = organised.where(both)

    # Entries: memberships and ownerships need an explicit assertion whose places are among the checked evidence.
    ends = known.select("site", "department", "node", "kind", "url", "config")
    side = lambda name: ends.select("site", *(F.col(c).alias(f"{name}_{c}") for c in ends.columns if c != "site")).withColumnRenamed(f"{name}_department", name)
    rows = proofs.join(side("parent"), ["site", "parent"], "left").join(side("child"), ["site", "child"], "left")
    current = receipts.select("site", F.col("department").alias("child"), F.col("config").alias("child_config"), "receipt").distinct().withColumn("is_current", F.lit(True))
    rows = rows.join(current, ["site", "child", "child_config", "receipt"], "left")
    good, a = F.col("fault").isNull(), F.col("assertion")
    places = F.collect_set(F.when(good, F.struct("reference", "hash", "locator")))
    whole = rows.groupBy("site", "id").agg(F.first("type").alias("type"), F.first("observed").alias("observed"), F.first("parent").alias("parent"), F.first("child").alias("child"), F.first(F.struct(
        a.alias("a"), "parent_node", "child_node", "parent_kind", "child_kind", "child_url", "child_config", "config", "writer", "is_current")).alias("e"), places.alias("places"), F.count("reference").alias("claims"))
    e = F.col("e")
    located = lambda name: F.exists("places", lambda p: p["locator"] == e["a"][name])
    together = F.exists("places", lambda p: (p["locator"] == e["a"]["locator"]) & F.exists("places", lambda q: (q["locator"] == e["a"]["child_locator"]) & (q["reference"] == p["reference"]) & (q["hash"] == p["hash"])))
    expected = F.when(F.col("observed") == "attached_unit", "attached_unit").otherwise("subordinate_unit")
    member, owner = F.col("type") == "organization_membership", F.col("type") == "source_ownership"
    stated = (e["a"]["kind"] == "explicit_table_header") & (e["a"]["predicate"] == expected) & (e["a"]["direction"] == "parent_to_child") & together
    published = (e["a"]["kind"] == "explicit_publisher_identity") & (e["a"]["predicate"] == "publication_owner") & (e["a"]["direction"] == "publisher_to_source") & (e["a"]["entry_url"] == e["child_url"]) & located("locator") & located("child_locator")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    code = (
        F.when(no(F.col("type").isin(*ENTRIES)) | (F.col("claims") == 0), "legacy_membership_without_evidence")
        .when(e["parent_node"].isNull() | e["child_node"].isNull(), "missing_membership_endpoint")
        .when(member & no((e["parent_kind"] == "organization") & (e["child_kind"] == "organization")), "invalid_organization_endpoints")
        .when(member & no(F.col("observed").isin(*ORGANISATIONS)), "organization_claim_not_explicit")
        .when(member & no(stated), "organization_assertion_unverified")
        .when(owner & no((e["parent_kind"] == "organization") & (e["child_kind"] == "source")), "invalid_ownership_endpoints")
        .when(owner & (e["writer"] == "official_structure") & no((e["config"] == e["child_config"]) & e["is_current"]), "ownership_receipt_not_current")
        .when(owner & no(published), "publisher_identity_assertion_unverified")
    )
    judged = _kept(whole.withColumn("code", code))
    gaps.append(_gaps(judged.where("code is not null"), F.col("code"), F.col("parent"), F.col("child")))
    fine = rows.where(good).join(judged.where("code is null").select("site", "id"), ["site", "id"], "left_semi")
    for kind in ENTRIES:
        relations.append(_relation(fine.where(F.col("type") == kind), F.col("parent_node"), F.col("child_node"), kind, F.col("observed")))

    # A typed membership settles the raw claim of the same two on the same material.
    settled = fine.where(F.col("type") == "organization_membership").select("site", F.col("parent_node").alias("above"), F.col("child_node").alias("node"), "reference", "hash").distinct()
    gaps.append(_gaps(unverified.join(settled, ["site", "above", "node", "reference", "hash"], "left_anti"), "organization_assertion_unverified", F.col("above"), F.col("node")))
    every = relations[0]
    for r in relations[1:]:
        every = every.unionByName(r)
    missing = gaps[0]
    for g in gaps[1:]:
        missing = missing.unionByName(g)
    names = ["site", "source", "target", "type", "observed"]
    merged = every.groupBy(*names).agg(F.array_sort(F.collect_set("proof")).alias("proofs"))
    ident = F.concat(F.lit("relation:"), F.substring(F.sha2(F.to_json(F.struct(*names[1:])), 256), 1, 32))
    return merged.select("site", ident.alias("id"), *names[1:], "proofs"), missing.distinct()


def derived(relations: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """site, source, target, type, steps and ways of what follows from relations by rules, to a fixpoint; a thing is not related to itself.

    steps: relations on the shortest way; ways: the pairs of facts (middle, first and second type) that give it directly, each of which has proofs or ways in turn.
    Rounds join only what the last one found.
    """
    spark = relations.sparkSession
    rule = F.broadcast(spark.createDataFrame(list(rules), "left_type string, right_type string, type string"))  # a fixed list
    base = _kept(relations.select("site", "source", "target", "type").distinct().withColumn("steps", F.lit(1)))
    known, new, ways = base, base, None
    key = ["site", "source", "target", "type"]

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.select("site", "source", F.col("target").alias("middle"), F.col("type").alias("left_type"), F.col("steps").alias("s1"))
        b = right.select("site", F.col("source").alias("middle"), "target", F.col("type").alias("right_type"), F.col("steps").alias("s2"))
        found = a.join(rule, "left_type").join(b, ["site", "middle", "right_type"]).where("source <> target")
        return found.select(*key, "middle", "left_type", "right_type", (F.col("s1") + F.col("s2")).alias("steps"))

    while True:
        found = joined(new, known).unionByName(joined(known, new)).distinct()
        ways = _kept(found if ways is None else ways.unionByName(found))
        fresh = found.groupBy(*key).agg(F.min("steps").alias("steps"))
        new = _kept(fresh.join(known, key, "left_anti"))
        if new.isEmpty():
            break
        known = _kept(known.unionByName(new))
    told = ways.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("middle", "left_type", "right_type"))).alias("ways"))
    return known.join(base.select(*key), key, "left_anti").join(told, key).select(*key, "steps", "ways")
