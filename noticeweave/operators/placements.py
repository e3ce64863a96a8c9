"""Who owns an address or a name by its beginning, and where a source stands in a directory.

A path lies in another if that is one of its prefixes, so every path is taken apart into its prefixes, which are joined by equality of host and
prefix: as many rows as paths are deep, and no pairs of all paths of a host. Names go by the places of a separator.
Owners are one row for each host and prefix before the join; two of one prefix are a tie, which gives nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeweave.functions.scalars import host, path, same_page_key, scope_path
from noticeweave.operators.graphs import _kept

# What separates an owner's name from a column's, evidence that places sources, relations that name a group of units.
SEPARATORS = ("-", "－", "—")
BASES = ("official_website_entry", "official_directory_navigation")
SCHOOL_ENTRY = "school_website_entry"
GROUP_RELATIONS = ("page_identity", "menu_group", "directory_group", "academic_group", "campus_group")


def prefixes(value: Column, separator: str = "/") -> Column:
    """All beginnings of a path that end before a separator or at its end, the shortest first: /a/b has '', /a and /a/b."""
    parts = F.split(value, "[" + separator + "]", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))


def contained(inner: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """inner_id, outer_id for paths that are another one or under it, of the same key. Both: key, id, path; '/' at the end of an outer path doesn't count."""
    o = outer.select(key, F.col("id").alias("outer_id"), F.rtrim("path", F.lit("/")).alias("prefix"))
    return inner.select(key, F.col("id").alias("inner_id"), F.explode(prefixes(F.col("path"))).alias("prefix")).join(o, [key, "prefix"]).select("inner_id", "outer_id")


def deepest(rows: DataFrame, owners: DataFrame, keys: list[str], found: Column) -> DataFrame:
    """id and owner of rows (keys, id and what found is made of): the owner (keys, prefix, owner) of the longest of the prefixes in found, if it has only one."""
    one = owners.groupBy(*keys, "prefix").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
    held = rows.select(*keys, "id", F.explode(found).alias("prefix")).join(one, [*keys, "prefix"])
    best = held.groupBy("id").agg(F.max(F.struct(F.char_length("prefix").alias("n"), "owner", "other")).alias("m"))
    return best.where("m.owner = m.other").select("id", "m.owner")


def longest_owner(names: DataFrame, owners: DataFrame, key: str, separator: str = "-") -> DataFrame:
    """id, name and owner_id: the owner of the same key whose name and a separator the row's name begins with, the only longest, or null."""
    every = prefixes(F.col("name"), separator)
    found = deepest(names, owners.select(key, F.col("name").alias("prefix"), F.col("id").alias("owner")), [key], F.slice(every, F.lit(1), F.size(every) - 1))
    return names.select("id", "name").join(found.withColumnRenamed("owner", "owner_id"), "id", "left")


def website_owners(sources: DataFrame, units: DataFrame) -> DataFrame:
    """source and unit whose website's path is the source's or above it on the same host: the only longest one, or none. Both: id, host, path."""
    o = units.select("host", F.regexp_replace("path", "/+$", "").alias("prefix"), F.col("id").alias("owner"))
    return deepest(sources, o, ["host"], prefixes(F.col("path"))).select(F.col("id").alias("source"), F.col("owner").alias("unit"))


def address_owners(sources: DataFrame, units: DataFrame) -> DataFrame:
    """source and unit (both id, url) by whole addresses: units whose address has a query or a route own that page only, others what is below their entrance."""
    routed = F.col("url").rlike(r"[?#]")
    site = F.concat(host_and_port(F.col("url")), F.lit("|"))
    exact = units.where(routed).select(F.concat(F.lit("="), same_page_key(F.col("url"))).alias("prefix"), F.col("id").alias("owner"))
    below = units.where(~routed).select(F.concat(site, scope_path(path(F.col("url")))).alias("prefix"), F.col("id").alias("owner"))
    inside = F.transform(prefixes(path(F.col("url"))), lambda p: F.concat(site, p))
    # An exact page beats any place above it.
    page = F.concat(F.lit("="), same_page_key(F.col("url")))
    one = exact.unionByName(below).groupBy("prefix").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
    held = sources.select("id", F.explode(F.concat(inside, F.array(page))).alias("prefix")).join(one, "prefix")
    rank = F.struct(F.startswith("prefix", F.lit("=")).alias("exact"), F.char_length("prefix").alias("n"), "owner", "other")
    return held.groupBy("id").agg(F.max(rank).alias("m")).where("m.owner = m.other").select(F.col("id").alias("source"), F.col("m.owner").alias("unit"))


def host_and_port(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#]*)", 1))


def within_unit(source: Column, unit: Column, school: Column) -> Column:
    """Whether a source's address lies in a unit's website, which isn't the school's own; an address with a query or route only has itself."""
    base = scope_path(path(unit))
    below = (path(source) == base) | F.startswith(path(source), F.concat(base, F.lit("/")))
    inside = F.when(unit.rlike(r"[?#]"), same_page_key(source) == same_page_key(unit)).otherwise(below)
    return (host(unit) != "") & (same_page_key(unit) != same_page_key(school)) & (host_and_port(source) == host_and_port(unit)) & inside


def named_owner(name: Column, group: Column, units: Column) -> Column:
    """Whether a source's group is the last unit's name, or its name is that of the unit or its chain, alone or before a separator."""
    last, chain = F.element_at(units, -1), F.array_join(units, "-")
    beginnings = [(name == p) | reduce(lambda a, b: a | b, (F.startswith(name, F.concat(p, F.lit(s))) for s in SEPARATORS)) for p in (last, chain)]
    return (group == last) | beginnings[0] | beginnings[1]


def unit_key(school: Column, url: Column, name: Column) -> Column:
    """One identity for a unit, in whatever document it is seen."""
    site = F.substring(F.sha2(school, 256), 1, 20)
    return F.substring(F.sha2(F.concat_ws("\u0000", site, url, name), 256), 1, 24)


def _candidates(sources: DataFrame, paths: DataFrame, groups: DataFrame) -> DataFrame:
    """Paths that can place their source: school, id, group, known (whether the school has that group), current, named, way (keys, names and urls of units), entries, path."""
    s = sources.select(
        "id", "school", "school_url", F.coalesce(F.trim("name"), F.lit("")).alias("s_name"), F.coalesce(F.trim("group_name"), F.lit("")).alias("current"), F.col("url").alias("s_url")
    ).where((host(F.col("url")) != "") & (same_page_key(F.col("url")) != same_page_key(F.col("school_url"))))
    rows = paths.withColumnRenamed("source", "id").join(s, "id")
    nodes = F.col("nodes")
    is_unit = lambda n: (n["kind"] == "unit") & (F.trim(n["name"]) != "")
    units = F.filter(nodes, is_unit)
    first = F.array_position(F.transform(nodes, is_unit), True)
    group = F.filter(F.slice(nodes, F.lit(1), F.greatest(F.lit(0), first.cast("int") - 1)), lambda n: (n["kind"] == "group") & n["relation"].isin(*GROUP_RELATIONS) & (F.trim(n["name"]) != ""))
    rows = rows.withColumns({"units": units, "names": F.transform(units, lambda n: F.trim(n["name"])), "group": F.coalesce(F.trim(F.get(group, F.lit(0))["name"]), F.lit(""))})
    has_units = F.size("units") > 0
    last_url = F.when(has_units, F.element_at("units", -1)["url"])
    rows = rows.withColumns({"named": has_units & named_owner(F.col("s_name"), F.col("current"), F.col("names")), "last_url": last_url})
    # A page that the whole school links keeps its place at the school, but for a unit's own homepage.
    entrance = rows.where((F.col("basis") == SCHOOL_ENTRY) & (F.size(F.coalesce("nodes", F.array().cast(paths.schema["nodes"].dataType))) == 0)).select("id").distinct().withColumn("entrance", F.lit(True))
    rows = rows.join(entrance, "id", "left")
    own_home = F.col("named") & (same_page_key(F.coalesce("last_url", F.lit(""))) == same_page_key(F.col("s_url")))
    rows = rows.where((F.col("entrance").isNull() | own_home) & F.col("basis").isin(*BASES) & ~F.exists("nodes", lambda n: n["kind"] == "major") & has_units & (F.col("group") != ""))
    known = groups.select("school", F.trim("group").alias("group"), F.lit(True).alias("known")).where("group <> ''").distinct()
    rows = rows.join(known, ["school", "group"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    suits = F.col("known") | (F.col("current") == "") | F.array_contains("names", F.col("current"))
    site = F.coalesce(F.nullif(F.coalesce("website_url", F.lit("")), F.lit("")), F.col("last_url"))
    rows = rows.where(suits & (F.col("named") | F.coalesce(within_unit(F.col("s_url"), site, F.col("school_url")), F.lit(False))))
    n = F.size("units")
    way = F.transform(
        "units",
        lambda u, i: F.struct(
            unit_key(F.col("school_url"), F.coalesce(u["url"], F.lit("")), F.trim(u["name"])).alias("key"), F.trim(u["name"]).alias("name"), F.coalesce(F.when(i == n - 1, site).otherwise(u["url"]), F.lit("")).alias("url")
        ),
    )
    return rows.select("id", "group", "known", "current", "named", way.alias("way"), F.coalesce(F.size("entry_nodes"), F.lit(0)).alias("entries"), "path")


def source_placements(sources: DataFrame, paths: DataFrame, groups: DataFrame) -> DataFrame:
    """Where each source stands: id, group, way (units from the outermost, with key, name and url) and path (the nearest one that shows it).

    sources: id, school, school_url, name, group_name, url; paths: source, path (its id), basis, website_url, entry_nodes, nodes (kind, relation,
    name, url from the top); groups: school, group (those that are established). A source may have several placements; conflicting ones give none:

    - groups: established ones go before others, of which there may be only one; the source's own group goes before all;
    - a website that several units share: the units that the source is named after, the most specific of them if there is only one, or
      else the units that all their ways begin with, if the last of these has that website.

    No pairs are made: what extends another way is found by the ways' beginnings, and what all ways of a website begin with by counts of beginnings.
    """
    each = _kept(_candidates(sources, paths, groups))
    per = each.groupBy("id").agg(
        F.bool_or("known").alias("any_known"), F.min("group").alias("g1"), F.max("group").alias("g2"), F.bool_or((F.col("group") == F.col("current")) & (F.col("current") != "") & F.col("known")).alias("own_known"),
        F.bool_or((F.col("group") == F.col("current")) & (F.col("current") != "")).alias("own"),
    )
    kept = each.join(per, "id").where(F.when(F.col("any_known"), F.col("known")).otherwise(F.col("g1") == F.col("g2")))
    kept = kept.where(~F.when(F.col("any_known"), F.col("own_known")).otherwise(F.col("own")) | (F.col("group") == F.col("current")))
    keys = F.transform("way", lambda u: u["key"])
    once = kept.withColumn("keys", keys).groupBy("id", "group", "keys").agg(F.min_by(F.struct("way", "path", "named"), F.struct("entries", "path")).alias("w")).select("id", "group", "keys", "w.*")
    url = F.element_at("way", -1)["url"]  # without an address a unit shares no website with others
    placed = once.withColumn("site", F.when(host(url) != "", same_page_key(url)).otherwise(F.concat_ws("\u0000", F.lit(""), "group", "keys")))
    placed = _kept(placed)
    pools = placed.groupBy("id", "site").agg(F.min(F.element_at("keys", -1)).alias("k1"), F.max(F.element_at("keys", -1)).alias("k2"), F.bool_or("named").alias("any_named"), F.count(F.lit(1)).alias("n"))
    joined = placed.join(pools, ["id", "site"])
    alone = joined.where("k1 = k2")
    named = joined.where("k1 <> k2 and named")
    begun = named.select("id", "site", F.explode(F.transform(F.sequence(F.lit(1), F.size("keys")), lambda i: F.struct(i.alias("i"), F.slice("keys", F.lit(1), i).alias("keys"), F.size("keys").alias("size")))).alias("b"))
    longer = begun.where("b.i < b.size").select("id", "site", "b.keys").distinct()
    specific = named.join(longer, ["id", "site", "keys"], "left_anti")
    one = specific.groupBy("id", "site").agg(F.count_distinct(F.element_at("keys", -1)).alias("m")).where("m = 1").select("id", "site")
    specific = specific.join(one, ["id", "site"], "left_semi")
    shared = joined.where("k1 <> k2 and not any_named")
    heads = shared.select("id", "site", "n", F.posexplode("way").alias("i", "u"), "keys", "path")
    heads = heads.groupBy("id", "site", "n", F.slice("keys", F.lit(1), F.col("i") + 1).alias("keys")).agg(F.count(F.lit(1)).alias("m"), F.min_by("u.url", "path").alias("url")).where("m = n")
    common = heads.groupBy("id", "site").agg(F.max(F.struct(F.size("keys").alias("size"), "url")).alias("h")).where(same_page_key(F.col("h.url")) == F.col("site")).select("id", "site", F.col("h.size").alias("size"))
    above = shared.join(common, ["id", "site"]).groupBy("id", "site", "group").agg(F.min_by(F.struct(F.slice("way", F.lit(1), F.col("size")).alias("way"), "path"), "path").alias("w")).select("id", "group", "w.way", "w.path")
    columns = ["id", "group", "way", "path"]
    return alone.select(*columns).unionByName(specific.select(*columns)).unionByName(above.select(*columns))


def bridged_placements(sources: DataFrame, paths: DataFrame, groups: DataFrame) -> DataFrame:
    """Placements of sources that no path of their own places: a stored unit (name and group) whose address lies in the website of one unit of that name in the school's paths.

    Paths of a unit are looked up by school and name; each unit's way is one row, however many columns show it.
    """
    done = source_placements(sources, paths, groups).select("id").distinct()
    entrance = paths.where((F.col("basis") == SCHOOL_ENTRY) & (F.size("nodes") == 0)).select(F.col("source").alias("id")).distinct()
    left = sources.where((F.trim("group_name") != "") & (F.trim("name") != "")).join(done, "id", "left_anti").join(entrance, "id", "left_anti")
    units = F.filter("nodes", lambda n: (n["kind"] == "unit") & (F.trim(n["name"]) != ""))
    of_school = paths.join(sources.select(F.col("id").alias("source"), "school"), "source").where(F.col("basis").isin(*BASES) & (F.size(units) > 0))
    ways = of_school.groupBy("school", F.trim(F.element_at(units, -1)["name"]).alias("unit"), "nodes").agg(F.min(F.struct("path", "basis", "website_url", "entry_nodes")).alias("p")).select("school", "unit", "nodes", "p.*")
    tried = left.select("id", "school", "school_url", "url", F.trim("name").alias("unit")).join(ways, ["school", "unit"]).where(F.coalesce(within_unit(F.col("url"), F.element_at(units, -1)["url"], F.col("school_url")), F.lit(False)))
    # Each way is tried on its own, as if it were the source's only path.
    alone = tried.select(F.struct("id", "path").alias("source"), "path", "basis", "website_url", "entry_nodes", "nodes")
    as_sources = left.join(tried.select("id", "path"), "id").withColumn("id", F.struct("id", "path"))
    found = source_placements(as_sources, alone, groups).select(F.col("id.id").alias("id"), "group", "way", "path").join(left.select("id", F.trim("group_name").alias("current")), "id").where(F.col("group") == F.col("current"))
    key = F.element_at("way", -1)["key"]
    only = found.groupBy("id").agg(F.min(key).alias("k1"), F.max(key).alias("k2")).where("k1 = k2").select("id")
    first = F.row_number().over(W.partitionBy("id", F.transform("way", lambda u: u["key"])).orderBy("path"))
    return found.join(only, "id", "left_semi").withColumn("nth", first).where("nth = 1").select("id", "group", "way", "path")
