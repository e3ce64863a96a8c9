"""Trees that are shown: copies of one entrance become one branch, equal branches are shown once, and branches that say nothing more are retired.

Trees are rows (unit, parent) and go level by level, whatever is in them: entrances are merged from the top, since the children of merged units become
siblings; digests of branches are made from the leaves, each of its unit and its children's digests, so equal branches have equal digests.
Whether one set of sources is in another is asked only of sets that have its rarest source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeweave.operators.graphs import _kept

#: What organises the picker only, and what publishes by evidence: units of the second kind are never merged.
DISPLAY, VERIFIED = "display_directory", "verified_owner"


def entrance(name: Column, url: Column, navigation: Column) -> Column:
    """The identity of a unit that is only shown: its name with its address, or with the record that it stands for; null without both."""
    told = F.when(url != "", F.concat_ws("\u0000", F.lit("entrance"), name, url))
    return told.when(F.startswith(navigation, F.lit("record:")), F.concat_ws("\u0000", F.lit("record"), name, navigation))


def _addressed(units: DataFrame, siblings: list[str]) -> DataFrame:
    """units with the addresses that preset headings take from the only address of units of their name among their siblings."""
    shown = (F.col("basis") == DISPLAY) & F.col("expandable") & (F.col("url") != "")
    among = W.partitionBy(*siblings, "name")
    one = F.min(F.when(shown, F.col("url"))).over(among), F.max(F.when(shown, F.col("url"))).over(among)
    return units.withColumn("url", F.when(F.col("preset") & (F.col("url") == "") & (one[0] == one[1]), one[0]).otherwise(F.col("url")))


def merged_entrances(units: DataFrame) -> DataFrame:
    """units with kept: the first unit of the same entrance among the siblings (those of merged parents included), and above: the kept unit of the parent.

    units: tree, unit, parent (null at the top), nth (order), name, basis, expandable, url, navigation, preset. Units that are no displays stay as they are.
    """
    units = _addressed(units.fillna("", ["url", "navigation"]), ["tree", "parent"])
    level, done = _kept(units.where("parent is null").withColumn("above", F.col("parent"))), None
    depth = 0
    while not level.isEmpty():
        level = _addressed(level, ["tree", "above"])
        same = F.when((F.col("basis") == DISPLAY) & F.col("expandable"), entrance(F.col("name"), F.col("url"), F.col("navigation")))
        among = W.partitionBy("tree", "above", same)
        kept = F.when(same.isNull(), F.col("unit")).otherwise(F.min(F.struct("nth", "unit")).over(among)["unit"])
        level = _kept(level.withColumns({"kept": kept, "depth": F.lit(depth)}))
        done = level if done is None else done.unionByName(level)
        depth += 1
        above = level.select("tree", F.col("unit").alias("parent"), F.col("kept").alias("above"))
        level = _kept(units.join(above, ["tree", "parent"]))
    return done if done is not None else level.withColumns({"kept": F.col("unit"), "depth": F.lit(0)})


def folded_trees(units: DataFrame, sources: DataFrame) -> DataFrame:
    """tree, unit, above, name, basis, expandable, url, depth, own (sources in order) and digest of the units that are shown.

    units as in merged_entrances; sources: tree, unit, source. Of siblings that are only shown, have no address and have equal branches the first stays. A
    branch is its name, address and own sources, its children's branches, and its own identity if it publishes.
    """
    merged = _kept(merged_entrances(units))
    own = sources.join(merged.select("tree", "unit", "kept"), ["tree", "unit"]).groupBy("tree", F.col("kept").alias("unit")).agg(F.array_sort(F.collect_set("source")).alias("own"))
    once = merged.where("unit = kept").drop("kept", "parent").join(own, ["tree", "unit"], "left").withColumn("own", F.coalesce("own", F.array().cast(own.schema["own"].dataType)))
    once = _kept(once)
    below, out = None, None
    for depth in range((once.agg(F.max("depth")).first()[0] or 0), -1, -1):
        here = once.where(F.col("depth") == depth)
        if below is None:
            here = here.withColumn("inner", F.array().cast("array<string>"))
        else:
            inner = below.groupBy("tree", F.col("above").alias("unit")).agg(F.array_sort(F.collect_list("digest")).alias("inner"))
            here = here.join(inner, ["tree", "unit"], "left").withColumn("inner", F.coalesce("inner", F.array().cast("array<string>")))
        identity = F.when(F.col("basis") == VERIFIED, F.col("unit").cast("string")).otherwise("")
        told = F.to_json(F.struct(identity.alias("i"), "name", "url", "own", "inner"))
        folds = (F.col("basis") == DISPLAY) & F.col("expandable") & (F.col("url") == "")
        # units that don't fold are alone in their partition
        among = W.partitionBy("tree", "above", "digest", "folds", F.when(~F.col("folds"), F.col("unit"))).orderBy("nth", "unit")
        below = here.withColumns({"digest": F.sha2(told, 256), "folds": folds}).withColumn("place", F.row_number().over(among))
        below = _kept(below.where("place = 1").drop("place", "folds", "inner"))
        out = below if out is None else out.unionByName(below)
    # what is in a branch that was folded went with it
    shown, level = None, _kept(out.where("above is null"))
    while not level.isEmpty():
        shown = level if shown is None else shown.unionByName(level)
        level = _kept(out.join(level.select("tree", F.col("unit").alias("above")), ["tree", "above"]).select(*level.columns))
    return shown if shown is not None else level


def branch_sources(shown: DataFrame) -> DataFrame:
    """tree, unit (at the top) and source: all that a branch shows."""
    at = shown.select("tree", F.col("unit").alias("top"), "unit", "above").where("above is null")
    out = None
    while True:
        level = _kept(at.select("tree", "top", "unit"))
        if level.isEmpty():
            break
        out = level if out is None else out.unionByName(level)
        at = shown.select("tree", "unit", F.col("above")).join(level.select("tree", "top", F.col("unit").alias("above")), ["tree", "above"])
    if out is None:
        out = level
    return out.join(shown.select("tree", "unit", F.explode("own").alias("source")), ["tree", "unit"]).select("tree", F.col("top").alias("unit"), "source").distinct()


def contained_sets(small: DataFrame, large: DataFrame, keys: list[str], owner: str, item: str, *, proper: bool = False) -> DataFrame:
    """keys and owner of the sets of small whose items are all in some set of large with the same keys (proper: and it has more). Both: keys, owner, item, once each.

    A set is only compared with those that have its rarest item.
    """
    often = large.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("often"))
    told = small.join(often, [*keys, item], "left").groupBy(*keys, owner).agg(
        F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), F.col(item).alias("item"))).alias("rarest"), F.collect_set(item).alias("items")
    )
    sets = large.groupBy(*keys, F.col(owner).alias("other")).agg(F.collect_set(item).alias("o_items"))
    candidates = told.where("rarest.often > 0").select(*keys, owner, F.col("rarest.item").alias(item), F.size("items").alias("n"))
    pairs = candidates.join(large.withColumnRenamed(owner, "other"), [*keys, item]).select(*keys, owner, "other", "n")
    met = pairs.join(sets, [*keys, "other"]).where(F.size("o_items") > F.col("n") if proper else F.size("o_items") >= F.col("n"))
    inside = met.join(told.select(*keys, owner, "items"), [*keys, owner]).where(F.size(F.array_except("items", "o_items")) == 0)
    return inside.select(*keys, owner).distinct()


def retired(shown: DataFrame) -> DataFrame:
    """tree and unit of branches at the top that say nothing more: a single source that a branch has, and a display whose sources are all in a publisher of its name."""
    tops = shown.where("above is null").select("tree", "unit", "name", "basis", "expandable")
    every = _kept(branch_sources(shown).join(tops, ["tree", "unit"]))
    counts = every.groupBy("tree", "unit").agg(F.count(F.lit(1)).alias("n"))
    nested = every.where("expandable").select("tree", "source").distinct()
    leaves = tops.where("not expandable").join(counts, ["tree", "unit"], "left")
    there = every.where("not expandable").join(nested, ["tree", "source"]).groupBy("tree", "unit").agg(F.count(F.lit(1)).alias("m"))
    idle = leaves.join(there, ["tree", "unit"], "left").where(F.coalesce("n", F.lit(0)) == F.coalesce("m", F.lit(0))).select("tree", "unit")
    display, verified = every.where(F.col("expandable") & (F.col("basis") == DISPLAY)), every.where(F.col("expandable") & (F.col("basis") == VERIFIED))
    columns = ["tree", "name", "unit", "source"]
    less = contained_sets(display.select(*columns), verified.select(*columns), ["tree", "name"], "unit", "source").select("tree", "unit")
    bare = tops.where(F.col("expandable") & (F.col("basis") == DISPLAY)).join(counts, ["tree", "unit"], "left_anti")
    publishers = tops.where(F.col("expandable") & (F.col("basis") == VERIFIED)).select("tree", "name").distinct()
    return idle.unionByName(less).unionByName(bare.join(publishers, ["tree", "name"], "left_semi").select("tree", "unit"))


def display_tree(units: DataFrame, sources: DataFrame) -> DataFrame:
    """folded_trees without retired branches and what is in them."""
    shown = _kept(folded_trees(units, sources))
    level = _kept(shown.where("above is null").join(retired(shown), ["tree", "unit"], "left_anti"))
    out = level
    while not level.isEmpty():
        level = _kept(shown.join(level.select("tree", F.col("unit").alias("above")), ["tree", "above"]).select(*out.columns))
        out = out.unionByName(level)
    return out
