"""Orders, pages, best rows and sums of scores."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Ranks of kinds of links and of others, what a told value adds, and words of lists of notices.
KINDS = {"root": 0, "directory": 1, "unit": 2, "major": 2, "channel": 3, "navigation": 4}
OTHER_KIND = 4
VALUES = {"relevant": -2, "potential": -1, "mixed": 0, "unknown": 0, "low": 2}
NOTICE_KEYWORDS = (
    "tzgg", "notice", "tongzhi", "gonggao", "announcement", "news", "xwdt", "xwzx", "info", "article", "list", "xinwen", "tongzhigonggao", "ggl", "tzg", "xytz",
)


def newest(tie: str) -> list[Column]:
    """Newest first, undated last, then newest created."""
    return [F.desc_nulls_last("published_at"), F.desc("created_at"), F.col(tie)]


def page(rows: DataFrame, keys: list[str], size: int, number: int = 1, *, tie: str = "id") -> DataFrame:
    """A page of each key's notices: newest first, undated last, then newest created. Ranks are cut before the shuffle."""
    order = W.partitionBy(*keys).orderBy(*newest(tie))
    ranked = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size * number)
    return ranked.where(F.col("place") > size * (number - 1)) if number > 1 else ranked


def best(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first rows of each key."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)


def keyset(rows: DataFrame, keys: list[Column], cursor: tuple[Any, ...], most: int) -> DataFrame:
    """The rows after a cursor, greatest first, with their place: a bounded top-k."""
    after = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))) < F.struct(*(F.lit(v).alias(f"k{i}") for i, v in enumerate(cursor)))
    top = rows.where(after).orderBy(*(k.desc() for k in keys)).limit(most)
    return top.withColumn("place", F.row_number().over(W.orderBy(*(k.desc() for k in keys))))


def pages(total: Column, size: int) -> Column:
    """How many pages there are, one at least."""
    return F.greatest(F.lit(1), F.ceil(total / size))


def preferred(rows: DataFrame, keys: list[str], flags: list[Column], tie: str) -> DataFrame:
    """The row for which the flags hold first, in order: the least tuple of their opposites, as one aggregate."""
    misses = [(~F.coalesce(f, F.lit(False))).alias(f"f{i}") for i, f in enumerate(flags)]
    others = [c for c in rows.columns if c not in keys]
    rank = F.struct(*misses, F.col(tie).alias("tie"), F.struct(*others).alias("row"))
    return rows.groupBy(*keys).agg(F.min(rank).alias("r")).select(*keys, "r.row.*")


def demand(needs: DataFrame, key: str, weight: str, done: str) -> DataFrame:
    """key and the sum of weight / (1 + done), as decimals."""
    share = (F.col(weight).cast("decimal(18,6)") / (F.col(done) + 1).cast("decimal(10,0)")).cast("decimal(24,6)")
    return needs.groupBy(key).agg(F.sum(share).alias("demand"))


def claim_order() -> list[Column]:
    """Tasks as they are claimed: urgent kinds, few claims, long waits."""
    urgent = F.when(F.col("state").isin("error", "purchase"), 0).when(F.col("state") == "click", 1).otherwise(2)
    return [urgent, F.col("queued_at"), F.col("id")]


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order: an ordered dedup."""
    return best(rows, keys, order).drop("place")


def search_page(rows: DataFrame, number: int, size: int = 50, tie: str = "id") -> DataFrame:
    """A page of all found notices, newest first, undated last, as a bounded top-k."""
    order = [F.desc_nulls_last("published_at"), F.desc("created_at"), F.col(tie)]
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size)


def suggestions(rows: DataFrame, most: int = 8, tie: str = "id") -> DataFrame:
    """The first most rows and, by one row more, whether there are others."""
    order = [F.desc_nulls_last("published_at"), F.desc("created_at"), F.col(tie)]
    some = rows.orderBy(*order).limit(most + 1)
    placed = some.withColumn("place", F.row_number().over(W.orderBy(*order)))
    return placed.withColumn("has_more", F.max("place").over(W.partitionBy()) > most).where(F.col("place") <= most)


def clamped_page(rows: DataFrame, order: list[Column], number: int, size: int = 30) -> DataFrame:
    """A page with its number held within those that there are."""
    total = rows.count()
    last = max(1, -(-total // size))
    return rows.orderBy(*order).offset(size * (min(max(1, number), last) - 1)).limit(size)


def best_profile(profiles: DataFrame, key: str) -> DataFrame:
    """Of each page's profiles the one with most valid items, then the most specific, then the first. profiles: key, nth, valid, specificity."""
    return profiles.groupBy(key).agg(F.max(F.struct("valid", "specificity", (-F.col("nth")).alias("first"))).alias("p")).select(key, "p.valid", "p.specificity", (-F.col("p.first")).alias("nth"))


def candidate_order(candidates: DataFrame, key: str) -> DataFrame:
    """place of each candidate: by prior, greatest score, and the order in which they came; none is dropped. candidates: key, nth, prior, score."""
    return candidates.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("prior", F.desc("score"), "nth")))


def route_priority(kind: Column, value: Column) -> Column:
    """The rank of a link's kind, less for one that is told to be relevant, more for one that isn't."""
    ranks, steps = (F.create_map(*(F.lit(x) for pair in table.items() for x in pair)) for table in (KINDS, VALUES))
    return F.coalesce(F.element_at(ranks, kind), F.lit(OTHER_KIND)) + F.coalesce(F.element_at(steps, value), F.lit(0))


def sampled_articles(records: DataFrame, key: str, address: str, attempts: int, target: int) -> DataFrame:
    """Each list's articles to read: different addresses in order, at most attempts, up to the one that makes target good ones. records: key, nth, address, good."""
    once = best(records, [key, address], [F.col("nth")]).drop("place")
    tried = once.withColumn("try", F.row_number().over(W.partitionBy(key).orderBy("nth"))).where(F.col("try") <= attempts)
    before = F.coalesce(F.sum(F.col("good").cast("int")).over(W.partitionBy(key).orderBy("try").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return tried.withColumn("before", before).where(F.col("before") < target).drop("before")


def notice_links(links: DataFrame, key: str, most: int = 10) -> DataFrame:
    """Each page's links that most likely lead to lists of notices, with score in tenths. links: key, node, href, label.

    3 points for each word in the address and 2 in the label, 5 for an address that looks like an index, less 0.02 for each of its characters, less 3 if it looks like an
    article's; rounded to tenths. Of equal scores the first link counts, each address once.
    """
    href, label = F.lower("href"), F.lower("label")
    points = sum((F.when(F.contains(href, F.lit(w)), 300).otherwise(0) + F.when(F.contains(label, F.lit(w)), 200).otherwise(0) for w in NOTICE_KEYWORDS), F.lit(0))
    index = F.endswith(href, F.lit("/")) | F.contains(href, F.lit("index")) | href.rlike(r"/(tzgg|notice|news)\d*/*$")
    hundredths = points + F.when(index, 500).otherwise(0) - 2 * F.char_length("href") - F.when(~index & href.rlike(r"/\d{4,}|content_\d+|art_\d+"), 300).otherwise(0)
    usable = (F.col("href") != "") & ~F.col("href").rlike("^(#|javascript:|mailto:|tel:)")
    scored = links.where(usable & (points > 0)).withColumn("score", F.floor((hundredths + 5) / 10).cast("long"))
    once = best(scored, [key, "href"], [F.desc("score"), F.col("node")]).drop("place")
    return best(once, [key], [F.desc("score"), F.col("node")], most)
