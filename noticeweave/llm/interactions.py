"""Filter interaction audit: what each order of a set of filters removes, step by step, in each part of a table.

A document gets a mask with a bit for each filter that it fails. Documents are counted by part and mask; per part these are at most
2^k numbers for k filters. A subset-zeta transform (k passes over them) turns the counts into the number of documents that
survive each subset of filters. Whatever an order does follows from differences between neighbouring subsets: a step's survivors are
those of the subset of filters up to it, what it removes is the difference to the subset before. The same is done
with the counts of documents that have a label.

A text equal to one of a smaller id fails `copies`: texts are grouped by SHA-256 with partial aggregation, only groups of several are joined
back, and those with very many rows are looked up instead of shuffled.

Results for odd rows: a null text is empty, a null part is the empty string. A null id is neither smaller nor larger than any other, so its row
fails no copy test and makes no other fail it. Rows with equal id and text are documents of their own, of which none is smaller. A document has a
label if any row of labels with its id has it; null labels and ids have none. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeweave.llm.stash import lookup, stash

def failures(text: Column) -> dict[str, Column]:
    """The tests of single texts, in order: few words, repeated words, capitals, signs."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "words": F.size(words) < 50,
        "repeats": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "capitals": capitals * 100 > F.char_length(text) * 5,
        "signs": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, flags: dict[str, Column], *, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """For each part and mask: n documents, and of them those with each flag. Bit i of the mask is test i of failures(); copies come last."""
    text, ident = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`")
    one = docs.select(ident.alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"), text.alias("text"))
    tests = failures(F.col("text"))
    mask = sum((t.cast("int") * (1 << i) for i, t in enumerate(tests.values())), F.lit(0))
    one = one.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    flagged = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        *(F.coalesce(F.max(c.cast("int")), F.lit(0)).alias(k) for k, c in flags.items())
    )
    marks = stash(one.join(flagged, "id", "left").fillna(0, list(flags)), "filter-marks")
    copied = stash(
        marks.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("smallest")).where("rows > 1"), "filter-copies"
    )
    total = copied.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    columns = ["part", "mask", *flags]
    # A copy leaves the count of its mask for that with one bit more.
    found = lookup(marks, copied, ["digest"], "rows", total, [F.col("id"), F.col("part")]).where(F.col("id") > F.col("smallest"))
    moved = found.select("part", F.explode(F.array(F.struct(F.col("mask").alias("to"), F.lit(-1).alias("by")), F.struct((F.col("mask") + (1 << len(tests))).alias("to"), F.lit(1).alias("by")))).alias("move"), *flags)
    moved = moved.select("part", F.col("move.to").alias("mask"), *flags, F.col("move.by").alias("by"))
    counted = marks.select(*columns, F.lit(1).alias("by")).unionByName(moved)
    return counted.groupBy("part", "mask").agg(F.sum("by").alias("n"), *(F.sum(F.col("by") * F.col(k)).alias(k) for k in flags))


def survivors(counts: DataFrame, names: list[str], filters: int) -> DataFrame:
    """For each part an array for each name: at i (a set of filters, by bits) how many documents fail none of the set.

    A part has at most 2^filters rows. The transform sums over all subsets of a set; survivors of s are those whose mask is a subset of its complement.
    """
    size = 1 << filters
    cells = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names))))
    bits = F.array(*(F.lit(1 << i) for i in range(filters)))
    every = F.sequence(F.lit(0), F.lit(size - 1))

    def zeta(name: str) -> Column:
        start = F.transform(every, lambda i: F.coalesce(F.col("cells")[i][name], F.lit(0).cast("long")))
        summed = F.aggregate(
            bits,
            start,
            lambda sums, bit: F.transform(
                every, lambda i: F.get(sums, i) + F.when(i.bitwiseAND(bit) > 0, F.get(sums, i - bit)).otherwise(F.lit(0).cast("long"))
            ),
        )
        return F.reverse(summed).alias(name)

    return counts.groupBy("part").agg(cells.alias("cells")).select("part", *map(zeta, names))


def audit(
    docs: DataFrame,
    labels: DataFrame,
    flags: dict[str, Column],
    *,
    letters: str = "ABCDE",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """A row for each part, order of the filters (named by letters) and step from 1.

    kept, removed, redundant (fails the step's filter, gone before), unique_fails (fails only that one), <flag>_lost for each flag
    (a condition on labels, by its name), and shapley: what the filter removes, summed over all orders.
    """
    k = len(letters)
    every, full = range(k), (1 << k) - 1
    alive = survivors(masks(docs, labels, flags, id_col=id_col, text_col=text_col, part_col=part_col), ["n", *flags], k)
    n = F.col("n")

    def shapley(f: int) -> Column:
        before = [s for s in range(full + 1) if not s >> f & 1]
        return sum(((n[s] - n[s | 1 << f]) * (math.factorial(bin(s).count("1")) * math.factorial(k - 1 - bin(s).count("1"))) for s in before), F.lit(0).cast("long"))

    shares = F.array(*map(shapley, every)).alias("shares")
    steps = []
    for order in itertools.permutations(every):
        gone = 0
        for i, f in enumerate(order, 1):
            steps.append(("".join(letters[x] for x in order), i, f, gone, gone | 1 << f))
            gone |= 1 << f
    kind = "array<struct<filter_order: string, step: int, f: int, was: int, now: int>>"
    fields = ("filter_order", "step", "f", "was", "now")
    plan = F.from_json(F.lit(json.dumps([dict(zip(fields, s, strict=True)) for s in steps])), kind)
    removed = F.get("n", F.col("was")) - F.get("n", F.col("now"))
    only = F.call_function("shiftleft", F.lit(1), F.col("f"))
    rows = alive.select("*", shares, F.explode(plan).alias("at")).select("*", "at.*")
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("n", F.col("now")).alias("kept"),
        removed.alias("removed"),
        (n[0] - F.get("n", only) - removed).alias("redundant"),
        (F.get("n", F.lit(full) - only) - n[full]).alias("unique_fails"),
        *((F.get(name, F.col("was")) - F.get(name, F.col("now"))).alias(f"{name}_lost") for name in flags),
        F.get("shares", F.col("f")).alias("shapley"),
    )
