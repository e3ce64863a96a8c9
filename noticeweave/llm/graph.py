"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.llm.stash import stash


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b): nodes with the same root are connected, and no others.

    In each round every node points to the least of itself and its neighbours, pointers are followed twice, and
    edges are drawn anew between the nodes pointed to, until none is left. Tables of a round are written to
    the shared folder, so both sides of each join are tables and joins on nodes with many edges are split. None is broadcast:
    all grow with the edges, and files of theirs are far smaller than what a driver would hold.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    found = None
    while not both.isEmpty():
        points = stash(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "pointers")
        for _ in range(2):
            target = points.select(F.col("a").alias("p"), F.col("p").alias("q"))
            points = stash(points.join(target.hint("merge"), "p").select("a", F.col("q").alias("p")), "pointers")
        if found is None:
            found = points.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            onward = points.select(F.col("a").alias("root"), "p")
            found = found.join(onward.hint("merge"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        found = stash(found, "roots")
        end = points.select(F.col("a").alias("b"), F.col("p").alias("q"))
        half = stash(both.join(points.hint("merge"), "a").select(F.col("p").alias("a"), "b"), "edges")
        both = stash(half.join(end.hint("merge"), "b").select("a", F.col("q").alias("b")).where("a <> b").distinct(), "edges")
    if found is None:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
