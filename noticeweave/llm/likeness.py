"""Texts whose sets of word shingles have a Jaccard likeness of 4/5 or more, by prefixes: all pairs, or links that connect them.

Shingles have one order for all texts. Sets of n shingles that are as like as that share one of the first n - ceil(4n / 5) + 1 in
this order, so texts only meet on these. Any order finds all pairs; shingles that a sample of the texts has often come last, so that
few texts meet on them. Sizes and places rule out more; each pair that is left is verified over both whole sets.

Groups don't need all pairs. connect() first compares each text with one other, the one that is the least (by hash, in another order each time) for
most of its prefix shingles, twice; texts that are connected by then don't meet any more. Only texts that share a prefix
shingle and aren't connected yet are compared one by one, so that the groups are those that all pairs give, while one group of n alike
texts takes a number of comparisons that grows with n. Before sets are compared, counts of their shingles in cells of the hash
space (about four in each) tell how many they can have in common at most; few pairs pass that are not nearly alike.

Results for odd rows: a null text, an empty one and one of only white space have no shingles and are like no other. A text of less
words than a shingle has itself as its only one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeweave.llm import simhash
from noticeweave.llm.arrow import annotate, small_batches
from noticeweave.llm.graph import components
from noticeweave.llm.stash import lookup, stash

WORDS = 5
#: Rounds of comparisons: all but the last with one text for each shingle and size.
TURNS = 3
#: One of so many texts is sampled for the order, shingles in SEEN of them or more come last, and the driver lists so many at most.
SAMPLE, SEEN, LISTED = 16, 4, 200_000
_SEED = 42


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The set of a text's shingles as sorted hashes."""
    found = (text or "").encode("utf-8", "replace").translate(simhash._LOWER).split()
    if not found:
        return np.zeros(0, np.int64)
    joined = b" ".join(found)
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], _SEED) for a, b in zip(starts[: max(1, len(found) - words + 1)], starts[min(words, len(found)) :], strict=False)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def prefix(found: np.ndarray, often: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first of a set by rank in often (sorted, absent ones come first) and hash: as many as an alike set must share one of."""
    n = len(found)
    if not n:
        return found
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        found = found[np.lexsort((found, np.where(often[at] == found, ranks[at], 0)))]
    return found[: n - -(-4 * n // 5) + 1]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 5 * both >= 4 * (len(a) + len(b) - both)


def _often(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sample has often, sorted, and their places by frequency from 1."""
    some = texts.where(F.pmod("h", F.lit(SAMPLE)) == 0).select("h", "h2", "text").dropDuplicates(["h", "h2"])
    added = T.StructType([T.StructField("s", T.ArrayType(T.LongType()))])
    sets = annotate(some, ["text"], added, lambda: lambda rows: ((shingles(t, words),) for t in rows), [])
    counts = sets.select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN)
    listed = [r.s for r in counts.orderBy(F.col("n").desc(), "s").limit(LISTED).collect()]
    keys = np.array(listed, np.int64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - order).astype(np.int64)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text")).where("text is not null")


def counted(found: np.ndarray) -> bytes:
    """How many of a set's hashes begin with each of so many bits that about four do, as bytes; empty if they don't fit."""
    bits = max(3, (max(1, len(found) // 4) - 1).bit_length())
    cells = np.bincount((found.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return cells.astype(np.uint8).tobytes() if cells.max() < 256 else b""


def at_most(a: bytes, b: bytes) -> int:
    """How many hashes two sets can have in common, by their counts."""
    x, y = (np.frombuffer(c, np.uint8).astype(np.int64) for c in (a, b))
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 1 << 62
    return int(np.minimum(x, y.reshape(len(x), -1).sum(1)).sum())


def _prefixes(texts: DataFrame, words: int, print_words: int) -> DataFrame:
    """h, h2, f (fingerprint), n (shingles), cells (their counts) and keys (the prefix) of each different text that has shingles."""
    told = texts.sparkSession.sparkContext.broadcast(_often(texts, words))
    added = T.StructType().add("f", T.LongType()).add("n", T.IntegerType()).add("cells", T.BinaryType()).add("keys", T.ArrayType(T.LongType()))

    def start():  # noqa: ANN202
        often, ranks = told.value

        def each(rows: list[str | None]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
            for t in rows:
                found = shingles(t, words)
                yield simhash.fingerprint(t, print_words), len(found), counted(found), prefix(found, often, ranks)

        return each

    made = annotate(texts, ["text"], added, start, ["h", "h2"]).where("n > 0")
    return stash(made.groupBy("h", "h2").agg(*(F.first(c).alias(c) for c in ("f", "n", "cells", "keys"))), "prefixes")


def _may_be_alike(x: str, y: str) -> Column:
    """Whether sizes and places in the prefixes allow a likeness of 4/5."""
    n, m, i, j = (F.col(f"{side}.{c}") for c in ("n", "pos") for side in (x, y))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * (1 + F.least(n - 1 - i, m - 1 - j)) >= 4 * (n + m))


_ENDS = ("f", "h", "h2")


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """a < b (fingerprints) of those pairs (xf, xh, xh2, yf, yh, yh2; each once) that are alike."""
    pairs = stash(pairs, "candidates")
    ends = pairs.select(F.col("xh").alias("h"), F.col("xh2").alias("h2")).union(pairs.select("yh", "yh2"))
    ends = stash(ends.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("uses")), "ends")
    whole = T.StructType([T.StructField("s", T.BinaryType())])
    needed = texts.join(ends.hint("merge"), ["h", "h2"], "left_semi").dropDuplicates(["h", "h2"])
    sets = annotate(needed, ["text"], whole, lambda: lambda rows: ((shingles(t, words).tobytes(),) for t in rows), ["h", "h2"])
    found = stash(sets.join(ends.hint("merge"), ["h", "h2"]), "sets")
    total = found.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    both = pairs
    for side in "xy":  # a text that very many are compared with is broadcast
        right = found.select(F.col("h").alias(f"{side}h"), F.col("h2").alias(f"{side}h2"), F.col("s").alias(f"{side}s"), "uses")
        both = lookup(both, right, [f"{side}h", f"{side}h2"], "uses", total, [F.col("xh"), F.col("yh")])
    both = both.select(F.least("xf", "yf").alias("a"), F.greatest("xf", "yf").alias("b"), "xs", "ys")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            kept = [alike(np.frombuffer(a[i].as_py(), np.int64), np.frombuffer(b[i].as_py(), np.int64)) for i in range(batch.num_rows)]
            rows = batch.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], names=["a", "b"])

    return stash(both.mapInArrow(verify, "a long, b long").where("a <> b").distinct(), "alike")


def links(docs: DataFrame, *, text_col: str = "text", words: int = WORDS, print_words: int = simhash.WORDS) -> DataFrame:
    """a < b, fingerprints (of simhash) of alike texts, for all pairs of alike texts with fingerprints that simhash doesn't link."""
    texts = _texts(docs, text_col)
    keys = _prefixes(texts, words, print_words).select(*_ENDS, "n", F.posexplode("keys").alias("pos", "key"))
    x, y = keys.alias("x"), keys.alias("y")
    new = (F.col("x.f") < F.col("y.f")) & (F.bit_count(F.col("x.f").bitwiseXOR(F.col("y.f"))) > simhash.ERRORS)
    pairs = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & new & _may_be_alike("x", "y"))
    return _verified(pairs.select(*(F.col(f"{s}.{c}").alias(s + c) for s in "xy" for c in _ENDS)).distinct(), texts, words)


def connect(docs: DataFrame, linked: DataFrame, *, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """a < b, fingerprints of alike texts, so many that with linked (a, b: links that are known) they connect what all alike texts do."""
    with small_batches(docs.sparkSession):
        return _connected(_texts(docs, text_col), linked, words)


def _connected(texts: DataFrame, linked: DataFrame, words: int) -> DataFrame:
    """connect of texts: all of it is written when this returns."""
    sets = _prefixes(texts, words, words)
    shared = _shared(sets)
    found = linked.select("a", "b")
    new = None
    for turn in range(TURNS):
        roots = components(found).withColumnRenamed("node", "f").hint("merge")
        rooted = stash(sets.drop("keys").join(roots, "f", "left").withColumn("root", F.coalesce("root", "f")), "rooted")
        keys = stash(shared.join(rooted.select("h", "n", "root").hint("merge"), "h"), "keys")
        met = _stars(keys, turn) if turn < TURNS - 1 else _rest(keys)
        more = _verified(_possible(met, rooted), texts, words)
        new = more if new is None else new.unionByName(more)
        found = found.unionByName(more)
    return new


def _shared(sets: DataFrame) -> DataFrame:
    """key, h, pos: the prefix shingles that more than one text has."""
    keys = sets.select("h", F.posexplode("keys").alias("pos", "key"))
    often = stash(keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").withColumn("often", F.lit(True)), "shared-shingles")
    total = often.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return stash(lookup(keys, often, ["key"], "rows", total, [F.col("h"), F.col("pos")]).select("key", "h", "pos"), "shared")


def _stars(keys: DataFrame, turn: int) -> DataFrame:
    """x, y (hashes of texts): each text and that one which is the least for most of its shingles and its size, unless all there are connected."""
    size = F.floor(F.log("n") / F.log(F.lit(1.25)))  # sizes of one step are near enough to each other
    keys = keys.select("h", "root", F.xxhash64("key", size).alias("k"))
    mix = F.xxhash64(F.lit(turn))
    least = stash(
        keys.groupBy("k").agg(F.min(F.col("h").bitwiseXOR(mix)).alias("least"), F.min("root").alias("r"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("rows"))
        .where("r <> r2").select("k", F.col("least").bitwiseXOR(mix).alias("to"), "rows"),
        "least",
    )
    total = least.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    met = lookup(keys, least, ["k"], "rows", total, [F.col("h")]).where("h <> to").groupBy("h", "to").agg(F.count(F.lit(1)).alias("times"))
    return met.groupBy("h").agg(F.max(F.struct("times", "to")).alias("m")).select(F.col("h").alias("x"), F.col("m.to").alias("y"))


def _rest(keys: DataFrame) -> DataFrame:
    """x, y (hashes of texts): all that share a prefix shingle, may be alike and aren't connected."""
    mixed = stash(
        keys.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("rows")).where("r <> r2").select("key", F.lit(True).alias("open"), "rows"),
        "open-shingles",
    )
    total = mixed.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    left = stash(lookup(keys, mixed, ["key"], "rows", total, [F.col("h")]).drop("open"), "open")
    # groups meet first, by what their texts allow at most, so that the texts of one group never do
    groups = left.groupBy("key", "root").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("after"))
    p, q = groups.alias("p"), groups.alias("q")
    sizes = (5 * F.col("p.most") >= 4 * F.col("q.least")) & (5 * F.col("q.most") >= 4 * F.col("p.least"))
    places = 9 * F.least("p.after", "q.after") >= 4 * (F.col("p.least") + F.col("q.least"))
    met = p.join(q.hint("merge"), (F.col("p.key") == F.col("q.key")) & (F.col("p.root") < F.col("q.root")) & sizes & places).select(
        F.col("p.key").alias("key"), F.col("p.root").alias("root"), F.col("q.root").alias("other")
    )
    first = left.join(met.hint("merge"), ["key", "root"]).alias("x")
    pairs = first.join(left.alias("y").hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.other") == F.col("y.root")) & _may_be_alike("x", "y"))
    return pairs.select(F.col("x.h").alias("x"), F.col("y.h").alias("y")).distinct()


def _possible(met: DataFrame, rooted: DataFrame) -> DataFrame:
    """The pairs of met (x, y) that aren't connected and whose sizes and counts allow a likeness of 4/5, with both texts' f, h, h2."""
    names = [*_ENDS, "n", "root", "cells"]
    both = met
    for side in "xy":
        right = rooted.select(*(F.col(c).alias(side + c) for c in names))
        both = both.join(right.hint("merge"), F.col(side) == F.col(f"{side}h"))
    both = both.where((F.col("xroot") != F.col("yroot")) & (5 * F.least("xn", "yn") >= 4 * F.greatest("xn", "yn")))
    both = both.select(*(s + c for s in "xy" for c in _ENDS), "xn", "yn", "xcells", "ycells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(6).to_numpy() + batch.column(7).to_numpy()
            most = [at_most(a.as_py(), b.as_py()) for a, b in zip(batch.column(8), batch.column(9), strict=True)]
            ok = pa.array([9 * m >= 4 * int(k) for m, k in zip(most, n, strict=True)], pa.bool_())
            rows = batch.filter(ok)
            yield pa.RecordBatch.from_arrays(rows.columns[:6], names=rows.schema.names[:6])

    return both.mapInArrow(run, T.StructType(both.schema.fields[:6]))
