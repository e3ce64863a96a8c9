"""SimHash near-dedup with keys from the Golay code.

A text's fingerprint has a bit for each bit of XXH64: 1 if it is set in over half of the text's shingles. Fingerprints link
at up to four differing bits. They are cut into segments of 22, 21 and 21 bits. Four errors over three segments leave,
in some order, one segment with none and another with at most two, or else two segments with exactly one. So links are found by

- keys of one segment's bits and a codeword near another segment (up to six codewords for a segment), where
  two segments with at most two errors share a codeword, and
- keys of two segments' nearest codewords and parities against those of all words one bit away in both. These have 26 bits. Where there are
  so many fingerprints that too many would meet on them, the codewords near the third segment (it has at most two errors then) go into the key as well.

Keys join different fingerprints only; each candidate is verified in the join by counting bits, at the first key it can
have, so that it is emitted about once. Exact copies share a fingerprint and never meet as pairs.

Results for odd rows: a null text, an empty one and one of only white space have fingerprint zero and link like any other. A null id
is never the smallest of its group unless all are null. Repeated rows are of the same group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeweave.llm import golay
from noticeweave.llm.arrow import annotate
from noticeweave.llm.graph import components
from noticeweave.llm.stash import lookup, stash

WORDS, ERRORS, SEED = 4, 4, 42
SEGMENTS = (22, 21, 21)
#: Keys of two codewords also have the third segment's from so many fingerprints on: the links are the same, fewer others meet.
WIDE = 1 << 26
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
_SHIFT = (0, 22, 43)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Pairs of segments: (one without errors, one with up to two), and (one error, one error).
_EXACT = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))
_SINGLE = ((0, 1), (0, 2), (1, 2))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    n = max(1, len(found) - words + 1)
    ends = starts[min(words, len(found)) :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : min(n, at + BLOCK)], ends[at : at + BLOCK], strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, *, text_col: str = "text", words: int = WORDS, keep: list[str] | None = None, name: str = "fingerprint"
) -> DataFrame:
    """docs (columns in keep) with the text's fingerprint, a long."""
    added = T.StructType([T.StructField(name, T.LongType())])
    return annotate(docs, [text_col], added, lambda: lambda texts: ((fingerprint(t, words),) for t in texts), keep)


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    raw = prints.view(np.uint64)
    return [(raw >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in zip(_SHIFT, SEGMENTS, strict=True)]


def _exact_keys(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, fingerprint, whether the codeword is the nearest)."""
    parts = _segments(prints)
    near = [golay.near(p, n) for p, n in zip(parts, SEGMENTS, strict=True)]
    for c, (i, j) in enumerate(_EXACT):
        row, column = np.nonzero(near[j] >= 0)
        yield (c << 34) | (parts[i][row] << 12) | near[j][row, column], prints[row], column == 0


def _parity(part: np.ndarray) -> np.ndarray:
    return np.bitwise_count(part).astype(np.int64) & 1


def _single_keys(prints: np.ndarray, own: bool, wide: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of the nearest codewords (own), or of those of words one bit away, with the parities that own has; wide: and codewords near the third segment."""
    parts = _segments(prints)
    for c, (i, j) in enumerate(_SINGLE):
        if own:
            row, key, odd = np.arange(len(prints)), golay.decode(parts[i]) << 12 | golay.decode(parts[j]), (_parity(parts[i]), _parity(parts[j]))
        else:
            first, second = golay.flipped(parts[i], SEGMENTS[i]), golay.flipped(parts[j], SEGMENTS[j])
            row, x, y = np.nonzero((first >= 0)[:, :, None] & (second >= 0)[:, None, :])
            key, odd = first[row, x] << 12 | second[row, y], (1 - _parity(parts[i]), 1 - _parity(parts[j]))
        key = (c << 26) | (odd[0][row] << 25) | (odd[1][row] << 24) | key
        if wide:
            near = golay.near(parts[3 - i - j], SEGMENTS[3 - i - j])
            at, which = np.nonzero(near[row] >= 0)
            row, key = row[at], key[at] << 12 | near[row[at], which]
        yield key, prints[row], np.ones(len(row), bool)


def _keyed(prints: DataFrame, kind: str, wide: bool = False) -> DataFrame:
    """key, f (fingerprint), near for each key of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 4096):
                some = whole[at : at + 4096]
                made: Iterable = _exact_keys(some) if kind == "exact" else _single_keys(some, kind == "own", wide)
                for columns in made:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "f", "near"])

    return prints.select("f").mapInArrow(run, "key long, f long, near boolean")


def links(prints: DataFrame, wide: bool = False) -> DataFrame:
    """a < b for all pairs of different fingerprints f in prints that differ in up to four bits, some more than once. wide: longer keys, for very many."""
    a, b = F.col("x.f"), F.col("y.f")
    diff = a.bitwiseXOR(b)
    errors = [F.bit_count(diff.bitwiseAND(F.lit(((1 << n) - 1 << s) - (1 << 64 if s + n == 64 else 0)))) for s, n in zip(_SHIFT, SEGMENTS, strict=True)]
    few = (a < b) & (F.bit_count(diff) <= ERRORS)

    def first(cases: list[Column]) -> Column:
        out = F.lit(len(cases))
        for i in range(len(cases) - 1, -1, -1):
            out = F.when(cases[i], F.lit(i)).otherwise(out)
        return out

    # Each fingerprint has dozens of keys, and Spark sizes them like the fingerprints: unhinted, it broadcasts them.
    exact = _keyed(prints, "exact")
    case = first([(errors[i] == 0) & (errors[j] <= 2) for i, j in _EXACT])
    once = F.lit(False)
    for c, (_, j) in enumerate(_EXACT):
        once = once | (case == c) & ((errors[j] > 0) | F.col("x.near") & F.col("y.near"))
    found = exact.alias("x").join(
        exact.alias("y").hint("merge"), (F.col("x.key") == F.col("y.key")) & few & (F.shiftright(F.col("x.key"), 34) == case) & once
    )
    none = (errors[0] > 0) & (errors[1] > 0) & (errors[2] > 0)
    one = first([(errors[i] == 1) & (errors[j] == 1) for i, j in _SINGLE])
    case_at = 38 if wide else 26
    more = _keyed(prints, "own", wide).alias("x").join(
        _keyed(prints, "flipped", wide).alias("y").hint("merge"), (F.col("x.key") == F.col("y.key")) & few & none & (F.shiftright(F.col("x.key"), case_at) == one)
    )
    pair = [a.alias("a"), b.alias("b")]
    return found.select(*pair).unionByName(more.select(*pair))


def near_groups(prints: DataFrame, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """f, n (its rows), root and component (the smallest id of all rows whose fingerprints are linked, directly or not) for each fingerprint.

    prints, a stashed table, has f and id. more gives further links of fingerprints for the table of links found here.
    """
    each = stash(prints.groupBy("f").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprints")
    found = stash(links(each, each.count() >= WIDE), "links")
    roots = components(found if more is None else found.unionByName(more(found)))
    named = stash(
        each.join(roots.withColumnRenamed("node", "f").hint("merge"), "f", "left").select("f", "least", "n", F.coalesce("root", "f").alias("root")), "named"
    )
    least = stash(named.groupBy("root").agg(F.min("least").alias("component")), "components")
    return stash(named.join(least.hint("merge"), "root").select("f", "n", "root", "component"), "groups")


def _named(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id and text under names of their own, whatever the columns of docs are called."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *more)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """id_col, fingerprint (hex) and component_id, the smallest id of the row's group, for each row of docs."""
    prints = stash(fingerprints(_named(docs, id_col, text_col), words=words, keep=["id"], name="f"), "prints")
    groups = near_groups(prints)
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # fingerprint zero, or that of a page that many rows have, is no task's own
    return lookup(prints, groups.select("f", "n", "component"), ["f"], "n", total, [F.col("id")]).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def dedup(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, more: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """docs with one row of each group: that of the smallest id (of equal ids, the least hash of the row). more: as for near_groups."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    marked = docs.withColumn("__nw_row", row)
    prints = stash(fingerprints(_named(marked, id_col, text_col, "__nw_row"), words=words, keep=["id", "__nw_row"], name="f"), "prints")
    groups = near_groups(prints, more)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("__nw_row").alias("row"))
    rows = prints.groupBy("f", "id", "__nw_row").agg(F.count(F.lit(1)).alias("n"))
    least = rows.groupBy("f").agg(F.min(F.struct(order.alias("o"), "n")).alias("least"))
    chosen = stash(
        stash(least, "least").join(groups.hint("merge"), "f").groupBy("root").agg(F.min("least").alias("m")).select(
            F.col("m.o.id").alias("__nw_id"), F.col("m.o.row").alias("__nw_row2"), F.col("m.n").alias("__nw_n")
        ),
        "chosen",
    )
    same = F.col("__nw_id").eqNullSafe(F.col(f"`{id_col}`")) & (F.col("__nw_row") == F.col("__nw_row2"))
    kept = marked.join(chosen.hint("merge"), same)
    if chosen.where("__nw_n > 1").isEmpty():
        return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
    # rows equal in all columns: one of them stays
    kept = kept.where("__nw_n = 1").unionByName(kept.where("__nw_n > 1").dropDuplicates(["__nw_id", "__nw_row2"]))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
