"""Benchmark decontamination: a Wu-Manber search for word windows of test items.

Texts become sequences of word numbers (0: a word that no item has). Patterns of one length m share a
table of shifts for blocks of two words (one word where m is 1): how far a search may move on when a
window ends in that block. A block at the end of a pattern has shift 0; the patterns with that block as
their suffix are its bucket, and each is compared word by word. Many windows are searched side by side,
each in a stretch of a text, so that every step is one numpy call.

Results for odd rows: a null or wordless text has no words, hits or items and is clean. Items without
words, without a text or without an id have no windows. Items that share an id count as one. Repeated rows get
equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeweave.llm.arrow import annotate
from noticeweave.llm.stash import stash

WINDOW = 13
#: Item words in one block of tables. A larger benchmark is searched block after block; a block bounds
#: what is broadcast, and what the driver and a task hold at once.
BLOCK_WORDS = 500_000
#: Windows of a stretch that one lane of the search runs through.
STRETCH = 4096
#: ASCII letters lose their case; other ASCII characters but digits become spaces.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)

ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def words(text: str | None) -> list[bytes]:
    """Lower-case runs of ASCII letters, digits and characters outside ASCII."""
    return text.encode("utf-8", "replace").translate(_BYTES).split() if text else []


class Patterns(NamedTuple):
    """Patterns of one length: words, owner (an item's number), block shifts, and buckets by suffix and prefix: pairs of a suffix's block and a prefix's number."""

    rows: np.ndarray
    owner: np.ndarray
    blocks: np.ndarray
    shift: np.ndarray
    prefixes: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    count: np.ndarray


class Tables(NamedTuple):
    vocabulary: dict[bytes, int]
    items: list[str]
    groups: list[Patterns]


def _block_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << 32 | right.astype(np.int64)


def _patterns(rows: np.ndarray, owner: np.ndarray) -> Patterns:
    m = rows.shape[1]
    size = min(2, m)
    ends = np.arange(size - 1, m)
    left = rows[:, ends - 1] if size == 2 else np.zeros((len(rows), len(ends)), rows.dtype)
    keys = _block_keys(left, rows[:, ends])
    begins = _block_keys(rows[:, 0], rows[:, 1]) if size == 2 else keys[:, 0]
    order = np.lexsort((owner, begins, keys[:, -1]))
    rows, owner, keys, begins = rows[order], owner[order], keys[order], begins[order]
    blocks, inverse = np.unique(keys, return_inverse=True)
    shift = np.full(len(blocks), m, np.int64)
    np.minimum.at(shift, inverse.reshape(-1), np.tile(m - 1 - ends, len(rows)))
    prefixes, number = np.unique(begins, return_inverse=True)
    pairs, first, count = np.unique(np.searchsorted(blocks, keys[:, -1]) << 32 | number.reshape(-1), return_index=True, return_counts=True)
    return Patterns(rows, owner, blocks, shift, prefixes, pairs, first, count)


def build_tables(items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> Tables:
    """Tables for items (id, words); ids may repeat."""
    vocabulary: dict[bytes, int] = {}
    numbers: dict[str, int] = {}
    by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for ident, found in items:
        if not found:
            continue
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in found]
        m = min(window, len(ids))
        group = by_length.setdefault(m, {})
        for i in range(len(ids) - m + 1):
            group.setdefault(tuple(ids[i : i + m]), set()).add(numbers.setdefault(ident, len(numbers)))
    groups = []
    for _, group in sorted(by_length.items()):
        pairs = [(p, o) for p, owners in group.items() for o in sorted(owners)]
        groups.append(_patterns(np.array([p for p, _ in pairs], np.int32), np.array([o for _, o in pairs], np.int64)))
    return Tables(vocabulary, list(numbers), groups)


def search(ids: np.ndarray, bounds: np.ndarray, group: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(start, owner) of every occurrence of the group's patterns in texts ids[bounds[i]:bounds[i + 1]]."""
    m = group.rows.shape[1]
    size = min(2, m)
    starts, owners = [], []
    lengths = np.diff(bounds)
    lanes = np.maximum(0, -(-(lengths - m + 1) // STRETCH))
    text = np.repeat(np.arange(len(lengths)), lanes)
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = bounds[text] + nth * STRETCH + m - 1  # the last word of the window
    stop = np.minimum(at + STRETCH, bounds[text + 1])
    while len(at):
        keys = _block_keys(ids[at - 1] if size == 2 else np.zeros(len(at), ids.dtype), ids[at])
        k = np.minimum(np.searchsorted(group.blocks, keys), len(group.blocks) - 1)
        known = group.blocks[k] == keys
        step = np.where(known, group.shift[k], m - size + 1)
        zero = np.flatnonzero(step == 0)
        if len(zero):
            # Of a suffix's bucket only what begins as the text does is compared.
            begin = at[zero] - m + 1
            own = _block_keys(ids[begin], ids[begin + 1]) if size == 2 else keys[zero]
            number = np.minimum(np.searchsorted(group.prefixes, own), len(group.prefixes) - 1)
            pair = k[zero] << 32 | number
            place = np.minimum(np.searchsorted(group.pairs, pair), len(group.pairs) - 1)
            there = np.flatnonzero((group.prefixes[number] == own) & (group.pairs[place] == pair))
            begin, first, count = begin[there], group.first[place[there]], group.count[place[there]]
            for nth_in_bucket in range(int(count.max(initial=0))):
                live = count > nth_in_bucket
                pattern, start = first[live] + nth_in_bucket, begin[live]
                same = np.ones(len(start), bool)
                for j in range(m):
                    same[same] = ids[start[same] + j] == group.rows[pattern[same], j]
                starts.append(start[same])
                owners.append(group.owner[pattern[same]])
        at = at + np.maximum(step, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    return (np.concatenate(starts), np.concatenate(owners)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def scan(found: list[list[bytes]], blocks: list[Callable[[], Tables]]) -> Iterator[tuple[int, int, list[str], bool]]:
    """n_words, n_hit, sorted ids of items, contaminated for each text, given as words."""
    sizes = np.array([len(x) for x in found], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    cover = np.zeros(int(bounds[-1]) + 1, np.int64)
    names: list[set[str]] = [set() for _ in found]
    for load in blocks:
        tables = load()
        get = tables.vocabulary.get
        ids = np.empty(int(bounds[-1]), np.int32)
        for i, x in enumerate(found):
            ids[bounds[i] : bounds[i + 1]] = np.fromiter(map(get, x, repeat(0)), np.int32, len(x))
        for group in tables.groups:
            begin, owner = search(ids, bounds, group)
            if len(begin):
                m = group.rows.shape[1]
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + m, -1)
                text = np.searchsorted(bounds, begin, side="right") - 1
                for t, o in np.unique(np.stack([text, owner], 1), axis=0).tolist():
                    names[t].add(tables.items[o])
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    hits = hit[bounds[1:]] - hit[bounds[:-1]]
    for n, h, who in zip(sizes.tolist(), hits.tolist(), names, strict=True):
        yield n, h, sorted(who), h > 0 and 20 * h >= n


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of a bounded number of words (one item at least)."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    block: list[tuple[str, list[bytes]]] = []
    n = 0
    for ident, text in rows.where("i is not null and t is not null").toLocalIterator():
        found = words(text)
        if block and n + len(found) > block_words:
            yield block
            block, n = [], 0
        block.append((ident, found))
        n += len(found)
    if block:
        yield block


def block_hits(found: list[list[bytes]], tables: Tables) -> Iterator[tuple[list[tuple[int, int]], list[str]]]:
    """For each text, given as words, the stretches of words (end exclusive) inside occurrences of one block's windows, and the items."""
    sizes = np.array([len(x) for x in found], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    get = tables.vocabulary.get
    ids = np.fromiter((get(w, 0) for x in found for w in x), np.int32, int(bounds[-1]))
    cover = np.zeros(int(bounds[-1]) + 1, np.int64)
    names: list[set[str]] = [set() for _ in found]
    for group in tables.groups:
        begin, owner = search(ids, bounds, group)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + group.rows.shape[1], -1)
        text = np.searchsorted(bounds, begin, side="right") - 1
        for t, o in set(zip(text.tolist(), owner.tolist(), strict=True)):
            names[t].add(tables.items[o])
    inside = (np.cumsum(cover[:-1]) > 0).astype(np.int8)
    for i, who in enumerate(names):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], inside[bounds[i] : bounds[i + 1]], [0]])))
        yield list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), sorted(who)


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the stretches."""
    total, reach = 0, 0
    for lo, hi in sorted(spans):
        total += max(0, hi - max(lo, reach))
        reach = max(reach, hi)
    return total


_SPANS = T.ArrayType(T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
_HITS = T.StructType([T.StructField("spans", _SPANS), T.StructField("who", T.ArrayType(T.StringType()))])


def _searched(docs: DataFrame, text_col: str, block: list[tuple[str, list[bytes]]], window: int) -> DataFrame:
    """h, h2 (hashes of the text), spans and who of each text with hits of one block: its tables are broadcast, and let go once this is written."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text")).where("text is not null")
    shared = docs.sparkSession.sparkContext.broadcast(build_tables(block, window))

    def start() -> Callable:
        return lambda texts: (([{"lo": a, "hi": b} for a, b in spans], who) for spans, who in block_hits([words(t) for t in texts], shared.value))

    found = annotate(rows, ["text"], _HITS, start, ["h", "h2"]).where(F.size("who") > 0)
    kept = stash(found.groupBy("h", "h2").agg(F.first(F.struct("spans", "who")).alias("f")).select("h", "h2", "f.*"), "hits")
    shared.destroy()
    return kept


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurring window), items (sorted ids) and contaminated.

    The benchmark is read to the driver block by block; a block has block_words words at most, or one item. One block's tables are broadcast and
    the documents searched in one scan. If there are more, each is searched by a job of its own, whose hits by text are written; only
    one block's tables exist at a time.
    """
    blocks = item_blocks(benchmark, item_col, item_text_col, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(build_tables(first, window))
        return annotate(docs, [text_col], ADDED, lambda: lambda texts: scan([words(t) for t in texts], [lambda: shared.value]), keep)
    hits = None
    for block in chain([first, second], blocks):
        more = _searched(docs, text_col, block, window)
        hits = more if hits is None else hits.unionByName(more)
    merged = stash(hits.groupBy(F.col("h").alias("__nw_m"), F.col("h2").alias("__nw_m2")).agg(F.flatten(F.collect_list("spans")).alias("__nw_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("who")))).alias("__nw_who")), "merged-hits")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED.fieldNames()]
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), text.alias("__nw_text"), F.xxhash64(text).alias("__nw_h"), F.xxhash64(F.lit(1), text).alias("__nw_h2"))
    same = (F.col("__nw_h") == F.col("__nw_m")) & (F.col("__nw_h2") == F.col("__nw_m2"))
    joined = rows.join(merged.hint("merge"), same, "left")

    def start() -> Callable:
        def run(texts: list[str | None], spans: list[list[dict] | None], who: list[list[str] | None]) -> Iterator[tuple[int, int, list[str], bool]]:
            for t, found, items in zip(texts, spans, who, strict=True):
                n, h = len(words(t)), covered([(s["lo"], s["hi"]) for s in found or []])
                yield n, h, items or [], h > 0 and 20 * h >= n

        return run

    return annotate(joined, [F.col("__nw_text"), F.col("__nw_spans"), F.col("__nw_who")], ADDED, start, kept)
