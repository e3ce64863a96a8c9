"""Suffix-array dedup: bytes inside a string of 400 bytes that also starts anywhere else are removed.

Sorting every suffix of a corpus isn't needed: of two equal windows of 400 bytes the same k-gram (of 64 bytes) has the least hash,
rightmost of equal ones, at the same distance from the start. So each start belongs to an anchor, and starts can
only be equal if their anchors' k-grams are. Consecutive starts with one anchor are a unit; its bytes are a few
hundred. Units whose k-gram is nowhere else are done, equal units (128 bits of hash and the same
distance) repeat as a whole, and of the rest one unit for each different content is sorted: in a task, for groups of units
with one k-gram, starts at equal distances are sorted as suffixes, and neighbours in that order
with 400 equal bytes are repeated.

A group of many different units is not one task's work: its units are cut into stretches of few starts, which are grouped
by the bytes that all windows of a stretch have in common. The same is done to these, down to single starts, for
which groups are equal windows and need no sorting. All grouping is by partial aggregation.

Python tasks hold little at a time, whatever the rows: batches are bounded in bytes on both ways, and what is sorted together in
starts and bytes. Only the last pass, which runs when its result is read, gets batches of the session's size.

Results for odd rows: a null text is empty; texts under 400 bytes lose nothing. Rows with equal id and text are separate documents: if
the text has 400 bytes, all of each is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeweave.llm.arrow import small_batches
from noticeweave.llm.stash import lookup, stash
from noticeweave.llm.suffixes import BASE, INVERSE, Prefixes, powers, repeated

LENGTH, GRAM = 400, 64
#: Different units of a group that one task sorts; stretches of starts that larger groups are cut into.
MOST, WIDTHS = 128, (48, 6, 1)
#: Bytes looked at together; starts and bytes sorted together; rows and bytes of a batch.
BUFFER, STARTS, BYTES, ROWS, BATCH = 1 << 18, 100_000, 1 << 19, 4096, 1 << 20
_PLACE = (1 << 20) - 1
_UNIT = "key long, key2 long, c1 long, c2 long, d long, n long, text binary"
_RANGES = "c1 long, c2 long, lo long, hi long"
_TYPES = {"long": pa.int64(), "binary": pa.binary()}


def _filled(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    """Batches of the rows (one binary column or more), of about BATCH bytes in those."""
    schema = pa.schema([(name, _TYPES[kind]) for name, kind in map(str.split, ddl.split(", "))])
    texts = [i for i, f in enumerate(schema) if f.type == pa.binary()]
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(row[i]) for i in texts)
        if size >= BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _content(view: memoryview | bytes, distance: int) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(view, seed=distance)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


class Anchors:
    """Finds units in texts."""

    def __init__(self, length: int, gram: int) -> None:
        if length > _PLACE:
            raise ValueError(f"length may be {_PLACE} at most")
        self.length, self.gram, self.window = length, gram, length - gram + 1
        self.buffer = min(max(BUFFER, 2 * length), _PLACE + 1)
        self.powers, self.inverse = powers(BASE, self.buffer + length), powers(INVERSE, self.buffer + length)

    def _units(self, joined: bytes, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First start, number of starts, anchor and hash of each unit, of the starts in valid."""
        data = np.frombuffer(joined, np.uint8)
        n = len(data)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], dtype=np.uint64)])
        grams = (sums[self.gram :] - sums[: -self.gram]) * self.inverse[: n - self.gram + 1]
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(29)
        least = (grams & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - np.arange(len(grams), dtype=np.uint64))
        size = 1
        while size * 2 <= self.window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if rest := self.window - size:
            least = np.minimum(least[:-rest], least[rest:])
        anchor = _PLACE - (least[valid] & np.uint64(_PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)]))
        return valid[first], np.diff(np.concatenate([first, [len(valid)]])), anchor[first], grams[anchor[first]].view(np.int64)

    def find(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """Arrays: text, first start in it, number of starts, distance of the anchor, hash, and the content's two."""
        parts: list[tuple[int, int, bytes]] = []
        held = 0
        for i, t in enumerate(texts):
            step = self.buffer - self.length
            for at in range(0, max(0, len(t) - self.length + 1), step):
                piece = t[at : at + step + self.length - 1]
                if held + len(piece) > self.buffer:
                    yield self._found(parts)
                    parts, held = [], 0
                parts.append((i, at, piece))
                held += len(piece)
        if parts:
            yield self._found(parts)

    def _found(self, parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        joined = b"".join(p for _, _, p in parts)
        sizes = np.array([len(p) for _, _, p in parts])
        offsets = np.cumsum(sizes) - sizes
        valid = np.concatenate([np.arange(o, o + s - self.length + 1) for o, s in zip(offsets.tolist(), sizes.tolist(), strict=True)])
        start, count, anchor, hashed = self._units(joined, valid)
        part = np.searchsorted(offsets, start, side="right") - 1
        view = memoryview(joined)
        contents = np.array(
            [_content(view[s : s + c + self.length - 1], a - s) for s, c, a in zip(start.tolist(), count.tolist(), anchor.tolist(), strict=True)], np.int64
        ).reshape(-1, 2)
        text = np.array([i for i, _, _ in parts])[part]
        return text, start - offsets[part] + np.array([a for _, a, _ in parts])[part], count, anchor - start, hashed, contents[:, 0], contents[:, 1]


def _members(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All units: id, h, lo (first start), n, d (distance of the anchor), key (its hash), c1, c2 (content). docs: id, h, text (binary)."""
    schema = T.StructType([*docs.schema.fields[:2]])
    for name in ("lo", "n", "d", "key", "c1", "c2"):
        schema.add(name, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length, gram)
        for batch in batches:
            for text, *rest in finder.find(batch.column(2).to_pylist()):
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, rest)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Units of whole groups, to be sorted together: about STARTS starts or BYTES bytes."""
    held: list[dict] = []
    starts = size = 0
    for batch in batches:
        for r in batch.to_pylist():
            if (starts >= STARTS or size >= BYTES) and (r["key"], r["key2"]) != (held[-1]["key"], held[-1]["key2"]):
                yield held
                held, starts, size = [], 0, 0
            held.append(r)
            starts += r["n"]
            size += len(r["text"])
    if held:
        yield held


def _sorted(units: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated starts (first and last) of units (_UNIT), each of another content, by their groups (key, key2)."""

    def ranges(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        data = Prefixes(np.frombuffer(b"".join(r["text"] for r in rows), np.uint8))
        counts = np.array([r["n"] for r in rows])
        sizes = np.array([len(r["text"]) for r in rows])
        owner = np.repeat(np.arange(len(rows)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = (np.cumsum(sizes) - sizes)[owner] + within
        group = np.cumsum([i > 0 and (r["key"], r["key2"]) != (rows[i - 1]["key"], rows[i - 1]["key2"]) for i, r in enumerate(rows)])
        segment = group[owner] * (length + 1) + np.array([r["d"] for r in rows])[owner] - within
        order = np.argsort(segment, kind="stable")
        hit = np.zeros(len(owner), bool)
        hit[order] = repeated(data, start[order], segment[order], length)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)) != 0)
        lows, highs = edge[::2], edge[1::2] - 1
        out: list[list[int]] = [[], [], [], []]
        for a, b in zip(lows.tolist(), highs.tolist(), strict=True):
            for o in range(int(owner[a]), int(owner[b]) + 1):  # a run of hits may go on in the next unit
                r = rows[o]
                lo = int(within[a]) if o == owner[a] else 0
                hi = int(within[b]) if o == owner[b] else r["n"] - 1
                for column, value in zip(out, (r["c1"], r["c2"], lo, hi), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["c1", "c2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bundles(batches):
            yield from ranges(rows)

    names = [x.split()[0] for x in _UNIT.split(", ")]
    dealt = units.select(*names).repartition("key", "key2").sortWithinPartitions("key", "key2")
    return dealt.mapInArrow(run, _RANGES)


def _split(units: DataFrame, width: int, length: int) -> DataFrame:
    """Stretches of starts whose distances fall into one cell of width: p1, p2 (content of the unit), off (in it) and _UNIT."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                d, text = r["d"], r["text"]
                for cell in range((d - r["n"] + 1) // width, d // width + 1):
                    far, close = min(d, cell * width + width - 1), max(d - r["n"] + 1, cell * width)
                    off, n = d - far, far - close + 1
                    core = text[d - cell * width : d - cell * width - width + length + 1]
                    part = text[off : off + n + length - 1]
                    yield r["c1"], r["c2"], off, *_content(core, cell), *_content(part, far), far, n, part

    schema = f"p1 long, p2 long, off long, {_UNIT}"
    return units.mapInArrow(lambda batches: _filled(stretches(batches), schema), schema)


def _ranges(units: DataFrame, length: int, most: int, widths: tuple[int, ...]) -> DataFrame:
    """Ranges of repeated starts of units (a stashed table: _UNIT and units, the number in the group)."""
    found = _sorted(units.where(F.col("units") <= most), length)
    large = units.where(F.col("units") > most)
    if not widths or large.isEmpty():
        return found
    names = [x.split()[0] for x in _UNIT.split(", ")]
    parts = stash(_split(large.select(*names), widths[0], length), "stretches")
    kinds = stash(
        parts.groupBy("key", "key2", "c1", "c2").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("d", "n", "text")).alias("u")).select(
            "key", "key2", "c1", "c2", "copies", "u.*"
        ),
        "stretch-kinds",
    )
    groups = stash(kinds.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("units")).where("units > 1"), "stretch-groups")
    whole = kinds.where("copies > 1").select("c1", "c2", F.lit(0).cast("long").alias("lo"), (F.col("n") - 1).alias("hi"), "copies")
    inner = stash(kinds.join(groups.hint("merge"), ["key", "key2"]).select(*names, "units"), "stretch-units")
    got = stash(_by_kind(whole, _ranges(inner, length, most, widths[1:])), "stretch-ranges")
    total = kinds.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    back = lookup(parts.select("p1", "p2", "off", "c1", "c2"), got, ["c1", "c2"], "copies", total, [F.col("p1"), F.col("p2"), F.col("off")])
    back = back.select("p1", "p2", "off", F.explode("ranges").alias("r")).select(
        F.col("p1").alias("c1"), F.col("p2").alias("c2"), (F.col("off") + F.col("r.lo")).alias("lo"), (F.col("off") + F.col("r.hi")).alias("hi")
    )
    return found.unionByName(back)


def _by_kind(whole: DataFrame, sorted_: DataFrame) -> DataFrame:
    """c1, c2, ranges (a set) and copies of each kind: whole has those that occur as they are more than once, sorted_ parts of kinds."""
    found = whole.unionByName(sorted_.withColumn("copies", F.lit(1).cast("long")))
    return found.groupBy("c1", "c2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"), F.max("copies").alias("copies"))


def _packed(docs: DataFrame) -> DataFrame:
    """docs with the text (last column, binary) as compressed bytes, smaller to shuffle."""
    schema = T.StructType([*docs.schema.fields[:-1], T.StructField("__nw_z", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array((box.compress(t.as_buffer()) for t in batch.columns[-1]), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """id, h and ranges (array of lo, hi: bytes in a repeated string, hi exclusive, as found) of docs: id, h, text (binary)."""
    members = stash(_members(docs, length, gram), "units")
    shared = stash(members.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "anchors")
    total = shared.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    members = stash(
        lookup(members, shared.withColumn("shared", F.lit(True)), ["key"], "copies", total, [F.col("h"), F.col("lo")]).drop("shared"), "shared-units"
    )
    kinds = stash(
        members.groupBy("key", "c1", "c2").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("id", "h", "lo", "n", "d")).alias("u")), "kinds"
    )
    groups = stash(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("units")).where("units > 1"), "groups")
    wanted = stash(
        kinds.join(groups.hint("merge"), "key")
        .select("u.id", "u.h", F.struct("key", "c1", "c2", "u.d", "u.n", "u.lo", "units").alias("w"))
        .groupBy("id", "h")
        .agg(F.collect_list("w").alias("wanted")),
        "wanted",
    )
    wanted = wanted.withColumnsRenamed({"id": "id2", "h": "h2"}).hint("merge")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        box = zstandard.ZstdDecompressor()
        for batch in batches:
            for packed, units in zip(*batch.columns, strict=True):
                text = box.decompress(packed.as_buffer())
                for w in units.as_py():
                    yield w["key"], 0, w["c1"], w["c2"], w["d"], w["n"], text[w["lo"] : w["lo"] + w["n"] + length - 1], w["units"]

    schema = f"{_UNIT}, units long"
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
    asked = _packed(docs).join(wanted, same).select("__nw_z", "wanted")
    units = stash(asked.mapInArrow(lambda batches: _filled(cut(batches), schema), schema), "sorted-units")
    whole = kinds.where("copies > 1").select("c1", "c2", F.lit(0).cast("long").alias("lo"), (F.col("u.n") - 1).alias("hi"), "copies")
    by_kind = stash(_by_kind(whole, _ranges(units, length, most, widths)), "ranges")
    # a page that many documents have is one kind with many members: hot kinds are broadcast, their members stay where they are
    placed = lookup(members.select("id", "h", "lo", "c1", "c2"), by_kind, ["c1", "c2"], "copies", total, [F.col("h"), F.col("lo")]).select(
        "id", "h", F.transform("ranges", lambda r: F.struct((F.col("lo") + r["lo"]).alias("lo"), (F.col("lo") + r["hi"] + length).alias("hi"))).alias("r")
    )
    # rows with equal id and text have the same ranges: they count once
    return placed.groupBy("id", "h").agg(F.flatten(F.collect_set("r")).alias("ranges"))


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST,
    widths: tuple[int, ...] = WIDTHS, keep: list[str] | None = None,
) -> DataFrame:
    """docs (columns in keep) with n_bytes, spans (array of start, end of the removed bytes) and kept (the other bytes)."""
    added = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("kept", T.BinaryType()),
    ]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_bytes", "spans", "kept")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    with small_batches(docs.sparkSession, ROWS, BATCH):
        ranges = stash(repeated_ranges(base, length, gram, most, widths), "removed").withColumnsRenamed({"id": "__nw_id2", "h": "__nw_h2", "ranges": "__nw_r"})
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{id_col}`").alias("__nw_id"), F.xxhash64(text).alias("__nw_h"), text.cast("binary").alias("__nw_text"))
    same = F.col("__nw_id").eqNullSafe(F.col("__nw_id2")) & (F.col("__nw_h") == F.col("__nw_h2"))
    joined = _packed(rows).join(ranges.hint("merge"), same, "left").select(*(F.col(f"`{c}`") for c in kept), "__nw_z", "__nw_r")
    schema = T.StructType([*(joined.schema[c] for c in kept), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, spans, left = [], [], []
            held = done = 0
            for packed, found in zip(*batch.columns[-2:], strict=True):
                data = box.decompress(packed.as_buffer())
                gone = _merged(found.as_py() or [])
                edges = [0, *(x for span in gone for x in span), len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in gone])
                left.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                held += len(left[-1])
                if held < BATCH and done + len(sizes) < batch.num_rows:
                    continue
                made = [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(left, pa.binary())]
                kept_rows = batch.slice(done, len(sizes)).columns[:-2]
                yield pa.RecordBatch.from_arrays([*kept_rows, *made], names=schema.fieldNames())
                done += len(sizes)
                sizes, spans, left, held = [], [], [], 0

    return joined.mapInArrow(run, schema)
