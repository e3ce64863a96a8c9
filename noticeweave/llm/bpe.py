"""Byte-level BPE: text to ids by a file of ranks, and ids to bytes.

Encoding splits a text by a pattern into pre-tokens and merges each one's bytes by rank; for a text of up to a
chunk both are compiled code (tiktoken's). A longer text is cut into overlapping chunks that tasks pre-tokenise and encode in
parallel, with the starts of pre-tokens, which tiktoken doesn't tell. The pattern
looks ahead a few characters and never back, so two tokenisations agree from any place where both have a
boundary: neighbouring chunks are stitched at the first such place in their overlap. Where overlaps have
none (one endless pre-token), all chunks up to the next such place are tokenised again as one, once.

That holds for the patterns in SEGMENTED. With any other one, texts are pre-tokenised whole, each in the task that has it.

What is a letter or a number is told by tiktoken's tables of Unicode, also where another module finds the starts.

Results for odd rows: a null text is encoded as an empty one, to no ids; null ids decode to null, and an id that the
vocabulary doesn't have decodes to the bytes of U+FFFD. Repeated rows get equal results.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache, cached_property
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of a chunk, and of the overlap of two.
CHUNK, OVERLAP = 65_536, 1_024
#: A boundary this near the end of a cut text may depend on characters beyond.
LOOK = 4
# Patterns in which white space only begins or fills a pre-token, and which look ahead by less than LOOK characters.
SEGMENTED = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
)
#: Characters that stand for a letter, a number and neither, none of them in a pattern.
TWINS = ("\u00e9", "\u00b2", "\ue000")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def newer() -> dict[int, str]:
    """Characters that the module regex takes for letters or numbers and tiktoken doesn't, or the other way, to one that both take for the same.

    Each has its own version of Unicode.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    ranks = {bytes([i]): i for i in range(256)}

    def told(kind: str) -> set[str]:
        found = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)
        return set(bytes(found).decode())

    letters, numbers = told(r"\p{L}"), told(r"\p{N}")
    differ = (letters ^ set(regex.findall(r"\p{L}", every))) | (numbers ^ set(regex.findall(r"\p{N}", every)))
    return {ord(c): TWINS[0 if c in letters else 1 if c in numbers else 2] for c in differ}


class Encoder:
    """Ids of text: as a whole, or with its pre-tokens. other: characters to others, for the starts of pre-tokens (see newer)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, other: dict[int, str] | None = None) -> None:
        self.ranks, self.pattern, self.other = ranks, pattern, newer() if other is None else other
        self.pretokens = regex.compile(pattern)

    @cached_property
    def ids(self) -> Callable[[str], list[int]]:
        """A text's ids. For texts of up to a chunk: a pattern may need more steps on an endless pre-token than compiled code takes."""
        return tiktoken.Encoding("text", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

    @cached_property
    def merge(self) -> Callable[[str], list[int]]:
        """One pre-token's ids: the whole of what it gets is one piece."""
        return tiktoken.Encoding("piece", pat_str="(?s).+", mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pre-token's start, number of ids, and all ids."""
        starts, counts, ids = [], [], []
        for m in self.pretokens.finditer(text if text.isascii() else text.translate(self.other)):
            got = self.merge(text[m.start() : m.end()])
            starts.append(m.start())
            counts.append(len(got))
            ids.extend(got)
        return np.array(starts, np.int64), np.array(counts, np.int64), np.array(ids, np.int32)


class Chunk:
    """A chunk's pre-tokens with starts in its text, and ids."""

    def __init__(self, lo: int, text: str, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray, last: bool) -> None:
        self.lo, self.text, self.last = lo, text, last
        self.starts, self.bounds, self.ids = starts + lo, np.concatenate([[0], np.cumsum(counts)]), ids

    def trusted(self) -> np.ndarray:
        """Starts that what follows the chunk can't move."""
        return self.starts if self.last else self.starts[self.starts <= self.lo + len(self.text) - LOOK]

    def between(self, begin: int, end: int | None) -> np.ndarray:
        """Ids of the pre-tokens from begin up to end."""
        i = np.searchsorted(self.starts, begin)
        j = len(self.starts) if end is None else np.searchsorted(self.starts, end)
        return self.ids[self.bounds[i] : self.bounds[j]]


def common(now: Chunk, after: Chunk, begin: int) -> np.ndarray:
    """Places from begin on where both chunks have a boundary."""
    mine = now.trusted()
    return np.intersect1d(mine[mine >= max(begin, after.lo + 1)], after.starts)


def stitch(chunks: list[Chunk], encoder: Encoder) -> np.ndarray:
    """The ids of the text that the chunks cover, in order of lo; the first begins at 0."""
    out, begin, now = [], 0, chunks[0]
    meets = [len(common(a, b, 0)) > 0 for a, b in pairwise(chunks)] + [True]
    i = 1
    while i < len(chunks):
        both = common(now, chunks[i], begin)
        if len(both):
            out.append(now.between(begin, int(both[0])))
            begin, now = int(both[0]), chunks[i]
        else:
            mine = now.trusted()
            mine = mine[mine >= begin]
            restart = int(mine[-1]) if len(mine) else begin
            out.append(now.between(begin, restart))
            parts, at = [now.text[restart - now.lo : chunks[i].lo - now.lo]], i
            while not meets[i]:  # one endless pre-token: as far as it may go
                i += 1
            parts += [a.text[: b.lo - a.lo] for a, b in pairwise(chunks[at : i + 1])]
            text = "".join([*parts, chunks[i].text])
            begin, now = restart, Chunk(restart, text, *encoder.tokens(text), chunks[i].last)
        i += 1
    return np.concatenate([*out, now.between(begin, None)])


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    *,
    text_col: str = "text",
    ids_col: str = "ids",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (columns in keep) with ids_col, the text's ids. Special tokens are ordinary text.

    ranks is broadcast; a vocabulary has a fixed size (2,000,000 ranks at most). Texts of up to a chunk are encoded where they
    are read; only longer ones, once for each different text, are cut and shuffled, if pattern is in SEGMENTED.
    """
    if len(ranks) > 2_000_000:
        raise ValueError("too many ranks to broadcast")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((ranks, pattern, newer()))
    kept = [c for c in (docs.columns if keep is None else keep) if c != ids_col]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = docs.select(*(F.col(f"`{c}`") for c in kept), text.alias("__nw_text"))
    long = F.char_length("__nw_text") > chunk if pattern in SEGMENTED else F.lit(False)
    schema = T.StructType([*(base.schema[c] for c in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in sliced(batches):
            texts = (t.as_py() for t in batch.column(len(kept)))
            made = [np.array(encoder.ids(t) if len(t) <= CHUNK else encoder.tokens(t)[2], np.int32) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *made])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*kept, ids_col])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            rows = batch.to_pylist()
            made = [encoder.tokens(r["piece"]) for r in rows]
            columns = [[r[k] for r in rows] for k in ("key", "lo", "piece", "last")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=t) for v, t in zip([*columns, *([x[i].tobytes() for x in made] for i in range(3))], part_types, strict=True)],
                names=part_schema.fieldNames(),
            )

    def join_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        encoder = Encoder(*shared.value)
        rows = pdf.sort_values("lo").itertuples(index=False)
        chunks = [
            Chunk(r.lo, r.piece, np.frombuffer(r.starts, np.int64), np.frombuffer(r.counts, np.int64), np.frombuffer(r.ids, np.int32), r.last)
            for r in rows
        ]
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], ids_col: [stitch(chunks, encoder)]})

    part_schema = T.StructType.fromDDL("key binary, lo bigint, piece string, last boolean, starts binary, counts binary, ids binary")
    part_types = [f.type for f in to_arrow_schema(part_schema)]
    short = base.where(~long).mapInArrow(here, schema)

    longer = base.where(long).withColumn("__nw_key", F.unhex(F.sha2("__nw_text", 256)))
    texts = longer.groupBy("__nw_key").agg(F.first("__nw_text").alias("t"))
    n = F.char_length("t")
    pieces = texts.select(
        F.col("__nw_key").alias("key"),
        F.explode(
            F.transform(
                F.sequence(F.lit(0), ((n - 1) / chunk).cast("int")),
                lambda i: F.struct(
                    (i * chunk).cast("long").alias("lo"),
                    F.substring(F.col("t"), i * chunk + 1, F.lit(chunk + overlap)).alias("piece"),
                    (i * chunk + chunk + overlap >= n).alias("last"),
                ),
            )
        ).alias("c"),
    ).select("key", "c.*")
    parts = pieces.repartition("key", "lo").mapInArrow(part, part_schema)
    done = parts.groupBy("key").applyInPandas(join_parts, T.StructType([T.StructField("key", T.BinaryType()), schema[ids_col]]))
    return short.unionByName(
        longer.join(done, F.col("__nw_key") == F.col("key")).select(*(F.col(f"`{c}`") for c in kept), F.col(ids_col))
    )


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Few rows at a time; memory that Arrow no longer uses goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()


def decode(
    df: DataFrame, ranks: dict[bytes, int], *, ids_col: str = "ids", bytes_col: str = "decoded", keep_ids: bool = False
) -> DataFrame:
    """df with bytes_col, the ids' bytes one after the other, and without ids_col unless keep_ids."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in df.columns if c not in (ids_col, bytes_col)]
    base = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{ids_col}`").cast("array<int>").alias("__nw_ids"))
    own = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] if keep_ids else []
    schema = T.StructType([*(base.schema[c] for c in kept), *own, T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        known = [b"\xef\xbf\xbd"] * (max(ranks.values(), default=0) + 2)
        for token, rank in ranks.items():
            known[rank] = token
        table, none = pa.array(known, pa.binary()), len(known) - 1
        for batch in sliced(batches):
            found = batch.column(len(kept))
            offsets = found.offsets.to_numpy()
            values = found.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1).to_numpy(zero_copy_only=False)
            values = np.append(np.where((values < 0) | (values > none), none, values), none)  # never empty: then there are buffers
            _, ends, data = table.take(pa.array(values)).buffers()
            ends = np.frombuffer(ends, np.int32)[offsets - offsets[0]]
            made = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), data])
            if found.null_count:
                made = pc.if_else(found.is_valid(), made, pa.scalar(None, pa.binary()))
            columns = batch.columns if keep_ids else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, made], names=schema.fieldNames())

    return base.mapInArrow(run, schema)
