"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased, whatever isn't a letter is a space and spaces that follow each other are one. The n-grams of
one to three characters fall into a fixed number of buckets. Training counts buckets by language in each
task, sums the counts in Spark and brings one matrix of languages by buckets to the driver. Prediction
adds up, for each text, the log-probabilities of the buckets that it has.

Results for odd rows: a text that is null or has no letter gets `und` and score 0. Rows without a language or
a text don't train. Without any training row all texts get `und`. Of equal scores the language first in order
wins. Repeated rows count as often as they occur. Texts of any length are read whole, in pieces.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeweave.llm.arrow import annotate

BUCKETS = 1 << 15
ORDERS = 3
#: More different labels than this are refused: a model is a matrix of labels by buckets.
MOST_LANGUAGES = 256
#: Characters taken at once from a text, and codes scored at once.
PIECE, BLOCK = 1 << 17, 1 << 18
UNKNOWN = "und"
_GAP, _SPACE = 0, 32

ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


class Model(NamedTuple):
    """langs in order; logs[language, bucket], with one more bucket that counts for nothing; priors."""

    langs: list[str]
    logs: np.ndarray
    priors: np.ndarray


@lru_cache(1)
def _codes() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(sys.maxunicode + 1, _SPACE, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalpha():
            table[c] = ord(low) if len(low := x.lower()) == 1 else c
    return table


class Block(NamedTuple):
    """Codes of stretches of texts: owner[i] is the text of the stretch from begin[i]; buckets by order."""

    owner: np.ndarray
    begin: np.ndarray
    buckets: list[np.ndarray]
    letters: np.ndarray


def _block(owner: list[int], parts: list[np.ndarray], known: list[int], buckets: int) -> Block:
    """A part is a gap, up to two codes that were counted before (known of them), and new codes."""
    codes = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    counted = np.ones(len(codes), bool)
    counted[begin] = False
    for k in (1, 2):
        counted[begin[np.array(known) >= k] + k] = False
    found, mixed, whole = [], np.zeros(len(codes), np.uint32), np.ones(len(codes), bool)
    for order in range(ORDERS):
        shifted = np.concatenate([np.zeros(order, np.uint32), codes[: len(codes) - order]])
        whole &= shifted != _GAP
        mixed = (mixed ^ shifted) * np.uint32(0x9E3779B1) + np.uint32(order + 1)
        bucket = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x85EBCA77) >> np.uint32(32 - (buckets - 1).bit_length())
        found.append(np.where(whole & counted, bucket, buckets).astype(np.int32))
    letters = np.add.reduceat((codes != _SPACE) & counted, begin) > 0
    return Block(np.array(owner), begin, found, letters)


def blocks(texts: Iterable[str | None], buckets: int) -> Iterator[Block]:
    """All texts' n-grams, in blocks of a bounded size."""
    table = _codes()
    owner: list[int] = []
    parts: list[np.ndarray] = []
    known: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        tail = np.array([_GAP, _SPACE], np.uint32)
        for at in range(0, len(text or ""), PIECE):
            raw = table[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
            before = np.concatenate([tail[-1:], raw[:-1]])
            new = raw[(raw != _SPACE) | (before != _SPACE)]
            if not len(new):
                continue
            parts.append(np.concatenate([tail, new]))
            owner.append(i)
            known.append(len(tail) - 1)
            tail = np.concatenate([[np.uint32(_GAP)], np.concatenate([tail[1:], new])[-2:]])
            held += len(new)
            if held >= BLOCK:
                yield _block(owner, parts, known, buckets)
                owner, parts, known, held = [], [], [], 0
    if parts:
        yield _block(owner, parts, known, buckets)


def train(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5
) -> Model:
    """Counts over all rows of docs that have a text and a language."""
    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where(
        "t is not null and l is not null"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        sums = np.zeros((0, buckets + 1), np.int64)
        for batch in batches:
            lang = np.array([number.setdefault(x, len(number)) for x in batch.column(1).to_pylist()], np.int64)
            if len(number) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
            if len(number) > len(sums):
                sums = np.concatenate([sums, np.zeros((len(number) - len(sums), buckets + 1), np.int64)])
            sums[:, buckets] += np.bincount(lang, minlength=len(sums))  # texts of the language
            for block in blocks(batch.column(0).to_pylist(), buckets):
                sizes = np.diff(np.concatenate([block.begin, [len(block.buckets[0])]]))
                row = np.repeat(lang[block.owner] * (buckets + 1), sizes)
                for b in block.buckets:
                    got = np.bincount(row + b, minlength=sums.size).reshape(sums.shape)
                    sums[:, :buckets] += got[:, :buckets]
        lang_of = list(number)
        for i, name in enumerate(lang_of):
            at = np.flatnonzero(sums[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[i, at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    totals = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = totals.toArrow()  # at most languages x buckets rows
    names = np.array(table.column("lang").to_pylist(), object)
    langs = sorted(set(names.tolist()))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = np.zeros((len(langs), buckets + 1))
    place = {name: i for i, name in enumerate(langs)}
    sums[[place[n] for n in names], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    priors = np.log(sums[:, buckets] / max(1, sums[:, buckets].sum()))
    grams = sums[:, :buckets] + smoothing
    logs = np.concatenate([np.log(grams / grams.sum(1, keepdims=True)), np.zeros((len(langs), 1))], 1)
    return Model(langs, logs.astype(np.float32), priors)


def score(texts: list[str | None], model: Model) -> Iterator[tuple[str, float]]:
    """The best language and its posterior for each text."""
    n, buckets = len(texts), model.logs.shape[1] - 1
    sums, letters = np.tile(model.priors, (n, 1)), np.zeros(n, bool)
    for block in blocks(texts if model.langs else [], buckets):
        letters[block.owner[block.letters]] = True
        for j, logs in enumerate(model.logs):
            each = logs[block.buckets[0]]
            for b in block.buckets[1:]:
                each += logs[b]
            np.add.at(sums[:, j], block.owner, np.add.reduceat(each, block.begin, dtype=np.float64))
    for i in range(n):
        if not letters[i]:
            yield UNKNOWN, 0.0
        else:
            best = int(np.argmax(sums[i]))
            yield model.langs[best], float(1 / np.exp(sums[i] - sums[i, best]).sum())


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (columns in keep) with lang_pred and score (the posterior). The model is broadcast; train() bounds it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return annotate(docs, [text_col], ADDED, lambda: lambda texts: score(texts, shared.value), keep)
