"""Source divergence audit: how the words of each source differ from other sources of its language, and from the language.

Sort-based streaming. Texts are cut into terms in Arrow batches; the terms of a slice of documents are sorted by (lang, term, source, document)
and a scan over runs gives, for each language and term, in how many documents it is and how often in each source. These partial runs are dealt by
(lang, term) and sorted; a second scan puts the partial runs of a term together, one after another, and keeps terms that enough
documents have. A term has one partial row a slice at most, however many documents have it, so no term is hot.

Pairs of sources come from the same runs without going through all terms for all pairs. With p(n) for a term that a source has n times,
a sum over all kept terms is that of absent terms (the same number for each, so V times it), plus corrections of terms that one of the two has (from how many of a
source's terms occur n times: one row for each different n), plus corrections of terms that both have. Only the last need pairs: a scan
over runs adds them up in numpy and gives partial sums by pair of sources. All numbers are integers and exact.

Results for odd rows: a null text, lang or source is the empty string. Each row is a document of its own, whatever ids it shares. A language without kept terms
gives its pairs with value 0 and no terms. Sources without terms count as others do. An empty table gives no rows.
A term's sources travel in one row, and groups (lang and source) are handed to each task: more than GROUPS of them are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeweave.llm.stash import stash

#: Documents that have a kept term at least; ranks of terms that are returned; what probabilities are multiplied by.
LEAST_DOCS, RANKS, SCALE = 3, 200, 1_000_000_000
#: Groups that are handed to tasks at most (24 bytes each).
GROUPS = 1_000_000
#: Bytes of text that are sorted together, and pairs of entries that are computed together.
SLICE, PAIRS = 8 << 20, 1 << 18
_SPACE = 32
_TERMS = np.full(256, _SPACE, np.uint8)
_TERMS[97:123] = np.arange(97, 123)
_TERMS[65:91] = np.arange(97, 123)
_TERMS[128:] = np.arange(128, 256)
_RUN = "lang string, term string, docs long, sources array<long>, counts array<long>"


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values in all columns begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _terms(texts: list[memoryview]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the terms in order, the terms by code, and the text that each is in."""
    data = _TERMS[np.frombuffer(b" ".join(texts), np.uint8)]
    inside = data != _SPACE
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, np.searchsorted(ends, first, side="right")


def _partial(langs: list[str], sources: np.ndarray, texts: list[memoryview]) -> pa.RecordBatch:
    """The partial runs of some documents. Documents come sorted by lang and source here, so their number stands for all three."""
    names, lang = np.unique(np.array(langs, dtype=object), return_inverse=True)
    order = np.lexsort((sources, lang))
    sources, lang = sources[order], lang[order]
    code, dictionary, doc = _terms([texts[i] for i in order])
    n_codes, n_docs = max(1, len(dictionary)), len(texts)
    key = np.sort((lang[doc] * n_codes + code) * n_docs + doc)  # (lang, term, source, document)
    doc, run = key % n_docs, key // n_docs
    group = sources[doc]
    each = _starts(run, group)
    term = _starts(run[each])
    at_term = _starts(run)
    new_doc = np.zeros(len(key), np.int64)
    new_doc[_starts(key)] = 1
    counts = np.diff(np.append(each, len(key)))
    offsets = np.append(term, len(each)).astype(np.int32)
    which = run[at_term]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names, pa.string()).take(pa.array(which // n_codes)),
            dictionary.take(pa.array(which % n_codes)).cast(pa.large_string()).cast(pa.string()),
            pa.array(np.add.reduceat(new_doc, at_term) if len(key) else np.zeros(0, np.int64)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(group[each])),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.astype(np.int64))),
        ],
        names=["lang", "term", "docs", "sources", "counts"],
    )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial runs of slices of about SLICE bytes; a longer text is a slice of its own."""
    langs: list[str] = []
    sources: list[int] = []
    texts: list[memoryview] = []
    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            view = memoryview(text.as_buffer())
            if texts and held + len(view) > SLICE:
                yield _partial(langs, np.array(sources), texts)
                langs, sources, texts, held = [], [], [], 0
            langs.append(lang)
            sources.append(source)
            texts.append(view)
            held += len(view)
    if texts:
        yield _partial(langs, np.array(sources), texts)


def _merge(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted partial runs with those of one (lang, term) put together."""
    n = batch.num_rows
    lang, term = batch.column(0), batch.column(1)
    new = np.ones(n, bool)
    if n > 1:
        differs = pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, n - 1)), pc.not_equal(term.slice(1), term.slice(0, n - 1)))
        new[1:] = differs.to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    lists = batch.column(3)
    entry = np.repeat(run, np.diff(lists.offsets.to_numpy()))
    source = lists.flatten().to_numpy(zero_copy_only=False)
    counts = batch.column(4).flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((source, entry))
    entry, source, counts = entry[order], source[order], counts[order]
    each = _starts(entry, source)
    entry = entry[each]
    offsets = np.append(np.searchsorted(entry, np.arange(len(first))), len(each)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            lang.take(pa.array(first)),
            term.take(pa.array(first)),
            pa.array(np.add.reduceat(batch.column(2).to_numpy(), first)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(source[each])),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.add.reduceat(counts, each))),
        ],
        names=batch.schema.names,
    )


def _scan(least: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole runs of at least so many documents; the last run of a batch waits for the next batch."""
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            merged = _merge(pa.concat_batches([held, batch]) if held is not None else batch)
            held = merged.slice(merged.num_rows - 1)
            done = merged.slice(0, merged.num_rows - 1)
            yield done.filter(pc.greater_equal(done.column(2), least))
        if held is not None:
            yield held.filter(pc.greater_equal(held.column(2), least))

    return run


def term_runs(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS) -> DataFrame:
    """For each lang and term in at least so many of its documents: lang, term, docs, sources (their hashes, see groups) and counts."""
    lang, source = _names(lang_col, source_col)
    rows = docs.select(lang, _hash(lang, source).alias("source"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    partial = rows.mapInArrow(_slices, _RUN)
    return partial.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_scan(least), _RUN)


def _names(lang_col: str, source_col: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(f"`{lang_col}`"), F.lit("")).alias("lang"), F.coalesce(F.col(f"`{source_col}`"), F.lit("")).alias("source")


def _hash(lang: Column, source: Column) -> Column:
    return F.xxhash64(lang, source)


def groups(docs: DataFrame, runs: DataFrame, *, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """For each lang and source that occur: lang, source, id (hash of both), n (occurrences of kept terms), terms (kept ones of the lang)."""
    lang, source = _names(lang_col, source_col)
    found = docs.select(lang, source).distinct().withColumn("id", _hash(F.col("lang"), F.col("source")))
    counted = runs.select(F.inline(F.arrays_zip("sources", "counts"))).groupBy(F.col("sources").alias("id")).agg(F.sum("counts").alias("n"))
    kept = runs.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    return found.join(counted, "id", "left").join(kept, "lang", "left").fillna(0, ["n", "terms"])


def scaled(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / total), for n up to total, by long division in thousands, so that nothing overflows."""
    out = np.zeros(len(n), np.int64)
    rest = n
    for _ in range(3):
        out = out * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return out + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _p(count: str, n: str, terms: str) -> Column:
    """scaled() as a column."""
    return F.expr(f"cast(1 + (({count} + 1) * {SCALE}BD) div ({n} + {terms}) as long)")


def _gain(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


class Pairs:
    """Adds up corrections for terms that both sources have, by pair."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, terms: np.ndarray) -> None:
        self.ids, self.totals = ids, n + terms
        self.base = scaled(np.ones(len(ids), np.int64), np.maximum(self.totals, 1))
        self.keys, self.sums, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys, values = np.concatenate([self.keys, keys]), np.concatenate([self.sums, values])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = _starts(keys)
        self.keys, self.sums = keys[first], np.add.reduceat(values[order], first) if len(first) else np.zeros(0, np.int64)

    def add(self, lists: pa.ListArray, counts: pa.ListArray) -> None:
        sizes = np.diff(lists.offsets.to_numpy())
        at = np.searchsorted(self.ids, lists.flatten().to_numpy(zero_copy_only=False))
        p = scaled(counts.flatten().to_numpy(zero_copy_only=False) + 1, self.totals[at])
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        size, begin = np.repeat(sizes, sizes), np.repeat(begin, sizes)  # of the run of each entry
        up_to = np.cumsum(size)
        low = 0
        while low < len(at):  # entries whose partners are about PAIRS in number
            high = max(low + 1, int(np.searchsorted(up_to, (up_to[low - 1] if low else 0) + PAIRS, side="right")))
            mine = np.repeat(np.arange(low, high), size[low:high])
            first = np.cumsum(size[low:high]) - size[low:high]
            other = np.arange(len(mine)) - np.repeat(first - begin[low:high], size[low:high])
            different = mine != other
            mine, other = mine[different], other[different]
            a, b = at[mine], at[other]
            pa_, pb, qa, qb = p[mine], p[other], self.base[a], self.base[b]
            self._add(a * len(self.ids) + b, gain(pa_, pb) - gain(pa_, qb) - gain(qa, pb) + gain(qa, qb))
            low = high

    def take(self) -> pa.RecordBatch:
        keys, sums = self.keys, self.sums
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = self.ids
        many = max(1, len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[keys // many]), pa.array(ids[keys % many]), pa.array(sums)], names=["a", "b", "value"])


def divergences(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least: int = LEAST_DOCS,
    ranks: int = RANKS,
) -> DataFrame:
    """lang, source, part, item, value, rank: in part pair each other source of the lang, in part term the terms that the source has more of than the lang."""
    runs = stash(term_runs(docs, text_col=text_col, lang_col=lang_col, source_col=source_col, least=least), "term-runs")
    every = stash(groups(docs, runs, lang_col=lang_col, source_col=source_col), "term-groups")
    size = every.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")).first()
    if size["n"] > GROUPS:
        raise ValueError(f"{size['n']} groups of lang and source are more than {GROUPS}")
    if size["n"] > size["ids"]:
        raise ValueError("two groups have one hash")
    pair = _pairs(runs, every)
    term = _top_terms(runs, every, ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*columns).unionByName(term.select(*columns))


def _pairs(runs: DataFrame, every: DataFrame) -> DataFrame:
    known = every.select("id", "n", "terms").orderBy("id").toPandas()
    shared = every.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy(np.int64) for c in ("id", "n", "terms")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Pairs(*shared.value)
        for batch in batches:
            pairs.add(batch.column(0), batch.column(1))
            if len(pairs.keys) > PAIRS:
                yield pairs.take()
        yield pairs.take()

    both = runs.select("sources", "counts").mapInArrow(run, "a long, b long, value long")
    with_base = every.where("terms > 0").select("lang", "id", "n", "terms", F.expr(f"cast(1 + {SCALE}BD div (n + terms) as long)").alias("base"))
    mine, other = (with_base.withColumnsRenamed({c: f"{x}_{c}" for c in ("id", "n", "terms", "base")}) for x in "ab")
    # How many of a source's terms occur so often: with each other source of the lang, what they add to both pairs.
    often = runs.select(F.inline(F.arrays_zip("sources", "counts"))).groupBy(F.col("sources").alias("a_id"), "counts").agg(F.count(F.lit(1)).alias("times"))
    often = often.join(mine, "a_id").withColumn("p", _p("counts", "a_n", "a_terms"))
    one = often.join(other, "lang").where("a_id <> b_id")
    one = one.groupBy("a_id", "b_id").agg(
        F.sum(F.col("times") * (_gain("p", "b_base") - _gain("a_base", "b_base"))).alias("there"),
        F.sum(F.col("times") * (_gain("b_base", "p") - _gain("b_base", "a_base"))).alias("back"),
    )
    one = one.select(F.inline(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(v).alias("value")) for x, y, v in (("a_id", "b_id", "there"), ("b_id", "a_id", "back"))))))
    absent = mine.join(other, "lang").where("a_id <> b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), (F.col("a_terms") * _gain("a_base", "b_base")).alias("value"))
    summed = both.unionByName(one).unionByName(absent).groupBy("a", "b").agg(F.sum("value").alias("value"))
    name = every.select("lang", "source", "id")
    of = name.join(name.select("lang", F.col("source").alias("item"), F.col("id").alias("b")), "lang").where("id <> b").withColumnRenamed("id", "a")
    valued = of.join(summed, ["a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))
    along = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(along))


def _top_terms(runs: DataFrame, every: DataFrame, ranks: int) -> DataFrame:
    of_lang = every.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    whole = runs.withColumn("whole", F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n))
    flat = whole.select("lang", "term", "whole", F.inline(F.arrays_zip("sources", "counts"))).withColumnRenamed("sources", "id")
    known = every.where("terms > 0").select("id", "source", "n", "terms", "lang").join(of_lang, "lang").drop("lang")
    valued = flat.join(known, "id").withColumns({"p": _p("counts", "n", "terms"), "q": _p("whole", "lang_n", "terms")}).where("p > q")
    valued = valued.select("lang", "source", F.col("term").alias("item"), _gain("p", "q").alias("value"))
    along = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
