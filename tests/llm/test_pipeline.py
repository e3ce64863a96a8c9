"""The pipeline against plain loops."""

import base64
from itertools import pairwise

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from noticeweave.llm.decontaminate import words
from tests.llm.test_likeness import connected, like
from tests.llm.test_simhash import groups, slow


def dedup_lines(docs):
    seen, out = {}, []
    for i, t in docs:
        lines = t.split("\n")
        for k in range(len(lines) - 2):
            seen.setdefault(tuple(lines[k : k + 3]), (i, k))
    for i, t in docs:
        lines = t.split("\n")
        gone = {k + j for k in range(len(lines) - 2) if seen[tuple(lines[k : k + 3])] != (i, k) for j in range(3)}
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def contaminated(text, windows):
    w = words(text)
    hit = set()
    for m, known in windows.items():
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in known:
                hit.update(range(i, i + m))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    windows = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(m, set()).add(tuple(w[i : i + m]))
    left = dedup_lines([(i, t) for i, t in docs if any(c.isalpha() for c in t or "")])
    bits = groups([slow(t, 5) for _, t in left])
    alike = [(i, j) for i, (_, a) in enumerate(left) for j, (_, b) in enumerate(left[:i]) if like(a, b)]
    top = connected(len(left), [*enumerate(bits), *alike])
    left = [d for n, d in enumerate(left) if top[n] == n and not contaminated(d[1], windows)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted(corpus_pipeline.run(spark, sf).collect())
    assert len(left) < len(docs)
    assert [(r.doc_id, r.ids) for r in got] == [(i, library.encode_ordinary(t)) for i, t in left]
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, "en", 3), (2, "", "en", 0), (3, "Hello there", None, 11), (3, "Hello there", None, 11), (None, "Hi\nyou\nall\nx", "en", 12), (5, "Hi\nyou\nall\ny", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").withColumns({"score": F.lit("s"), "items": F.lit(1), "f": F.lit(2)})
    for a, (_, stage) in pairwise([(None, None), *corpus_pipeline.STAGES]):
        for some in (docs.limit(0), docs):
            out = stage(spark, some, "/root/testdata/sf0.001")
            if stage is not corpus_pipeline.tokens:
                assert out.columns == docs.columns
            n = out.count()
            assert n <= some.count() and (n > 0 or not some.count())
        docs = out if stage is not corpus_pipeline.tokens else docs


def test_odd_rows_by_value(spark):
    """What each stage keeps of nulls, empty texts, repeated rows and equal ids."""
    names = "doc_id long, text string, lang string, n_chars long, lang_pred string"
    rows = [(1, None, "en", 3, "a"), (2, "", "en", 0, "a"), (3, "Hello there", None, 11, None), (3, "Hello there", None, 11, None), (None, "Hi\nyou\nall\nx", "en", 12, "b"), (5, "Hi\nyou\nall\ny", None, None, "c")]
    docs = spark.createDataFrame(rows, names)

    def ids(stage, some=docs):
        return sorted((str(r.doc_id), r.text, r.n_chars) for r in stage(spark, some, "/root/testdata/sf0.001").collect())

    assert ids(corpus_pipeline.language_id) == sorted((str(r[0]), r[1], r[3]) for r in rows[2:])
    only = lambda *a: corpus_pipeline.language_id(*a, languages=("xx",))
    assert ids(only) == [] and ids(lambda *a: corpus_pipeline.language_id(*a, least=1.1)) == []
    # a null id comes first in order, so document 5 loses the window
    assert ids(corpus_pipeline.line_dedup) == sorted([("1", None, 3), ("2", "", 0), ("3", "Hello there", 11), ("3", "Hello there", 11), ("None", "Hi\nyou\nall\nx", 12), ("5", "y", 1)], key=str)
    kept = ids(corpus_pipeline.near_dedup)
    assert [k for k in kept if k[0] in "12"] == [("1", None, 3)] and [k for k in kept if k[0] == "3"] == [("3", "Hello there", 11)]
    assert ids(corpus_pipeline.decontamination) == sorted(((str(r[0]), r[1], r[3]) for r in rows), key=str)
    out = sorted(((str(r.doc_id), r.n_tokens, len(r.ids), r.round_trip) for r in corpus_pipeline.tokens(spark, docs, "").collect()))
    assert len(out) == 6 and all(r[3] and r[1] == r[2] for r in out) and [r[1] for r in out if r[0] in "12"] == [0, 0]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_posterior_rejects(spark):
    """A text with signs of both languages isn't kept where the model has to be very sure: by hand, its posterior is 11 / 12."""
    rows = [(i, "aaaa", "aa", 1) for i in range(5)] + [(i, "bbbb", "bb", 1) for i in range(5, 10)] + [(20, "ab", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    kept = lambda least: {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "", least=least).collect()}
    assert kept(0.5) == kept(0.91) == {*range(10), 20} and kept(0.92) == kept(0.99) == set(range(10))


def test_tables_are_cleared(spark):
    from noticeweave.llm import stash

    table = stash.stash(spark.range(5), "x")
    assert table.count() == 5
    # other tests' tables are in the same application: only the call's answer and the folder's name are looked at
    assert stash.own_folder(spark).endswith(spark.sparkContext.applicationId)
