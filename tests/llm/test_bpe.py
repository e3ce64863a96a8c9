"""BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from noticeweave.llm.bpe import decode, encode, read_ranks

RANKS = read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts() -> list[str | None]:
    draw = random.Random(7)
    alphabet = ["a", "don't", "'re", "'", " ", "  ", "\n", "\r\n", "\t", "\xa0", "\x85", "\x1c", "é", "ß", "中文", "½", "²", "9", "12", "!", "--", "😀", "́", "​"]
    made = ["".join(draw.choices(alphabet, k=draw.randrange(1, 60))) for _ in range(300)]
    made += [None, "", " ", "x" * 3000, " " * 700, "a" * 90 + " " * 90 + "\n" * 90, "<|endoftext|> hi"]
    return made + ["".join(draw.choices(alphabet, k=2500)) for _ in range(4)] + made[:3]


@pytest.mark.parametrize(("chunk", "overlap"), [(65536, 1024), (97, 20), (50, 3)])
def test_like_the_library(spark, library, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = encode(df, RANKS, P.PATTERN, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "text", "ids"]
    found = {r.doc_id: r.ids for r in got.collect()}
    assert found == {i: library.encode_ordinary(t or "") for i, t, _ in rows}
    back = {r.doc_id: bytes(r.decoded) for r in decode(got, RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t, _ in rows}


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, 10**6, 0, -4])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in decode(df, RANKS).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and bytes(got[3]) == "��!�".encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert decode(encode(df, RANKS, P.PATTERN), RANKS).count() == 0


def test_query(spark, library):
    from noticeweave.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for r in QUERIES["op9_bpe"](spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(next(d.text for d in docs if d.doc_id == r.doc_id) or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_endless_pretokens_in_linear_time():
    import time

    from noticeweave.llm.bpe import Chunk, Encoder, stitch

    encoder = Encoder(RANKS, P.PATTERN)

    def cut(text, size=4096, overlap=256):
        starts = range(0, len(text), size)
        return [Chunk(at, text[at : at + size + overlap], *encoder.tokens(text[at : at + size + overlap]), at + size >= len(text)) for at in starts]

    draw = random.Random(2)
    for text in ("x" * 300_000, "ab " * 9000 + "y" * 90_000 + " cd" * 9000 + "z" * 50_000, "".join(draw.choices("ab ", [60, 60, 1], k=60_000)), "7" * 40_000 + "a" * 40_000):
        chunks = cut(text)
        began = time.time()
        got = stitch(chunks, encoder).tolist()
        stitched = time.time() - began
        began = time.time()
        want = encoder.tokens(text)[2].tolist()
        assert got == want and stitched < 4 * (time.time() - began) + 1


def test_patterns_that_cut_after_white_space(spark):
    pattern = r"\S+\s*|\s+"  # white space ends a pre-token
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    rows = [(1, "one two  three\n four " * 9), (2, " x  y"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.ids for r in encode(df, RANKS, pattern, chunk=20, overlap=5).collect()} == {i: library.encode_ordinary(t or "") for i, t in rows}


@pytest.mark.parametrize(("chunk", "overlap"), [(65536, 1024), (50, 3)])
def test_letters_of_one_version_of_unicode(spark, library, chunk, overlap):
    every = list(map(chr, (0x558, 0x58B, 0x88F, 0xC5C, 0xCDC, 0x208F, 0x209D, 0xA7CE, 0x11DE0, 0x1246F, 0x323B0)))
    draw = random.Random(5)
    rows = [(i, "".join(draw.choice([*every, *" a7!" * 3, "'s"]) for _ in range(300))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.ids for r in encode(df, RANKS, P.PATTERN, chunk=chunk, overlap=overlap).collect()}
    assert found == {i: library.encode_ordinary(t) for i, t in rows}


def test_new_words_cost_no_more_than_in_the_library(library):
    import time

    from noticeweave.llm.bpe import Encoder

    draw = random.Random(6)
    text = " ".join("".join(draw.choices("abcdefghijklmnoprstuvwy", k=draw.randrange(3, 11))) for _ in range(8000))
    encoder = Encoder(RANKS, P.PATTERN)
    took: dict[bool, list[float]] = {True: [], False: []}
    for own in [True, False] * 12:
        some = text.replace("a", "abcdefghij"[len(took[own]) % 10])
        began = time.process_time()
        got = encoder.ids(some) if own else library.encode_ordinary(some)
        took[own].append(time.process_time() - began)
        assert len(got) > 8000
    assert sum(sorted(took[True])[:6]) < 1.5 * sum(sorted(took[False])[:6])


def test_decode_parts_of_batches(spark):
    rows = [(i, None if i % 7 == 3 else [] if i % 5 == 1 else list(range(i, i + i % 9))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(2)
    tokens = {rank: token for token, rank in RANKS.items()}
    got = {r.doc_id: None if r.decoded is None else bytes(r.decoded) for r in decode(df, RANKS).collect()}
    assert got == {i: None if ids is None else b"".join(tokens[x] for x in ids) for i, ids in rows}
