"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
docs. All but the last return the columns of docs.

Results for odd rows: a null id stays a null id in every stage, rows that are equal in all columns are separate documents except for
near_dedup, an empty table gives an empty table with the same columns, and other columns, whatever their names, go on as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeweave.llm import bpe, decontaminate, langid, likeness, lines, simhash
from noticeweave.llm.stash import stash

VOCABULARY = "byte_bpe_50k.tiktoken"

#: The least posterior of a language that is taken for a document's.
LEAST_SCORE = 0.5

#: A language model and clusters of real documents: SQL can't express them.
ORACLE_SQL = None


def _where(docs: DataFrame, mark: Callable[[DataFrame, str], DataFrame], keep: Column) -> DataFrame:
    """The rows of docs for which keep holds once mark (of docs and their text's name) has added columns; names can't clash."""
    names = {c: f"__nw_c{i}" for i, c in enumerate(docs.columns)}
    marked = mark(docs.withColumnsRenamed(names), names["text"])
    return marked.where(keep).select(*(F.col(new).alias(old) for old, new in names.items()))


def language_id(
    spark: SparkSession, docs: DataFrame, sf_dir: str, *, languages: tuple[str, ...] | None = None, least: float = LEAST_SCORE
) -> DataFrame:
    """Documents in one of languages (None: any that the labelled documents have) of which the model is sure enough.

    Texts that are null, empty or have no letter go, and those for which no language has a posterior of least. Equal texts share one
    fate. Without labelled documents nothing is known and all go.
    """
    model = langid.train(docs)
    keep = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least)
    if languages is not None:
        keep = keep & F.col("lang_pred").isin(*languages)
    return _where(docs, lambda d, text: langid.predict(d, model, text_col=text), keep)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of three lines that came before, by id; n_chars counts what is left.

    A null text stays null with its n_chars; texts of less than three lines stay as they are; a text that came before as a whole is
    empty and n_chars 0. Rows with equal id and text keep the same lines.
    """
    left = lines.dedup_lines(docs)
    return left.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group: linked fingerprints, or a likeness of 0.8 or more, over five words.

    Null, empty and blank texts share fingerprint zero and are one group. Of equal ids the row with the least hash stays, of
    equal rows one. A null id only stays if its group has no other.
    """
    return simhash.dedup(docs, words=likeness.WORDS, more=lambda linked: likeness.connect(docs, linked))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate. Null, empty and wordless texts stay, and all do where no item has words."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _where(docs, lambda d, text: decontaminate.find_contamination(d, benchmark, text_col=text), ~F.col("contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding them gives the text back: a row for each document. A null text is empty: no ids, true."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    rows = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    ids = bpe.encode(rows, ranks, public_tokenizers.PATTERN, keep=["doc_id", "text_sha256"])
    back = bpe.decode(ids, ranks, keep_ids=True)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
