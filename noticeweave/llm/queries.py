"""Queries of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeweave.llm.bpe import decode, encode, read_ranks
from noticeweave.llm.chat import format_replies, read_back
from noticeweave.llm.decontaminate import find_contamination
from noticeweave.llm.divergence import divergences
from noticeweave.llm.interactions import audit
from noticeweave.llm.langid import predict, train
from noticeweave.llm.licenses import scan_licenses
from noticeweave.llm.lines import dedup_lines
from noticeweave.llm.repeats import remove_repeats
from noticeweave.llm.secrets import KINDS, scan_secrets
from noticeweave.llm.shards import assign_shards
from noticeweave.llm.simhash import near_duplicates
from noticeweave.llm.winnow import as_string, compare_edits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, report=True).select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    in_order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.unionByName(extra).withColumn("i", F.row_number().over(in_order))
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "i")
    before = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("i") - 1)
    messages = rows.select(name.alias("id"), F.when(F.col("i") > 1, before).alias("parent"), "role", "text")
    found = format_replies(messages).withColumn("conv_id", F.split("root", ":")[0])
    read = read_back(found.withColumn("formatted_chars", F.char_length("formatted").cast("long")), keep=["conv_id", "formatted_chars"])
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        F.when(F.col("conv_id") != "", F.col("conv_id").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turn, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secrets", lambda s: s["depth"] == 0)

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))), ","
        )

    def counted(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(counted, KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    docs = docs.withColumn("held_out", F.crc32(ident.cast("binary")) % 4 == 2)
    return predict(docs, train(docs.where("not held_out")), keep=["doc_id", "held_out"])


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("fingerprint")).alias("fingerprint"),
        as_string(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("licenses.template"))), ",").alias("licenses"),
        F.array_max(F.col("licenses.dice")).alias("best_dice"),
        F.array_join(
            F.transform("licenses", lambda m: F.concat_ws(":", m["template"], m["unit"], m["index"].cast("string"))), ","
        ).alias("places"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"]).select(
        "*",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
    )
    return decode(ids, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    ).withColumn("removed", F.col("n_removed") > 0)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), flags)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat": op3_chat,
    "op4_decontamination": op4_decontamination,
    "op5_secrets": op5_secrets,
    "op6_language_id": op6_language_id,
    "op7_fingerprints": op7_fingerprints,
    "op8_licenses": op8_licenses,
    "op9_bpe": op9_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_divergence": op11_divergence,
    "op12_sharding": op12_sharding,
    "op13_filter_interactions": op13_filter_interactions,
}
