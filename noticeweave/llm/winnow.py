"""Document fingerprints: winnowing of hashed k-grams.

Every K consecutive bytes of a text (UTF-8) are a k-gram, hashed by XXH64. Of each W consecutive k-grams the least hash
is chosen, the rightmost of equal ones, and kept with its position. Two texts that share W + K - 1 bytes share a
choice. A text of up to W k-grams is one window; one of less than K bytes has itself as its only k-gram.

Work is spread over rows of a few hundred windows each: a row has the bytes that its windows need, every hash is a
column, and minima over 2, 4, 8, ... neighbours lead to those over W, so that all of it is compiled
expressions. The rows of a text stay in the task that has the text.

Results for odd rows: a null text is empty; an empty text has an empty fingerprint, and two empty fingerprints are alike
(1.0), an empty and another one are not (0.0). Rows with one id and the same text are one document and each gets its
result; documents with one id and different texts are ordered by the texts' hashes. A null id is the last in descending order.
A table of one document has itself as the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as Win

from noticeweave.llm.stash import stash

K, W = 16, 96
_NONE = (1 << 63) - 1
#: Bits of a packed hash that hold a k-gram's place in its row.
_PLACE = 9
#: Windows of a row, as a multiple of w: rows share fewer hashes with their neighbours if they are longer.
ROW = 1
FINGERPRINT = "array<struct<pos:bigint,hash:bigint>>"


def _blocks(which: int, text: Column, k: int, w: int, carry: T.StructType) -> Column:
    """Rows of up to ROW * w windows: which, off (of the first k-gram), block (bytes), windows, grams, carry (null)."""
    n = F.octet_length(text)
    grams = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), n - k + 1))
    windows = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), grams - w + 1))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), windows - 1), F.lit(ROW * w))

    def row(data: Column, off: Column) -> Column:
        return F.struct(
            F.lit(which).alias("which"),
            off.alias("off"),
            F.substring(data, off + 1, F.lit((ROW + 1) * w + k - 2)).alias("block"),
            F.least(F.lit(ROW * w), windows - off).alias("windows"),
            F.least(F.lit((ROW + 1) * w - 1), grams - off).alias("grams"),
            F.lit(None).cast(carry).alias("carry"),
        )

    # an array of one binds the bytes to a variable, so that the text is encoded once and not for each row
    rows = F.flatten(F.transform(F.array(F.encode(text, "UTF-8")), lambda data: F.transform(at, lambda off: row(data, off))))
    return F.filter(rows, lambda r: r["windows"] > 0)


def winnow(df: DataFrame, keys: list[str], texts: list[Column], carry: Column, k: int = K, w: int = W) -> DataFrame:
    """keys, carry (a struct) and prints: for each text an array of (pos, hash) in order.

    df has one row for each value of keys. Where df is partitioned by keys, nothing is shuffled.
    """
    if (ROW + 1) * w - 1 > 1 << _PLACE:
        raise ValueError("w is too large")
    kind = df.select(carry.alias("c")).schema["c"].dataType
    first = F.array(
        F.struct(
            F.lit(-1).alias("which"),
            F.lit(0).alias("off"),
            F.lit(None).cast("binary").alias("block"),
            F.lit(0).alias("windows"),
            F.lit(0).alias("grams"),
            carry.alias("carry"),
        )
    )
    rows = df.select(*keys, F.explode(F.concat(first, *(_blocks(i, t, k, w, kind) for i, t in enumerate(texts)))).alias("r")).select(
        *keys, "r.*"
    )
    kept = [*keys, "which", "off", "windows", "carry"]
    mask = ~((1 << _PLACE) - 1)
    last = (ROW + 1) * w - 2

    def packed(j: int) -> Column:
        h = F.shiftrightunsigned(F.xxhash64(F.substring("block", j + 1, k)), 1)
        return F.when(F.col("grams") > j, h.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(last - j))).otherwise(F.lit(_NONE))

    level = rows.select(*kept, *(packed(j).alias(f"m{j}") for j in range((ROW + 1) * w - 1)))
    size, count = 1, (ROW + 1) * w - 1
    while size * 2 <= w:
        count -= size
        level = level.select(*kept, *(F.least(f"m{j}", f"m{j + size}").alias(f"m{j}") for j in range(count)))
        size *= 2
    rest = w - size
    least = (F.least(f"m{j}", f"m{j + rest}") if rest else F.col(f"m{j}") for j in range(ROW * w))
    chosen = F.array_distinct(F.array(*(F.when(F.col("windows") > j, x) for j, x in enumerate(least))))
    found = level.select(*keys, "which", "off", "carry", chosen.alias("chosen"))
    parts = found.groupBy(*keys).agg(
        F.first("carry", ignorenulls=True).alias("carry"),
        F.collect_list(F.when(F.col("which") >= 0, F.struct("which", "off", "chosen"))).alias("parts"),
    )

    def prints(i: int) -> Column:
        own = F.filter("parts", lambda p: p["which"] == i)
        # place and hash in one number: numbers are made distinct by hashing
        each = F.transform(
            own,
            lambda p: F.transform(
                F.filter(p["chosen"], lambda v: v.isNotNull()),
                lambda v: F.shiftleft((p["off"] + last - v.bitwiseAND(F.lit(~mask))).cast("long"), 32).bitwiseOR(F.shiftrightunsigned(v, 32)),
            ),
        )
        return F.transform(
            F.sort_array(F.array_distinct(F.flatten(each))),
            lambda x: F.struct(F.shiftright(x, 32).alias("pos"), x.bitwiseAND(F.lit((1 << 32) - 1)).alias("hash")),
        )

    return parts.select(*keys, "carry", F.array(*(prints(i) for i in range(len(texts)))).alias("prints"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes, as sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def as_string(prints: Column) -> Column:
    """Choices as hash@position, hashes in hex, joined by spaces."""
    return F.array_join(F.transform(prints, lambda p: F.concat(F.lower(F.hex(p["hash"])), F.lit("@"), p["pos"].cast("string"))), " ")


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def _key(ident: Column) -> Column:
    """An id as a string that is never null."""
    return F.when(ident.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), ident.cast("string")))


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each document (key, h: its text's hash) by descending id: chars, rows, after and before (structs of key, h).

    Ids are dealt by range; within a range the next one is a neighbour, and the ends of ranges, one row
    for each partition, meet at the driver.
    """
    spark = docs.sparkSession
    ids = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(_text(text_col)).alias("h"), F.char_length(_text(text_col)).cast("long").alias("chars")
    )
    ids = ids.groupBy("id", "h", "chars").agg(F.count(F.lit(1)).alias("rows"))
    order = [F.col("id").desc_nulls_last(), F.col("h")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stash(ids.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ids")
    inside = Win.partitionBy("part").orderBy(*order)
    me = F.struct(_key(F.col("id")).alias("key"), F.col("h").alias("h"))
    linked = stash(
        ranged.select("part", me.alias("me"), "chars", "rows", F.lead(me).over(inside).alias("after"), F.lag(me).over(inside).alias("before")),
        "neighbours",
    )
    ends = linked.where("after is null or before is null").select("part", "me", "after", "before")
    tops = {r.part: r.me for r in ends.where("before is null").collect()}  # a row for each partition
    tails = {r.part: r.me for r in ends.where("after is null").collect()}
    parts = sorted(tops)
    schema = T.StructType().add("part", T.IntegerType()).add("top", linked.schema["me"].dataType).add("tail", linked.schema["me"].dataType)
    rows = [(p, tuple(tops[parts[(i + 1) % len(parts)]]), tuple(tails[parts[i - 1]])) for i, p in enumerate(parts)]
    edges = spark.createDataFrame(rows, schema)
    return linked.join(F.broadcast(edges), "part").select(
        "me.*", "chars", "rows", F.coalesce("after", "top").alias("after"), F.coalesce("before", "tail").alias("before")
    )


def fingerprint(docs: DataFrame, *, text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Each different text once: text_hash (XXH64, seed 42), text and fingerprint (pos, hash)."""
    texts = docs.select(F.xxhash64(_text(text_col)).alias("text_hash"), _text(text_col).alias("text")).distinct()
    made = winnow(texts, ["text_hash"], [F.col("text")], F.struct("text"), k, w)
    return made.select("text_hash", "carry.text", F.col("prints")[0].alias("fingerprint"))


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """A row for each of docs: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint (arrays), near_edited, near_next.

    The edited text has its last third replaced by the beginning of the next document by descending id.
    """
    links = neighbours(docs, id_col, text_col)
    on = ["key", "h"]
    ident = F.col(f"`{id_col}`")
    # read on both sides of the joins below, in one form, so that it is shuffled once
    texts = (
        docs.select(_key(ident).alias("key"), F.xxhash64(_text(text_col)).alias("h"), _text(text_col).alias("text"))
        .groupBy(*on)
        .agg(F.first("text").alias("text"))
    )
    id_type = docs.schema[id_col].dataType
    # each document asks the next one for its beginning
    asks = links.select(
        F.col("after.key").alias("key"), F.col("after.h").alias("h"), F.struct("key", "h").alias("to"),
        F.floor(F.col("chars") / 3).cast("int").alias("third"), "chars", "rows", "before",
    )
    gives = texts.join(asks, on).select("to.*", F.expr("substring(text, 1, third)").alias("tail"), "third", "chars", "rows", "before")
    pairs = texts.join(gives, on).withColumn("edited", F.concat(F.expr("substring(text, 1, int(chars) - third)"), F.col("tail")))
    carry = F.struct("chars", "rows", "before", F.sha2("edited", 256).alias("sha"))
    made = winnow(pairs, on, [F.col("text"), F.col("edited")], carry, k, w)
    own, other = F.col("prints")[0], F.col("prints")[1]
    mine = F.struct("carry.chars", "carry.rows", "carry.sha", own.alias("own"), other.alias("other"))
    hashes = F.transform(own, lambda p: p["hash"].cast("int"))
    # each document's choices go to itself and, as hashes only, to the one before it
    sent = made.select(
        F.explode(
            F.array(
                F.struct(*on, mine.alias("mine"), F.lit(None).cast("array<int>").alias("next")),
                F.struct("carry.before.key", "carry.before.h", F.lit(None).cast(made.select(mine.alias("m")).schema["m"].dataType).alias("mine"), hashes.alias("next")),
            )
        ).alias("s")
    ).select("s.*")
    met = sent.groupBy(*on).agg(F.first("mine", ignorenulls=True).alias("m"), F.first("next", ignorenulls=True).alias("next"))
    result = met.select(
        F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30).cast(id_type)).alias(id_col),
        F.col("m.chars").alias("n_chars"),
        F.col("m.sha").alias("edited_sha256"),
        F.col("m.own").alias("fingerprint"),
        F.col("m.other").alias("edited_fingerprint"),
        likeness(F.col("m.own.hash"), F.col("m.other.hash")).alias("near_edited"),
        likeness(F.transform("m.own", lambda p: p["hash"].cast("int")), F.col("next")).alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), F.col("m.rows").cast("int"))).alias("copy"),
    )
    return result.drop("copy")
