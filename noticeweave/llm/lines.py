"""Line dedup: windows of three consecutive lines that came before are removed.

Each text is split at line feeds and each three consecutive lines are hashed (128 bits). Windows that occur more than
once anywhere keep their first occurrence, in the order of id, text hash and line; all lines that a later
occurrence covers go, where occurrences that touch or overlap are merged into one run.

Results for odd rows: a null text stays null; a text of less than three lines has no window and stays as it is,
the empty text included. A null id comes first in order. Rows with the same id and the same text are one document:
they get the same result. Documents with one id and different texts are ordered by the texts' hashes. A text that
came before as a whole becomes the empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeweave.llm.stash import lookup, stash

WINDOW = 3
_ID, _HASH, _POS = "__nw_id", "__nw_hash", "__nw_pos"


def _windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """A row for each window: a, b (its hash), id, hash of the text, first line."""
    lines = docs.select(
        F.col(f"`{id_col}`").alias(_ID), F.xxhash64(F.col(f"`{text_col}`")).alias(_HASH), F.split(f"`{text_col}`", "\n", -1).alias("lines")
    ).where(F.size("lines") >= window)
    each = F.transform(
        F.sequence(F.lit(1), F.size("lines") - window + 1),
        lambda i: F.struct(
            *(
                F.xxhash64(F.lit(seed), *(F.element_at("lines", i + k) for k in range(window))).alias(name)
                for seed, name in ((1, "a"), (2, "b"))
            )
        ),
    )
    return lines.select(_ID, _HASH, F.posexplode(each).alias(_POS, "w")).select("w.a", "w.b", _ID, _HASH, _POS)


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """For each document with lines to remove: id, hash of its text, runs (array of first and last line, from 0)."""
    windows = _windows(docs, id_col, text_col, window)
    repeated = stash(
        windows.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(_ID, _HASH, _POS)).alias("first"))
        .where("n > 1"),
        "line-windows",
    )
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    here = F.struct(_ID, _HASH, _POS)
    later = (
        lookup(windows, repeated, ["a", "b"], "n", total, [F.col(_ID), F.col(_HASH), F.col(_POS)])
        .where(here > F.col("first"))
        .select(_ID, _HASH, _POS)
        .distinct()
    )
    in_doc = W.partitionBy(_ID, _HASH).orderBy(_POS)
    begins = F.col(_POS) > F.coalesce(F.lag(_POS).over(in_doc) + window, F.lit(-1))
    runs = (
        later.withColumn("begins", begins.cast("int"))
        .withColumn("run", F.sum("begins").over(in_doc))
        .groupBy(_ID, _HASH, "run")
        .agg(F.min(_POS).alias("first"), (F.max(_POS) + window - 1).alias("last"))
    )
    return runs.groupBy(_ID, _HASH).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, report: bool = False
) -> DataFrame:
    """docs with repeated windows removed from the text; with report also n_lines, n_removed and n_runs."""
    runs = stash(repeated_lines(docs, id_col=id_col, text_col=text_col, window=window), "line-runs").select(
        F.col(_ID).alias("__nw_id2"), F.col(_HASH).alias("__nw_hash2"), "runs"
    ).withColumnRenamed("runs", "__nw_runs")
    names = docs.columns
    text = F.col(f"`{text_col}`")
    same = F.col("__nw_id2").eqNullSafe(F.col(f"`{id_col}`")) & (F.col("__nw_hash2") == F.xxhash64(text))
    lines = F.split(text, "\n", -1)
    k = F.size("__nw_runs")
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(1), k + 1),
            lambda i: F.slice(
                F.col("__nw_lines"),
                F.when(i == 1, 1).otherwise(F.get("__nw_runs", i - 2)["last"] + 2),
                F.when(i > k, F.size("__nw_lines")).otherwise(F.get("__nw_runs", i - 1)["first"])
                - F.when(i == 1, 0).otherwise(F.get("__nw_runs", i - 2)["last"] + 1),
            ),
        )
    )
    removed = F.aggregate("__nw_runs", F.lit(0), lambda s, r: s + r["last"] - r["first"] + 1)
    joined = docs.join(runs.hint("merge"), same, "left").withColumn("__nw_lines", lines)
    made = {text_col: F.when(F.col("__nw_runs").isNull(), text).otherwise(F.array_join(kept, "\n")).alias(text_col)}
    if report:
        made |= {
            "n_lines": F.when(text.isNull(), 0).otherwise(F.size("__nw_lines")).cast("long").alias("n_lines"),
            "n_removed": F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
            "n_runs": F.coalesce(F.when(F.col("__nw_runs").isNotNull(), k), F.lit(0)).cast("long").alias("n_runs"),
        }
    return joined.select(*(made.get(c, F.col(f"`{c}`")) for c in names), *(v for c, v in made.items() if c not in names))
