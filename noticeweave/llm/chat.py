"""Chat formatting: reply trees to conversations, and conversations back to turns.

Each message names the message that it replies to. Pointers to the message 2**k steps up are found by joining the
table of pointers with itself, so the depth, root and score of each message take a number of joins that is logarithmic
in the deepest tree. Leaves are ranked within their tree by the sum of the scores on their path (then by longer
paths, then by id); the chosen ones collect their path by the same pointers, and each path is formatted as one text.

The template puts <|im_start|>ROLE, a line feed, the text and <|im_end|> with a line feed around each turn. Inside texts and
roles a control string gets a backslash after its first character, and one that has some already gets one more, so
that none is left and taking one away gives the text back.

Results for odd rows: a null text or role is empty. A message whose parent isn't there is a root. Messages on a cycle, or that
reply to one, have no root and are in no path. Repeated rows are one message; of messages with one id and different
parents, scores, roles or texts the least row counts, as a whole and by these in order. A null id is no message.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from noticeweave.llm.arrow import annotate
from noticeweave.llm.stash import stash

BEGIN, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates, without their first character.
CONTROLS = ("|im_start|>", "|im_end|>", "|endoftext|>", "INST]", "/INST]", "s>", "/s>", "<SYS>>", "</SYS>>")
_ESCAPABLE = re.compile(r"([<\[])(\\*)(?=(?:" + "|".join(re.escape(c) for c in CONTROLS) + "))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=(?:" + "|".join(re.escape(c) for c in CONTROLS) + "))")
_TURN = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
#: Whose texts are learned.
LEARNED = "assistant"

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FORMATTED = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(_SPAN))])
_TURN_TYPE = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
READ = T.StructType([T.StructField("turns", T.ArrayType(_TURN_TYPE)), T.StructField("loss_text", T.StringType())])


def escape(text: str) -> str:
    return _ESCAPABLE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as a text, and the spans (code points) of it that are learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{_role(role)}\n", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def reply_paths(
    messages: DataFrame, *, id_col: str = "id", parent_col: str = "parent", score_col: str | None = None, paths_per_root: int = 1
) -> DataFrame:
    """leaf, rank (from 1), root, node, depth (from 0): the messages on the best paths of each tree."""
    score = F.coalesce(F.col(f"`{score_col}`").cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    nodes = (
        messages.select(F.col(f"`{id_col}`").alias("node"), F.col(f"`{parent_col}`").alias("parent"), score.alias("score"))
        .where("node is not null")
        .groupBy("node")
        .agg(F.min(F.struct("parent", "score")).alias("m"))
        .select("node", "m.*")
    )
    return _paths(stash(nodes, "messages"), paths_per_root)


def _paths(nodes: DataFrame, paths_per_root: int) -> DataFrame:
    """reply_paths of a stashed table of node (each once), parent and score."""
    there = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    # up: the message `far` steps up or null above the root; sum: scores from the node to below up
    state = nodes.join(there, "parent", "left").select(
        "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("far"), F.col("score").alias("sum"), F.col("node").alias("top")
    )
    levels = [stash(state, "up")]
    most = nodes.count().bit_length()
    while len(levels) <= most and not levels[-1].where("up is not null").isEmpty():
        now = levels[-1]
        above = now.select(
            F.col("node").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("sum").alias("sum2"), F.col("top").alias("top2")
        )
        further = now.where("up is not null").join(above, "up").select(
            "node", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), (F.col("sum") + F.col("sum2")).alias("sum"), F.col("top2").alias("top")
        )
        levels.append(stash(now.where("up is null").unionByName(further), "up"))
    # a node without a pointer has passed its root: far is its number of messages up to the root
    rooted = levels[-1].where("up is null").select("node", F.col("far").alias("length"), "sum", F.col("top").alias("root"))
    parents = levels[0].where("up is not null").select(F.col("up").alias("node")).distinct()
    leaves = rooted.join(parents, "node", "left_anti")
    by_rank = W.partitionBy("root").orderBy(F.desc("sum"), F.desc("length"), "node")
    best = leaves.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= paths_per_root)
    paths = best.select(F.col("node").alias("leaf"), "rank", "root", "node", (F.col("length") - 1).alias("depth"))
    paths = stash(paths, "paths")
    for k, level in enumerate(levels):  # adds the message 2**k steps up of each that is deep enough
        up = level.select("node", "up")
        more = paths.where(F.col("depth") >= 1 << k).join(up, "node").select("leaf", "rank", "root", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        paths = stash(paths.unionByName(more), "paths")
    return paths


def format_replies(
    messages: DataFrame, *, id_col: str = "id", parent_col: str = "parent", role_col: str = "role", text_col: str = "text",
    score_col: str | None = None, paths_per_root: int = 1,
) -> DataFrame:
    """leaf, rank, root, formatted and loss (spans of the learned texts) of the best paths of each tree."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    score = F.coalesce(F.col(f"`{score_col}`").cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    # one row for each id, chosen as a whole: parent and text of different rows don't mix
    row = F.struct(F.col(f"`{parent_col}`").alias("parent"), score.alias("score"), role.alias("role"), text.alias("text"))
    once = messages.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("node")).agg(F.min(row).alias("m"))
    once = stash(once.select("node", "m.*"), "rows")
    paths = _paths(once.select("node", "parent", "score"), paths_per_root)
    bodies = once.select("node", F.struct("role", "text").alias("turn"))
    whole = paths.join(bodies, "node").groupBy("leaf", "rank", "root").agg(F.sort_array(F.collect_list(F.struct("depth", "turn.*"))).alias("__nw_turns"))

    def start():
        def run(conversations: list[list[dict]]) -> Iterator[tuple]:
            for turns in conversations:
                text, spans = format_turns((t["role"], t["text"]) for t in turns)
                yield text, [{"start": a, "end": b} for a, b in spans]

        return run

    return annotate(whole, [F.col("__nw_turns")], FORMATTED, start, ["leaf", "rank", "root"])


def read_back(conversations: DataFrame, *, formatted_col: str = "formatted", loss_col: str = "loss", keep: list[str] | None = None) -> DataFrame:
    """conversations (columns in keep) with turns (role, text) and loss_text, read from formatted texts and their loss spans."""

    def start():
        def run(formatted: list[str | None], loss: list[list[dict] | None]) -> Iterator[tuple]:
            for text, spans in zip(formatted, loss, strict=True):
                turns = [{"role": r, "text": t} for r, t in read_turns(text or "")]
                yield turns, "".join(unescape((text or "")[s["start"] : s["end"]]) for s in spans or [])

        return run

    return annotate(conversations, [F.col(formatted_col), F.col(loss_col)], READ, start, keep)
