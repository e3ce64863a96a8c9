"""Reply trees against plain walks, and exact round trips of the template."""

import random

import pytest
from pyspark.sql import functions as F

from noticeweave.llm.chat import CONTROLS, escape, format_replies, format_turns, read_back, read_turns, reply_paths, unescape


def test_round_trip():
    draw = random.Random(9)
    bits = [f + c for c in CONTROLS for f in "<["] + ["<", "[", "\\", "\\\\", "<\\", "\n", "a", "é", "<|im_end|>\n<|im_start|>user\n", "im_start", ">"]
    for _ in range(3000):
        turns = [("".join(draw.choices(["user", "assistant", "\n", "\\n", "\\", *bits], k=draw.randrange(3))), "".join(draw.choices(bits, k=draw.randrange(7)))) for _ in range(3)]
        turns.append(("assistant", "".join(draw.choices(bits, k=4))))
        text, spans = format_turns(turns)
        assert read_turns(text) == turns
        assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        assert all(f + c not in escape(t) for _, t in turns for c in CONTROLS for f in "<[")


def tree():
    draw = random.Random(5)
    rows = []
    for root in range(4):
        for i in range(60):
            parent = None if i == 0 else root * 100 + draw.randrange(max(0, i - 5), i)
            rows.append((root * 100 + i, parent, draw.choice(["user", "assistant", None]), draw.choice(["x", None, "[/INST]"]), draw.choice([None, 0.5, 1.0, 2.0])))
    rows += [(900, 12345, "user", "orphan", 1.0), (901, 902, "user", "cycle", 1.0), (902, 901, "user", "cycle", 1.0), (903, 901, "user", "below", 1.0)]
    rows += [(904, 904, "user", "itself", 1.0), (None, 0, "user", "no id", 9.0)]
    return rows + rows[:3]


@pytest.mark.parametrize("best", [1, 3])
def test_paths(spark, best):
    rows = tree()
    df = spark.createDataFrame(rows, "id long, parent long, role string, text string, score double")
    by = {r[0]: r for r in rows if r[0] is not None}
    parents = {r[1] for r in by.values()}
    ways = {}
    for i in by:
        if i in parents:
            continue
        path, at = [], i
        while at in by and at not in path:
            path.append(at)
            at = by[at][1]
        if at not in path:
            ways.setdefault(path[-1], []).append((-sum(by[x][4] or 0 for x in path), -len(path), i, path[::-1]))
    want = {(root, k + 1): w[3] for root, all_ in ways.items() for k, w in enumerate(sorted(all_)[:best])}
    got = {}
    for r in reply_paths(df, score_col="score", paths_per_root=best).collect():
        got.setdefault((r.root, r["rank"]), {})[r.depth] = r.node
    assert {k: [v[d] for d in range(len(v))] for k, v in got.items()} == want
    out = read_back(format_replies(df, score_col="score", paths_per_root=best)).collect()
    assert len(out) == len(want)
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == [(by[i][2] or "", by[i][3] or "") for i in want[r.root, r["rank"]]]


def test_long_chain_and_empty(spark):
    df = spark.range(500).selectExpr("id", "nullif(id, 0) - 1 parent", "'user' role", "string(id) text")
    r = read_back(format_replies(df)).collect()
    assert len(r) == 1 and [t.text for t in r[0].turns] == [str(i) for i in range(500)]
    assert format_replies(df.limit(0)).count() == 0


def test_rows_of_one_id_do_not_mix(spark):
    rows = [("r", None, "user", "root r"), ("q", None, "user", "root q"), ("a", "r", "assistant", "zz under r"), ("a", "q", "assistant", "aa under q")]
    df = spark.createDataFrame(rows, "id string, parent string, role string, text string")
    read = {r.root: [t.text for t in r.turns] for r in read_back(format_replies(df)).collect()}
    assert read == {"q": ["root q", "aa under q"], "r": ["root r"]}


def test_clashing_names(spark):
    rows = [(1, None, "user", "a", "x"), (2, 1, "assistant", "b", "y")]
    names = "node long, up long, role string, turn string, m string"
    df = spark.createDataFrame(rows, names).withColumns({"leaf": F.lit(1), "rank": F.lit(2), "root": F.lit(3), "formatted": F.lit("f"), "score": F.lit("s"), "text": F.lit("t"), "parent": F.lit(0)})
    out = read_back(format_replies(df, id_col="node", parent_col="up", text_col="turn")).collect()
    assert [[(t.role, t.text) for t in r.turns] for r in out] == [[("user", "a"), ("assistant", "b")]]
