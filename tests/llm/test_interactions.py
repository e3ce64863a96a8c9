"""Filter interaction audit: all orders, run one after another over plain rows."""

import itertools
import random
import re

from pyspark.sql import functions as F

from noticeweave.llm.interactions import audit

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def slow(docs, labels):
    def fails(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search(r"[#$%&*|]", text))
        copy = any(t == text and i is not None and j is not None and j < i for j, t, _ in rows)
        return "".join(x for x, bad in zip("ABCDE", (*tests, copy), strict=True) if bad)

    rows = [(i, t or "", s or "") for i, t, s in docs]
    label = lambda i, k: any(x[0] == i and i is not None and x[k] == 1 for x in labels)
    marked = [(s, fails(i, t), label(i, 1), label(i, 2)) for i, t, s in rows]
    out = []
    for part in {s for s, *_ in marked}:
        own, share, steps = [m[1:] for m in marked if m[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                before, left = left, [m for m in left if f not in m[0]]
                share[f] += len(gone)
                redundant = sum(f in m[0] for m in own) - sum(f in m[0] for m in before)
                steps.append((f, (part, "".join(order), k, len(left), len(gone), redundant, sum(m[0] == f for m in own), sum(m[1] for m in gone), sum(m[2] for m in gone))))
        out += [(*s, share[f]) for f, s in steps]
    return sorted(out)


def found(spark, docs, labels):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"mask": F.lit(1), "n": F.lit("x"), "good": F.lit(0), "digest": F.lit(2)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit(df, marks, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    assert got.columns == list(COLUMNS)
    return sorted(tuple(r) for r in got.collect())


def test_like_a_loop(spark):
    draw = random.Random(11)
    word = lambda: draw.choice(["a", "b", "C", "Dd", "x#", "e|", *(f"w{i}" for i in range(90))])
    texts = [" ".join(word() for _ in range(draw.choice([0, 20, 49, 50, 51, 120]))) for _ in range(60)]
    docs = [(i, draw.choice(texts), draw.choice(["s", "t", None])) for i in range(150)]
    docs += [(None, texts[0], "s"), (None, None, "u"), (200, None, "u"), (201, "", "u"), (5, texts[0], "t"), (5, texts[0], "t"), (300, "É " * 60, "v"), (301, "long words " * 20_000, "v")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 160, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    assert found(spark, docs, labels) == slow(docs, labels)


def test_odd_tables(spark):
    assert found(spark, [], []) == []
    one = [(1, None, None)]
    assert found(spark, one, []) == slow(one, [])
    equal = [(1, "A", "s")] * 5 + [(2, "A", "s")] * 3
    assert found(spark, equal, [(2, 1, 1)]) == slow(equal, [(2, 1, 1)])
