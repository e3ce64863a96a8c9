"""Scopes of readers against loops over all pairs: several schools, repeated rows and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from noticeweave.operators import scope

DRAW = random.Random(7)
MEMBERS = [(n, DRAW.randrange(12)) for n in [*range(60), None] for _ in range(2)]
DEPARTMENTS = [(d, d % 5) for d in range(10)]
SUBSCRIPTIONS = [(DRAW.choice([*range(14), None]), DRAW.choice([*range(5), None])) for _ in range(26)]
READS = [(DRAW.choice([*range(16), None]), DRAW.choice([*range(60), None])) for _ in range(400)]


@pytest.fixture(scope="module")
def tables(spark):
    kinds = ("notice_id long, department_id long", "id long, school_id long", "user_id long, school_id long", "user_id long, notice_id long")
    return [spark.createDataFrame(r, k) for r, k in zip((MEMBERS, DEPARTMENTS, SUBSCRIPTIONS, READS), kinds, strict=True)]


def pairs() -> set:
    held = {(n, dict(DEPARTMENTS)[d]) for n, d in MEMBERS if d in dict(DEPARTMENTS)}
    return {(u, n) for u, s in SUBSCRIPTIONS for n, t in held if s is not None and s == t}


def test_pairs_sizes_and_lookups(tables):
    *scoped, reads = tables
    assert sorted(map(str, map(tuple, scope.subscribed_pairs(*scoped).collect()))) == sorted(map(str, pairs()))
    sizes = {r.user_id: r.n for r in scope.scope_sizes(*scoped).collect()}
    assert sizes == {u: sum(p[0] == u for p in pairs()) for u, _ in pairs()}
    assert sorted(map(str, map(tuple, scope.in_scope(reads, *scoped).collect()))) == sorted(map(str, pairs() & set(READS)))


@pytest.mark.parametrize("size", [1, 3, 50])
def test_first_unread(tables, size):
    *scoped, reads = tables
    found = tables[0].select("notice_id").distinct().withColumn("kind", F.col("notice_id") % 3).where("kind < 2 or notice_id is null")
    rows = scope.first_unread(found, *scoped, reads, [F.desc_nulls_last("kind"), F.asc_nulls_last("notice_id")], size).collect()
    got = sorted((str(r.user_id), r.place, r.notice_id) for r in rows)
    seen, want = {(u, n) for u, n in READS if u is not None and n is not None}, []
    for user in {u for u, _ in pairs()}:
        left = sorted((n for u, n in pairs() - seen if u == user and (n is None or n % 3 < 2)), key=lambda n: (n is None, -((n or 0) % 3), n or 0))
        want += [(str(user), i, n) for i, n in enumerate(left[:size], 1)]
    assert got == sorted(want, key=lambda w: w[:2])


def test_equal_subscriptions_are_expanded_once(spark):
    kinds = "user_id long, school_id long, department_ids array<long>"
    rows = [(1, 0, None), (1, 0, [5]), (2, 0, None), (3, 1, [1]), (3, 0, [5]), (4, 1, []), (5, 0, [1]), (6, None, None), (7, 1, [1]), (7, 1, [1])]
    departments = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (5, 0), (6, 0)], "id long, school_id long")
    directory = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (2, 6)], "parent long, child long")
    got = scope.expanded_subscriptions(spark.createDataFrame(rows, kinds), departments, directory).collect()
    all_of = {(u, d) for u in (1, 2) for d in (3, 5, 6)}
    assert sorted(map(tuple, got)) == sorted(all_of | {(3, 1), (3, 2), (3, 5), (3, 6), (5, 3), (5, 6), (7, 1), (7, 2)})
