"""Tasks, ledgers and clocks: the state of a queue at a time, from events and rows, without leases."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noticeweave.operators.graphs import _kept

#: States of collections that aren't complete.
INCOMPLETE = ("repairing", "discovering", "needs_check", "retry_wait")


def latest_state(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The newest event of each key, and how many there were."""
    others = [c for c in events.columns if c not in (key, at, tie)]
    newest = events.groupBy(key).agg(F.max(F.struct(at, tie, *others)).alias("e"), F.count(F.lit(1)).alias("generation"))
    return newest.select(key, "e.*", "generation")


def claim_rank(as_of: dt.datetime, kinds: Iterable[str], minutes: int = 5) -> Column:
    """-3 to 2: bodies first, then first turns of onboarding, then what waits for minutes, then known kinds."""
    onboarding = ((F.col("kind") == "collect") & (F.col("phase") == "onboarding_collection")) | (F.col("kind").isin("onboard", "navigation_review") & (F.col("claim_count") == 0))
    return (
        F.when(F.col("kind") == "content", -3).when(onboarding, -2).when(F.col("queued_at") <= F.lit(as_of - dt.timedelta(minutes=minutes)), -1)
        .when(F.col("kind").isin(*kinds), 1).otherwise(2)
    )


def claim_window(tasks: DataFrame, as_of: dt.datetime, kinds: Iterable[str], most: int = 16) -> DataFrame:
    """The tasks that are claimed next, at most so many: pending and available ones, and running ones whose lease is over."""
    open_ = ((F.col("state") == "pending") & (F.col("available_at") <= F.lit(as_of))) | ((F.col("state") == "running") & (F.col("lease_until") <= F.lit(as_of)))
    ranked = tasks.where(open_).withColumn("rank", claim_rank(as_of, kinds))
    return ranked.orderBy("rank", "claim_count", "queued_at", "available_at", "id").limit(most)


def positions(tasks: DataFrame, order: list[Column], key: str) -> DataFrame:
    """For every task how many stand before it in order, by a range partition and prefix counts: nothing is compared with everything."""
    ranged = tasks.select(key, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("o")).repartitionByRange("o")
    ordered = _kept(ranged.withColumn("part", F.spark_partition_id()))  # ranges are drawn from a sample: drawn twice they might differ
    # one count for each partition: as many rows as partitions
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("o")) - 1
    return ordered.join(F.broadcast(before), "part").select(key, (F.col("base") + inside).alias("ahead"))


def interrupted(logs: DataFrame, tasks: DataFrame, as_of: dt.datetime) -> DataFrame:
    """logs with state and finished_at: running ones whose task isn't running in the same generation under a live lease are interrupted."""
    live = tasks.where((F.col("state") == "running") & (F.col("lease_until") > F.lit(as_of))).select(F.col("id").alias("task_id"), F.col("generation").alias("task_generation"), F.lit(True).alias("live"))
    joined = logs.join(live, ["task_id", "task_generation"], "left")
    lost = (F.col("state") == "running") & F.col("live").isNull()
    return joined.withColumns({"state": F.when(lost, "interrupted").otherwise(F.col("state")), "finished_at": F.when(lost, F.coalesce("finished_at", F.lit(as_of))).otherwise(F.col("finished_at"))}).drop("live")


def due(wanted: DataFrame, tasks: DataFrame, key: str, as_of: dt.datetime, seconds: int) -> DataFrame:
    """key and why a scheduled task is due: missing, or finished seconds ago or more. Tasks at work aren't."""
    known = tasks.select(key, "state", "finished_at", F.lit(True).alias("known"))
    old = F.col("state").isin("done", "failed") & (F.col("finished_at") <= F.lit(as_of - dt.timedelta(seconds=seconds)))
    return wanted.join(known, key, "left").select(key, F.when(F.col("known").isNull(), "missing").when(old, "elapsed").alias("reason")).where("reason is not null")


def balances(entries: DataFrame, key: str) -> DataFrame:
    """used, reserved and requests of each budget after all entries (kind reserve, settle or release; reserved; tokens: null if unknown).

    A reservation is held until it is settled or released; a settlement of unknown usage keeps it.
    """
    kept = (F.col("kind") == "settle") & F.col("tokens").isNull()
    held = F.when(F.col("kind") == "reserve", F.col("reserved")).when(kept, F.lit(0)).otherwise(-F.col("reserved"))
    used = F.when((F.col("kind") == "settle") & F.col("tokens").isNotNull(), F.col("tokens")).otherwise(0)
    return entries.groupBy(key).agg(F.sum(used).alias("used"), F.sum(held).alias("reserved"), F.count_if(F.col("kind") == "reserve").alias("requests"))


def recovered(executions: DataFrame, as_of: dt.datetime, seconds: int = 180) -> DataFrame:
    """executions whose heartbeat is old: sent ones become uncertain and keep what they reserved, others fail and release it."""
    old = F.col("status").isin("reserved", "sending") & (F.coalesce("heartbeat_at", "created_at") < F.lit(as_of - dt.timedelta(seconds=seconds)))
    status = F.when(old & F.col("request_sent"), "uncertain").when(old, "failed").otherwise(F.col("status"))
    return executions.withColumns({"status": status, "reserved_tokens": F.when(old & ~F.col("request_sent"), F.lit(0)).otherwise(F.col("reserved_tokens"))})


def display_state(state: Column, skipped: Column, outcome: Column, partial: Column) -> Column:
    """What readers see of a collection: its own state until it is done, then its outcome."""
    return (
        F.when(state != "done", state).when(F.coalesce(skipped, F.lit(False)), "skipped").when(outcome == "waiting", "retry_wait").when(outcome.isin(*INCOMPLETE), outcome)
        .when(F.coalesce(partial, F.lit(False)), "partial").otherwise("done")
    )


def progress_clock(decisions: DataFrame, key: str, order: str, decision: str, result: str, interval: int, misses: int) -> DataFrame:
    """key, decisions, seen and stopped: every interval decisions a branch is checked; after so many checks in a row without a new result it stops.

    decisions: a row for each result (or null) of a decision, in order; a decision that comes again counts once.
    """
    first = decisions.groupBy(key, decision).agg(F.min(order).alias("o"))
    numbered = first.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("o", decision)))
    fresh = decisions.where(F.col(result).isNotNull()).join(numbered, [key, decision]).groupBy(key, result).agg(F.min("n").alias("n"))
    new = fresh.groupBy(key, "n").agg(F.count(F.lit(1)).alias("new"))
    along = W.partitionBy(key).orderBy("n")
    counted = numbered.join(new, [key, "n"], "left").withColumn("seen", F.sum(F.coalesce("new", F.lit(0))).over(along))
    checks = counted.where(F.col("n") % interval == 0).withColumn("last", F.coalesce(F.lag("seen").over(along), F.lit(0)))
    run = checks.withColumn("up", (F.col("seen") > F.col("last")).cast("int")).withColumn("group", F.sum("up").over(along))
    idle = run.withColumn("idle", F.sum(1 - F.col("up")).over(W.partitionBy(key, "group").orderBy("n")))
    stop = idle.where(F.col("idle") >= misses).groupBy(key).agg(F.min("n").alias("stop"))
    kept = counted.join(stop, key, "left").where(F.col("stop").isNull() | (F.col("n") <= F.col("stop")))
    return kept.groupBy(key).agg(F.max("n").alias("decisions"), F.max("seen").alias("seen"), F.max("stop").isNotNull().alias("stopped"))


def route_turn(turn: int, every: int, rotate: int) -> str:
    """Which order the turn-th claim takes: oldest on every every-th, the branch with least attempts on every rotate-th, else the rank."""
    return "oldest" if every and turn % every == 0 else "branch" if rotate and turn % rotate == 0 else "rank"


def choose_route(pages: DataFrame, turn: int, every: int = 4, rotate: int = 3) -> DataFrame:
    """The page that the turn-th claim takes: one row. pages: url, branch, kind, lane, priority, depth, attempts, queued_at."""
    rank = F.struct("lane", "priority", "depth", "url")
    kind = route_turn(turn, every, rotate)
    if kind == "oldest":
        order = F.struct(F.col("kind") != "root", "queued_at", "url")
    elif kind == "branch":
        tried = pages.groupBy("branch").agg(F.sum("attempts").alias("tried"))
        pages = pages.join(tried, "branch")
        order = F.struct(F.col("kind") != "root", "tried", "branch", rank)
    else:
        order = F.struct(F.col("kind") != "root", rank)
    return pages.agg(F.min(F.struct(order.alias("o"), "url", "branch")).alias("m")).select("m.url", "m.branch").where("url is not null")


def lane(kind: Column, label: Column, student: Column, listed: Column, stale_parent: Column) -> Column:
    """0 to 5: root, channel, gateway, students' pages, directory, others; pages that a parent lists or whose parent is stale come earlier."""
    base = F.when(kind == "root", 0).when(kind == "channel", 1).when(kind == "gateway", 2).when(kind == "directory", 4).otherwise(5)
    near = F.when(~kind.isin("root", "channel", "gateway") & student.isin(2, 3, 4), 3).when((kind == "navigation") & label.rlike("(?i)notice|news|通知|公告|新闻"), 3).otherwise(5)
    return F.least(base, near, F.when(listed, 1).otherwise(5), F.when(stale_parent & kind.isin("navigation", "gateway"), 2).otherwise(5))


def foraging_order(credit: Column, reads: Column, prior: int = 2, weight: int = 1) -> Column:
    """(prior + weight for credit) / (prior + reads), as a decimal that keeps order: the greatest comes first."""
    return ((F.lit(prior) + F.when(credit, weight).otherwise(0)).cast("decimal(18,0)") / (F.lit(prior) + reads).cast("decimal(18,0)")).cast("decimal(38,18)")


def overlap_weight(shared: Column, profiles: Column) -> Column:
    """1 and up to a quarter more for a need that several of a reader's profiles share, in thousandths."""
    return (1000 + F.floor(250 * F.greatest(F.lit(0), shared - 1) / F.greatest(F.lit(1), profiles - 1))).cast("long")
