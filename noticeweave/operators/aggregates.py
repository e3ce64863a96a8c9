"""Counts, rates and ledgers: one pass each, with partial aggregation before any shuffle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_source(members: DataFrame) -> DataFrame:
    return members.groupBy("department_id").agg(F.count(F.lit(1)).alias("n"))


def per_school(members: DataFrame, departments: DataFrame) -> DataFrame:
    """Notices of each school, each once."""
    owned = departments.select(F.col("id").alias("department_id"), "school_id")
    return members.join(owned, "department_id").select("notice_id", "school_id").distinct().groupBy("school_id").agg(F.count(F.lit(1)).alias("n"))


def channel_stats(members: DataFrame, notices: DataFrame, reads: DataFrame) -> DataFrame:
    """department_id, n, n_read, newest publication."""
    seen = reads.groupBy("notice_id").agg(F.count(F.lit(1)).alias("readers"))
    dated = notices.select(F.col("id").alias("notice_id"), "published_at")
    rows = members.join(dated, "notice_id").join(seen, "notice_id", "left")
    return rows.groupBy("department_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("readers") > 0).alias("n_read"), F.max("published_at").alias("newest")
    )


def permille(part: Column, whole: Column) -> Column:
    """part of whole in thousandths, rounded down; null of nothing. Exact, unlike rounded floats."""
    return F.when(whole > 0, F.floor(part * 1000 / whole)).cast("long")


def outcomes(logs: DataFrame, state: str, good: str, bad: str, new: str, at: str, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """n, n_good, n_bad, success (ten-thousandths of those that ended, null without any) and new of the last days."""
    recent = logs.where((F.col(at) > F.lit(as_of - dt.timedelta(days=days))) & (F.col(at) <= F.lit(as_of)))
    counts = recent.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(state) == good).alias("n_good"), F.count_if(F.col(state) == bad).alias("n_bad"), F.coalesce(F.sum(new), F.lit(0)).alias("new"))
    ended = F.col("n_good") + F.col("n_bad")
    return counts.withColumn("success", F.when(ended > 0, F.floor(F.col("n_good") * 10_000 / ended)).cast("long"))


def queue_metrics(tasks: DataFrame, as_of: dt.datetime) -> DataFrame:
    """state, capability, n, and for pending ones the seconds that the oldest waits."""
    age = F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp(F.min("queued_at"))
    found = tasks.groupBy("state", "capability").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(0), age).cast("long").alias("oldest_s"))
    return found.withColumn("oldest_s", F.when(F.col("state") == "pending", F.col("oldest_s")))


def queue_ahead(tasks: DataFrame, order: list[Column], row: DataFrame) -> DataFrame:
    """How many tasks are strictly before those in row (id, one or few), by a tuple of columns."""
    mine = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("mine")
    few = F.broadcast(row.select(F.col("id").alias("task_id"), mine))
    rank = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    return tasks.withColumn("rank", rank).join(few, F.col("rank") < F.col("mine")).groupBy("task_id").agg(F.count(F.lit(1)).alias("ahead"))


def storage_usage(notices: DataFrame, kept: DataFrame, kind: Column) -> DataFrame:
    """n and bytes of pinned and of other notices by kind, missing sizes as none."""
    marked = notices.join(kept.select(F.col("notice_id").alias("id"), F.lit(True).alias("kept")), "id", "left")
    return marked.groupBy(kind.alias("kind"), F.coalesce("kept", F.lit(False)).alias("pinned")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("content_bytes"), F.lit(0)).alias("bytes")
    )


def usage_row(calls: DataFrame) -> DataFrame:
    """Dispatched calls with what is known of their usage: a flagged total that isn't negative; input and output if they fit into it; cache
    figures if hits and misses make up the input; a status bucket. Unknown usage isn't zero and is counted apart.

    calls: request_sent, status, known, total_tokens, input_tokens, output_tokens, cache_hit_tokens, cache_miss_tokens, invalid, skill, purpose.
    """
    sent = calls.where("request_sent")
    known = F.coalesce(F.col("known") & (F.col("total_tokens") >= 0), F.lit(False))
    inp, out = (F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in ("input_tokens", "output_tokens"))
    fits = known & (inp + out <= F.col("total_tokens"))
    read = F.when(fits, inp).otherwise(0)
    hit, miss = F.col("cache_hit_tokens"), F.col("cache_miss_tokens")
    cached = F.coalesce(known & (hit >= 0) & (miss >= 0) & (hit + miss == read), F.lit(False))
    status = F.when(F.col("status") == "sending", "pending").when(F.col("status").isin("succeeded", "partial", "failed"), F.col("status")).otherwise("uncertain")
    purpose = F.when(F.col("skill") == "connection-test", "test").when(F.col("purpose").isin("directory", "summary", "test"), F.col("purpose")).otherwise("other")
    return sent.withColumns({
        "tokens": F.when(known, F.col("total_tokens")).otherwise(0), "read": read, "written": F.when(fits, out).otherwise(0), "unknown": ~known & (F.col("status") != "sending"),
        "hits": F.when(cached, hit), "misses": F.when(cached, miss), "bucket": status, "failure": F.when(F.col("status") == "failed", F.when(F.col("invalid"), "validation").otherwise("other")), "purpose": purpose,
    })


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Totals over all, by model, by purpose and by both, in one pass; rates in thousandths of finished calls and of reported input."""
    done = F.count_if(F.col("bucket").isin("succeeded", "failed", "partial"))
    return usage.cube("model", "purpose").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("calls"),
        F.count_if("unknown").alias("unknown"),
        F.sum("tokens").alias("tokens"),
        (F.sum("tokens") - F.sum("read") - F.sum("written")).alias("unclassified"),
        *(F.count_if(F.col("bucket") == b).alias(b) for b in ("succeeded", "partial", "failed", "pending", "uncertain")),
        F.count_if(F.col("failure") == "validation").alias("invalid"),
        permille(F.count_if(F.col("bucket") == "succeeded"), done).alias("success"),
        permille(F.sum("hits"), F.sum("hits") + F.sum("misses")).alias("cache_hits"),
    )


def usage_ranges(usage: DataFrame, last: dt.date, days: int, offset_minutes: int = 0) -> DataFrame:
    """calls, tokens and first day of the last days and of all time, in one pass."""
    day = F.to_date(F.col("at") + F.make_dt_interval(mins=F.lit(offset_minutes)))
    inside = day > F.date_sub(F.lit(last), days)
    return usage.agg(
        F.count_if(inside).alias("calls"), F.coalesce(F.sum(F.when(inside, F.col("tokens"))), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("all_calls"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"), F.min(day).alias("since"),
    )


def cost_buckets(costs: DataFrame, key: str) -> DataFrame:
    """Executions of each scope (null: of none), each once: requests that were sent, confirmed, reconciled, unknown and reserved, with their tokens."""
    columns = [c for c in costs.columns if c != "execution_id"]
    once = costs.groupBy("execution_id").agg(F.min(F.struct(*columns)).alias("c")).select("c.*")
    known = F.coalesce(F.col("request_sent") & F.col("known") & (F.col("total_tokens") >= 0), F.lit(False))
    by_hand = F.coalesce(F.col("source") == "administrator_reconciliation", F.lit(False))
    return once.groupBy(key).agg(
        F.count(F.lit(1)).alias("executions"), F.count_if("request_sent").alias("sent"), F.count_if(known & ~by_hand).alias("confirmed"), F.count_if(known & by_hand).alias("reconciled"),
        F.count_if(F.col("request_sent") & ~known).alias("unknown"), F.count_if(~F.col("request_sent") & F.col("status").isin("reserved", "sending")).alias("reserved"),
        F.coalesce(F.sum(F.when(known, F.col("total_tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.greatest("reserved_tokens", F.lit(0))), F.lit(0)).alias("reserved_tokens"),
    )


def calendar(usage: DataFrame, last: dt.date, days: int, offset_minutes: int = 0) -> DataFrame:
    """day and tokens for each of the last days in the viewer's time, days without calls included."""
    local = F.to_date(F.col("at") + F.make_dt_interval(mins=F.lit(offset_minutes)))
    sums = usage.groupBy(local.alias("day")).agg(F.sum("tokens").alias("tokens"))
    all_days = usage.sparkSession.range(days).select(F.date_sub(F.lit(last), F.col("id").cast("int")).alias("day"))
    return all_days.join(sums, "day", "left").select("day", F.coalesce("tokens", F.lit(0)).alias("tokens"))


def peak(days: DataFrame) -> DataFrame:
    """The first day with most tokens."""
    return days.agg(F.max(F.struct("tokens", F.date_diff(F.lit("9999-01-01"), "day").alias("early"), "day")).alias("p")).select("p.day", "p.tokens")


def attributed(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens by page or branch; rows without one are gathered under null, each execution once."""
    once = costs.groupBy("execution_id").agg(F.min(F.struct(*keys, "tokens")).alias("c")).select("c.*")
    return once.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


def comparable(costs: DataFrame, key: str) -> DataFrame:
    """Whether all of a scope's costs are known."""
    return costs.groupBy(key).agg(F.bool_and("known").alias("comparable"))


def state_counts(rows: DataFrame, key: str, state: str, states: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(*(F.count_if(F.col(state) == s).alias(s) for s in states))


def all_edges(edges: DataFrame, target: str, condition: Column) -> DataFrame:
    """Targets for which all edges meet the condition."""
    return edges.groupBy(target).agg(F.bool_and(condition).alias("all")).where("all").select(target)


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(at).alias(at))


def selector_knowledge(rows: DataFrame, domain: str, selector: str, school: str, confidence: str) -> DataFrame:
    """By domain and selector: uses, schools, mean confidence in thousandths, and whether it is promoted."""
    found = rows.groupBy(domain, selector).agg(
        F.count(F.lit(1)).alias("uses"), F.countDistinct(school).alias("schools"), F.floor(F.avg(F.col(confidence).cast("decimal(18,4)")) * 1000).cast("long").alias("confidence")
    )
    return found.withColumn("promoted", F.col("schools") >= 2)


def coverage(probes: DataFrame, scope: str, category: str, identity: str, valid: Column) -> DataFrame:
    return probes.groupBy(scope, category).agg(F.count(F.lit(1)).alias("probes"), F.countDistinct(F.when(valid, F.col(identity))).alias("validated"))


def precedence(rows: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    """The strongest of a key's labels; order begins with the strongest, labels not in it are ''."""
    rank = F.coalesce(*(F.when(F.col(label) == x, len(order) - i) for i, x in enumerate(order)), F.lit(0))
    names = F.array(F.lit(""), *(F.lit(x) for x in reversed(order)))
    return rows.groupBy(key).agg(F.max(rank).alias("r")).select(key, F.element_at(names, F.col("r") + 1).alias(label))


def per_school_read(members: DataFrame, departments: DataFrame, reads: DataFrame) -> DataFrame:
    """school_id and how many pairs of reader and notice have been read, a notice once for each school."""
    owned = departments.select(F.col("id").alias("department_id"), "school_id")
    placed = members.join(owned, "department_id").select("notice_id", "school_id").distinct()
    return reads.select("user_id", "notice_id").distinct().join(placed, "notice_id").groupBy("school_id").agg(F.count(F.lit(1)).alias("n_read"))


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def baseline_metrics(entries: DataFrame, category: str, matched: Column) -> DataFrame:
    """By category: total, matched and permille; the threshold of acceptance is a caller's."""
    found = entries.groupBy(category).agg(F.count(F.lit(1)).alias("total"), F.count_if(matched).alias("matched"))
    return found.withColumn("share", permille(F.col("matched"), F.col("total")))


def refresh_totals(sources: DataFrame, key: str | None = None) -> DataFrame:
    """Active, failed, done and incomplete sources, how many are over, and new notices: over all or by key."""
    over = F.col("state").isin("done", "failed", "partial", "skipped")
    rows = sources.groupBy(key) if key else sources.groupBy()
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state").isin("pending", "running")).alias("active"), F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state").isin("partial", "skipped", "retry_wait")).alias("incomplete"), F.count_if(over).alias("processed"),
        F.coalesce(F.sum("new_count"), F.lit(0)).alias("new"),
    )


def scope_summary(scoped: DataFrame, configured: Column, batch: Column) -> DataFrame:
    """By school: sources in scope, configured ones, and those of this batch."""
    return scoped.groupBy("school_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(configured).alias("configured"), F.count_if(configured & batch).alias("batch"))


def foraging_counts(material: DataFrame, receipts: DataFrame, entries: DataFrame, scope: str) -> DataFrame:
    """By scope: different materials, sources and entries."""
    parts = [material.select(scope, F.lit("m").alias("kind"), F.col("url").cast("string").alias("x")), receipts.select(scope, F.lit("s").alias("kind"), F.col("source").cast("string").alias("x")), entries.select(scope, F.lit("e").alias("kind"), F.col("target").cast("string").alias("x"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return every.groupBy(scope).agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("m", "materials"), ("s", "sources"), ("e", "entries"))))


def verified_columns(departments: DataFrame, versions: DataFrame) -> DataFrame:
    """school_id and its departments that have a version of a configuration."""
    return departments.join(versions.select(F.col("department_id").alias("id")), "id", "left_semi").groupBy("school_id").agg(F.countDistinct("id").alias("n"))


def interest_weights(needs: DataFrame, categories: list[str]) -> DataFrame:
    """category, contributors and mean weight (in thousandths, 1000 without any): the mean over those readers that have the need."""
    means = needs.groupBy("category").agg(F.countDistinct("user_id").alias("contributors"), F.floor(F.avg(F.col("weight").cast("decimal(18,3)"))).cast("long").alias("weight"))
    all_ = needs.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return all_.join(means, "category", "left").select("category", F.coalesce("contributors", F.lit(0)).alias("contributors"), F.coalesce("weight", F.lit(1000)).alias("weight"))


def sample_summary(samples: DataFrame, key: str, matches: int = 2, target: int = 5) -> DataFrame:
    """By source: matched, required, passed, limited and failure of its sampled articles.

    samples: key, matched, kind (of a failure: rule_error, material_incomplete, access_restricted, title_abbreviated), conflict, available.
    """
    failed = ~F.col("matched")
    found = samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max("available").alias("available"), F.count_if("matched").alias("matched"), F.count_if(failed).alias("failed"),
        F.count_if(failed & ~F.col("kind").isin("access_restricted", "title_abbreviated")).alias("blockers"), F.count_if(failed & (F.col("kind") == "access_restricted")).alias("gated"),
        F.count_if("conflict").alias("conflicts"), F.max(F.when(failed, F.when(F.col("kind") == "rule_error", 3).when(F.col("kind") == "access_restricted", 1).otherwise(2)).otherwise(0)).alias("worst"),
    )
    required = F.when(F.col("available") == 1, 1).otherwise(max(2, matches))
    public = (F.col("matched") > 0) & (F.col("failed") > 0) & (F.col("gated") == F.col("failed")) & (F.col("n") >= F.least("available", F.lit(target)))
    passed = (F.col("blockers") == 0) & (F.col("conflicts") == 0) & ((F.col("matched") >= required) | public)
    limited = (F.col("matched") > 0) & ((F.col("available") == 1) | (F.col("failed") > 0))
    names = F.array(*map(F.lit, ("", "access_restricted", "material_incomplete", "rule_error")))
    return found.select(key, "matched", required.cast("long").alias("required"), passed.alias("passed"), limited.alias("limited"), F.when(passed, "").otherwise(F.element_at(names, F.col("worst") + 1)).alias("failure"))


def work_coverage(work: DataFrame, key: str, gaps: DataFrame) -> DataFrame:
    """By school: work by state, gaps by type, and whether all is done without a gap."""
    states = work.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"))
    lost = gaps.groupBy(key).agg(F.count(F.lit(1)).alias("gaps"), F.array_join(F.array_sort(F.collect_set("gap")), ",").alias("kinds"))
    joined = states.join(lost, key, "full_outer")
    total, done, missing = (F.coalesce(c, F.lit(0)) for c in ("total", "done", "gaps"))
    return joined.select(key, total.alias("total"), done.alias("done"), F.coalesce("failed", F.lit(0)).alias("failed"), missing.alias("gaps"), F.coalesce("kinds", F.lit("")).alias("kinds"), ((total > 0) & (total == done) & (missing == 0)).alias("complete"))


def change_counts(pages: DataFrame, run: Column) -> DataFrame:
    """New, changed and unchanged pages of this run among the fetched ones."""
    mine = (F.col("state") == "fetched") & run
    return pages.agg(*(F.count_if(mine & (F.col("change") == c)).alias(c) for c in ("new", "changed", "unchanged")))


def combined(segments: DataFrame, key: str) -> DataFrame:
    """One assessment of each document from those of its segments, and how many different facts they quote.

    mixed beats relevant, potential and low; low with a better one is mixed; all low is low, else unknown. high beats possible; all low is low. segments: key, value, historical, facts
    (array of kind, quote).
    """
    has = {v: F.bool_or(F.col("value") == v) for v in ("mixed", "relevant", "potential", "low")}
    all_low, all_past = F.bool_and(F.col("value") == "low"), F.bool_and(F.col("historical") == "low")
    value = F.when(has["mixed"] | (has["low"] & (has["relevant"] | has["potential"])), "mixed").when(has["relevant"], "relevant").when(has["potential"], "potential").when(all_low, "low").otherwise("unknown")
    past = F.when(F.bool_or(F.col("historical") == "high"), "high").when(F.bool_or(F.col("historical") == "possible"), "possible").when(all_past, "low").otherwise("unknown")
    facts = F.size(F.array_distinct(F.flatten(F.collect_list("facts"))))
    return segments.groupBy(key).agg(value.alias("value"), past.alias("historical"), facts.alias("facts"))


def date_selectors(items: DataFrame, key: str, selector: str, dated: Column, first: int = 5, most: int = 2) -> DataFrame:
    """The selectors that carry dates in most of each list's first items, with their votes. items: key, nth, selector."""
    from noticeweave.operators.ranking import best

    votes = items.where((F.col("nth") <= first) & dated).groupBy(key, selector).agg(F.countDistinct("nth").alias("votes"))
    return best(votes, [key], [F.desc("votes"), F.col(selector)], most)
