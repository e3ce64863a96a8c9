"""Dates in texts: column builders over an ordered list of patterns. The clock is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAMES = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
# Patterns in the order in which they are tried, and what their groups are.
PATTERNS: tuple[tuple[str, str], ...] = (
    (r"^\s*(\d{1,2})\s*(20\d{2})[-/.](\d{1,2})\s*$", "d y m"),
    (r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})日?", "y m d"),
    (r"(\d{4})\.(\d{1,2})\.(\d{1,2})", "y m d"),
    (r"(\d{1,2})-(\d{1,2})\s*(\d{4})", "m d y"),
    (r"(\d{4})(\d{1,2})-(\d{1,2})", "y m d"),
    (r"(\d{1,2})(\d{1,2})月", "d m"),
    (r"(\d{1,2})月(\d{1,2})日", "m d"),
    (r"(\d{4})-(\d{1,2})(?![\d-])", "y m"),
    (r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?", "y m d"),
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "y m d"),
    (r"(\d{1,2})月\s*(\d{1,2})日?", "m d"),
    (r"(\d{4})(\d{2})(\d{2})", "y m d"),
    (rf"(?i){_NAMES}[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}})", "name d y"),
    (rf"(?i)(\d{{1,2}})\s+{_NAMES}[a-z]*\.?\s+(\d{{4}})", "d name y"),
    (r"[\[（(](\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})[\]）)]", "y m d"),
    (r"【(\d{4})[-/.]?(\d{1,2})[-/.]?(\d{1,2})】", "y m d"),
    (r"(\d{1,2})\s+(\d{4})\.(\d{1,2})(?!\d)", "d y m"),
    (r"(\d{1,2})\s+(\d{4})/(\d{1,2})(?!\d)", "d y m"),
    (r"(\d{4})\.(\d{1,2})-(\d{1,2})", "y m d"),
    (r"(\d+)\s*(分钟前|小时前|天前)", "n unit"),
)
#: Dates of events and changes, which aren't those of publication; fields of publication; what follows a date in an editorial line.
NOT_PUBLISHED = (
    r"(?i)讲座(?:时间|日期)|活动(?:时间|日期)|会议(?:时间|日期)|举行(?:时间|日期)|报名(?:时间|日期|截止)|截止(?:时间|日期)|截至|更新时间|更新日期|修改时间|"
    r"(?:event|lecture)[-_ ]?(?:date|time)|deadline|datemodified|startdate|enddate"
)
PUBLISHED = r"发布日期|发布时间|发布于|发文日期"
PUBLISH = r"^(?:发布日期|发布时间|发文日期|发布于)\s*[：:]?\s*"
COMPACT_PUBLISH = r"(?:发布日期|发布时间|发文日期|发布于)\s*[：:]?\s*(\d{4}\d{2}\d{2})(?!\d)"
EDITOR = r"责任编辑|编辑[:：]|作者[:：]|来源[:：]|浏览(?:量|次数)?[:：]"
TIME_RANGE = r"\d{1,2}[:：]\d{2}\s*[—–~～至-]+\s*\d{1,2}[:：]\d{2}"


def _at(y: Column, m: Column, d: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp(y, m, d, zero, zero, zero.cast("decimal(16,6)"))


def _assembled(groups: list[Column], kind: str, as_of: Column | None) -> Column:
    """A timestamp of a pattern's groups; null if there is no such day, or if the year can't be told without a clock."""
    named = dict(zip(kind.split(), groups, strict=True))
    number = {k: v.try_cast("int") for k, v in named.items() if k in ("y", "m", "d")}
    if "n" in named:
        if as_of is None:
            return F.lit(None).cast("timestamp")
        n = named["n"].try_cast("int")
        step = F.when(named["unit"] == "天前", F.make_dt_interval(days=n)).when(named["unit"] == "分钟前", F.make_dt_interval(mins=n)).otherwise(F.make_dt_interval(hours=n))
        return F.when(n.isNotNull() & (named["unit"] != ""), as_of - step)
    if "name" in named:
        number["m"] = F.nullif(F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(named["name"])), F.lit(0)).cast("int")
    if "y" not in number:
        if as_of is None:
            return F.lit(None).cast("timestamp")
        this = _at(F.year(as_of), number["m"], number["d"])
        return F.when(this > as_of, _at(F.year(as_of) - 1, number["m"], number["d"])).otherwise(this)
    return _at(number["y"], number["m"], number.get("d", F.lit(1)))


def parse_date(text: Column, as_of: dt.datetime | Column | None = None) -> Column:
    """The date of the first pattern, in order, whose first match is a valid one. Days without a year are the last such day up to as_of.

    The text is bound once, however it is made, and the patterns are tried one after the other on texts with digits enough for a date.
    """
    clock = F.lit(as_of) if isinstance(as_of, dt.datetime) else as_of
    usable = [(p, kind) for p, kind in PATTERNS if clock is not None or "y" in kind.split()]

    def tried(t: Column) -> Column:
        return F.coalesce(*(_assembled([F.regexp_extract(t, p, i + 1) for i in range(len(kind.split()))], kind, clock) for p, kind in usable))

    enough = r"\d{4}" if clock is None else r"\d"
    return F.get(F.transform(F.filter(F.array(F.trim(text)), lambda t: t.rlike(enough)), tried), F.lit(0))


def first_date(text: Column) -> Column:
    """The first full date of a text, as a date."""
    return F.to_date(parse_date(text))


def has_date(text: Column) -> Column:
    return parse_date(text).isNotNull()


def all_dates(text: Column, as_of: dt.datetime | Column | None = None) -> Column:
    """Every match of every pattern that is a date: reliability (3: full, 1: day without year or month without day, 2: else), at, raw; best first."""
    clock = F.lit(as_of) if isinstance(as_of, dt.datetime) else as_of
    found = F.concat(*(_every(text, p, kind, clock) for p, kind in PATTERNS))
    return F.sort_array(F.filter(found, lambda d: d["at"].isNotNull()), asc=False)


def _every(text: Column, pattern: str, kind: str, clock: Column | None) -> Column:
    n = len(kind.split())
    reliability = 1 if n == 2 else 2 if "name" in kind else 3
    # one array for each group, the whole match first
    groups = F.array(*(F.regexp_extract_all(text, F.lit(pattern), i) for i in range(n + 1)))

    def made(place: Column) -> Column:
        one = [F.get(F.get(groups, i), place) for i in range(n + 1)]
        return F.struct(F.lit(reliability).alias("reliability"), _assembled(one[1:], kind, clock).alias("at"), one[0].alias("raw"))

    places = F.filter(F.sequence(F.lit(0), F.size(F.get(groups, 0))), lambda i: i < F.size(F.get(groups, 0)))
    return F.transform(places, made)


def compact_date(text: Column) -> Column:
    """The day yyyymmdd right after the label of a field that begins with one, as a date; null without it, with several, or if there is no such day."""
    found = F.regexp_extract_all(text, F.lit(COMPACT_PUBLISH), 1)
    return F.when(text.rlike(PUBLISH) & (F.size(found) == 1), F.try_to_date(F.get(found, 0), "yyyyMMdd"))


def editorial_line(text: Column) -> Column:
    """Whether a short line begins with its only date and goes on with author, source or editor, without a word of events."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    full = r"\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?"
    one = F.size(F.regexp_extract_all(plain, F.lit(f"({full})"), 1)) == 1
    valid = first_date(F.regexp_extract(plain, full, 0)).isNotNull()
    after = F.regexp_replace(plain, f"^{full}", "")
    return (plain != "") & (F.char_length(plain) <= 220) & one & plain.rlike(f"^{full}") & ~plain.rlike(NOT_PUBLISHED) & ~plain.rlike(TIME_RANGE) & after.rlike(rf"^\s*(?:{EDITOR})") & valid


def listing_role(text: Column, marks: Column, context: Column | None = None) -> Column:
    """missing, non_publication, ambiguous, publication or listing: what a date beside a list's title stands for. marks: class names; context: the field's whole text, if it has a label."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    around = raw if context is None else F.coalesce(context, raw)
    visible = F.regexp_replace(raw, PUBLISH, "")
    full = visible.rlike(r"^\s*\d{4}[年./-]\s*\d{1,2}[月./-]\s*\d{1,2}") | visible.rlike(r"^\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4})\s*$")
    return (
        F.when(raw == "", "missing").when(F.concat_ws(" ", around, marks).rlike(NOT_PUBLISHED) | raw.rlike(TIME_RANGE), "non_publication").when(~full, "ambiguous")
        .when(around.rlike(PUBLISHED), "publication").otherwise("listing")
    )


def date_stamp(at: Column) -> Column:
    """A day as yyyy-mm-dd, a time of day with seconds after it, '' for none."""
    midnight = at == F.date_trunc("day", at)
    return F.when(at.isNull(), "").when(midnight, F.date_format(at, "yyyy-MM-dd")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))


def date_label(at: Column) -> Column:
    midnight = at == F.date_trunc("day", at)
    return F.when(at.isNull(), "发布时间未知").when(midnight, F.date_format(at, "yyyy年MM月dd日")).otherwise(F.date_format(at, "yyyy年MM月dd日 HH:mm"))


def deadline_view(quotes: Column, as_of: dt.datetime, zone: str = "Asia/Shanghai") -> Column:
    """unknown, partly, several, passed or open: what an array of quoted deadlines tells at as_of. Only full dates count; without a time a day lasts to its end."""

    def end(q: Column) -> Column:
        days = F.array_distinct(F.regexp_extract_all(q, F.lit(r"20\d{2}[年./-]\d{1,2}[月./-]\d{1,2}日?"), 0))
        day = first_date(F.get(days, 0))
        clock = F.regexp_extract(q, r"(\d{1,2}[:：时点]\d{1,2})", 1)
        hour = F.regexp_extract(q, r"(\d{1,2})[时点]", 1)
        parts = F.split(clock, "[:：时点]")
        seconds = F.when(clock != "", F.get(parts, 0).try_cast("int") * 3600 + F.get(parts, 1).try_cast("int") * 60).when(hour != "", hour.try_cast("int") * 3600).otherwise(86399)
        at = F.to_utc_timestamp(day.cast("timestamp") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), zone)
        return F.when((F.size(days) == 1) & (seconds < 86400), at)

    ends = F.filter(F.transform(quotes, end), lambda e: e.isNotNull())
    return (
        F.when(F.size(ends) == 0, "unknown").when(F.size(ends) < F.size(quotes), "partly").when(F.size(F.array_distinct(ends)) > 1, "several")
        .when(F.array_min(ends) < F.lit(as_of), "passed").otherwise("open")
    )


def newest_listed(feed: Column) -> Column:
    """The newest day of a feed's items, from its JSON: lists of samples with dates, or samples alone."""
    dates = F.regexp_extract_all(feed, F.lit(r'"date"\s*:\s*"(\d{4}-\d{2}-\d{2})'), 1)
    return F.array_max(F.filter(F.transform(dates, lambda s: F.try_to_date(s, "yyyy-MM-dd")), lambda d: d.isNotNull()))


def is_stale(feed: Column, as_of: dt.datetime, days: int = 365) -> Column:
    return F.coalesce(newest_listed(feed) < F.date_sub(F.lit(as_of.date()), days), F.lit(False))


def seconds_taken(began: Column, ended: Column) -> Column:
    """Tenths of a second, not below zero, null while open: exact, unlike rounded floats."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(ended.cast("timestamp")) - F.unix_micros(began.cast("timestamp"))) / 100_000)).cast("long")
