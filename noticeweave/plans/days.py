"""Queries of dates in texts: the texts are made from known days, so that SQL has the days themselves."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeweave.functions import dates
from noticeweave.plans.domain import Domain
from noticeweave.plans.registry import query

AS_OF = dt.datetime(1998, 8, 2, 10, 30)
#: Spark's formats of a day in a text, in the order of the kinds that a query takes in turn.
FORMATS = (
    "'on' yyyy-MM-dd 'there'", "yyyy/M/d", "yyyy年M月d日", "yyyy.MM.dd", "dd yyyy-MM", "MM-dd yyyy", "yyyyMM-dd", "yyyyMMdd", "MMM d, yyyy", "d MMMM yyyy", "(yyyyMMdd)", "【yyyy.MM.dd】", "d  yyyy.MM 'x'", "yyyy.MM-dd",
)


def _texts(d: Domain) -> DataFrame:
    o, at = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.lit("no date, 13-45 or 2024-19-77")
    for i, form in enumerate(FORMATS):
        # the form of two lines is for years of this century
        text = F.when(o % 20 == i, F.date_format(at + F.expr("interval 10 years") if form == "dd yyyy-MM" else at, form)).otherwise(text)
    text = F.when(o % 20 == 14, F.date_format(at, "M月d日")).when(o % 20 == 15, F.date_format(at, "yyyy-MM")).when(o % 20 == 16, F.concat(o % 50, F.lit(" 天前"))).when(o % 20 == 17, F.concat(o % 50, F.lit("小时前"))).otherwise(text)
    return d.table("orders").select("o_orderkey", text.alias("t"), "o_orderdate")


@query(
    """select o_orderkey, case when k = 4 then (o_orderdate::date + interval 10 year)::timestamp when k < 14 then o_orderdate::date::timestamp when k = 14 and month(o_orderdate) = 11 then timestamp '1998-01-01' when k = 14 and month(o_orderdate) = 12 then timestamp '1998-02-01' when k = 14 then case when strftime(o_orderdate, '%m-%d') = '02-29' then null when strftime(o_orderdate, '%m-%d') > '08-02'
    then ('1997-' || strftime(o_orderdate, '%m-%d'))::timestamp else ('1998-' || strftime(o_orderdate, '%m-%d'))::timestamp end
    when k = 15 then date_trunc('month', o_orderdate)::timestamp when k = 16 then timestamp '1998-08-02 10:30:00' - to_days((o_orderkey % 50)::int) when k = 17 then timestamp '1998-08-02 10:30:00' - to_hours((o_orderkey % 50)::int) end as "at"
  from (select *, o_orderkey % 20 k from orders)""",
    domain=False,
)
def parsed_dates(d: Domain) -> DataFrame:
    return _texts(d).select("o_orderkey", dates.parse_date(F.col("t"), AS_OF).alias("at"))


@query("select o_orderkey, 3 n_days, strftime(o_orderdate, '%Y-%m-%d') best from orders where o_orderdate > timestamp '1992-01-05'", domain=False)
def extracted_dates(d: Domain) -> DataFrame:
    text = F.concat(F.lit("x "), F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit(" and 1991/1/2 or 45月99日 and Jan 3, 1992"))
    rows = d.table("orders").where("o_orderdate > timestamp '1992-01-05'").select("o_orderkey", dates.all_dates(text).alias("f"))
    # a day with signs is found by two patterns of full dates; the month's name counts as less sure
    return rows.select("o_orderkey", F.size(F.array_distinct(F.transform("f", lambda x: F.to_date(x["at"])))).alias("n_days"), F.date_format(F.col("f")[0]["at"], "yyyy-MM-dd").alias("best"))


@query(
    """select o_orderkey, case when o_orderkey % 5 in (0, 2) then try_cast('20' || strftime(o_orderdate, '%m-%m-%d') as date) end compact, o_orderkey % 3 = 0 editorial,
  case o_orderkey % 6 when 0 then 'missing' when 1 then 'non_publication' when 2 then 'ambiguous' when 3 then 'publication' when 4 then 'listing' else 'non_publication' end as "role" from orders""",
    domain=False,
)
def date_fields(d: Domain) -> DataFrame:
    o, day = F.col("o_orderkey"), F.date_format("o_orderdate", "'20'MMMMdd".replace("MMMM", "MM'x'MM"))
    day = F.replace(day, F.lit("x"))
    # numbers that are no days of publication: of a document, after the label's own day, and after another day
    field = F.when(o % 5 == 0, F.concat(F.lit("发布时间："), day)).when(o % 5 == 1, F.concat(F.lit("编号 "), day)).when(o % 5 == 2, F.concat(F.lit("发布于 "), day, F.lit(" 编号 "), day))
    field = field.when(o % 5 == 3, F.concat(F.lit("发布时间：2024-03-05 编号 "), day)).otherwise(F.concat(F.lit("发布时间：20249999 发布时间："), day))
    written = F.date_format("o_orderdate", "yyyy-MM-dd")
    line = F.when(o % 3 == 0, F.concat(written, F.lit("  作者：A 来源：B"))).when(o % 3 == 1, F.concat(written, F.lit(" 作者：A 讲座时间 19:00"))).otherwise(F.concat(F.lit("于 "), written, F.lit(" 作者：A")))
    shown = F.when(o % 6 == 0, " ").when(o % 6 == 1, "2024-03-05").when(o % 6 == 2, "about 2024-03-05").when(o % 6 == 3, "发布时间：2024年3月5日").when(o % 6 == 4, "Mar 5, 2024").otherwise("2024-03-05 14:00-15:30")
    marks = F.when(o % 6 == 1, "event-date").otherwise("time")
    return d.table("orders").select("o_orderkey", dates.compact_date(field).alias("compact"), dates.editorial_line(line).alias("editorial"), dates.listing_role(shown, marks).alias("role"))


@query(
    """with o as (select o_orderkey, o_orderdate::date + 12000 as "day" from orders) select o_orderkey, case o_orderkey % 6 when 0 then 'unknown' when 1 then 'unknown' when 2 then 'partly' when 3 then 'several'
   when 4 then case when "day" + interval 1 day - interval 1 second - interval 8 hour < timestamp '2028-04-08 04:00:00' then 'passed' else 'open' end
   else case when "day" + interval 14 hour + interval 30 minute - interval 8 hour < timestamp '2028-04-08 04:00:00' then 'passed' else 'open' end end deadline from o""",
    domain=False,
)
def deadlines(d: Domain) -> DataFrame:
    o, later = F.col("o_orderkey"), F.date_format(F.date_add(F.to_date("o_orderdate"), 12000), "yyyy年M月d日")
    quotes = (
        F.when(o % 6 == 0, F.array().cast("array<string>")).when(o % 6 == 1, F.array(F.lit("3月5日前"))).when(o % 6 == 2, F.array(later, F.lit("soon"))).when(o % 6 == 3, F.array(F.lit("2024-03-05"), F.lit("2024-03-06")))
        .when(o % 6 == 4, F.array(F.concat(F.lit("截止 "), later))).otherwise(F.array(F.concat(later, F.lit(" 14:30"))))
    )
    return d.table("orders").select("o_orderkey", dates.deadline_view(quotes, dt.datetime(2028, 4, 8, 4)).alias("deadline"))


@query(
    """select o_orderkey, case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y-%m-%d') when o_orderkey % 3 = 1 then strftime(o_orderdate + interval 90 minute, '%Y-%m-%dT%H:%M:%S') else '' end stamp,
  case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y年%m月%d日') when o_orderkey % 3 = 1 then strftime(o_orderdate + interval 90 minute, '%Y年%m月%d日 %H:%M') else '发布时间未知' end as "label", (o_orderkey % 100 * 10 // 4)::bigint took from orders""",
    domain=False,
)
def date_labels(d: Domain) -> DataFrame:
    o, at = F.col("o_orderkey"), F.col("o_orderdate")
    shown = F.when(o % 3 == 0, at).when(o % 3 == 1, at + F.expr("interval 90 minutes"))
    ended = at + F.make_dt_interval(secs=((o % 100) / 4).cast("decimal(18,6)"))
    return d.table("orders").select("o_orderkey", dates.date_stamp(shown).alias("stamp"), dates.date_label(shown).alias("label"), dates.seconds_taken(at, ended).alias("took"))


@query("select l_orderkey page, max(l_shipdate::date) newest, max(l_shipdate::date) < date '1998-08-02' - 365 stale from lineitem group by 1", domain=False)
def stale_lists(d: Domain) -> DataFrame:
    sample = F.concat(F.lit('{"title": "t", "date": "'), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit('"}'))
    feeds = d.table("lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.concat(F.lit('{"lists": [{"samples": ['), F.array_join(F.collect_list(sample), ", "), F.lit(', {"date": "never"}]}]}')).alias("feed"))
    return feeds.select("page", dates.newest_listed(F.col("feed")).alias("newest"), dates.is_stale(F.col("feed"), AS_OF).alias("stale"))
