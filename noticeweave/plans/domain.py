"""The notice domain on the driver's tables, as DataFrames and as SQL.

schools are nations (those of region 0 are disabled), departments are suppliers, notices are orders (status P: not yet
dated), appearances are the distinct order and supplier pairs of lineitem, readers are customers subscribed to
their nation, reads are the readers' finished orders, and tasks and executions are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same tables for oracles; every oracle starts with them.
SQL = """
with schools as (select n_nationkey::bigint id, n_name name, n_regionkey::bigint province, n_regionkey > 0 enabled from nation),
departments as (
  select s_suppkey id, s_nationkey::bigint school_id, s_name name, 'https://' || lower(replace(s_name, '#', '-')) || '.example.edu/notices/' list_url,
         case when s_acctbal < 0 then '' when s_acctbal < 5000 then ' news ' else null end group_name from supplier
),
appearances as (
  select l_orderkey notice_id, l_suppkey department_id, min(l_shipdate) first_seen, max(l_shipdate) last_seen from lineitem group by 1, 2
),
notices as (
  select o_orderkey id, (select min(department_id) from appearances a where a.notice_id = o_orderkey) department_id,
         o_orderpriority || ' ' || o_orderstatus title, case when o_orderstatus <> 'P' then o_orderdate end published_at,
         o_orderdate created_at, o_custkey author_id, (o_totalprice * 100)::bigint content_bytes from orders
),
subscriptions as (select c_custkey user_id, c_nationkey::bigint school_id, c_mktsegment segment from customer),
reads as (select o_custkey user_id, o_orderkey notice_id, o_orderdate read_at from orders where o_orderstatus = 'F'),
states as (
  select o_custkey user_id, o_orderkey notice_id, o_orderpriority = '1-URGENT' starred,
         case when o_orderpriority = '5-LOW' then o_orderdate end trashed_at from orders
),
tasks as (select event_id id, user_id school_id, event_type state, ts queued_at, props from events)
"""


class Domain:
    """The domain's tables in one folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def schools(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.col("n_name").alias("name"),
            F.col("n_regionkey").cast("long").alias("province"),
            (F.col("n_regionkey") > 0).alias("enabled"),
        )

    @property
    def departments(self) -> DataFrame:
        balance = F.col("s_acctbal")
        return self.table("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_nationkey").cast("long").alias("school_id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("https://"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".example.edu/notices/")).alias("list_url"),
            F.when(balance < 0, "").when(balance < 5000, " news ").alias("group_name"),
        )

    @property
    def appearances(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("notice_id"), F.col("l_suppkey").alias("department_id"))
            .agg(F.min("l_shipdate").alias("first_seen"), F.max("l_shipdate").alias("last_seen"))
        )

    @property
    def notices(self) -> DataFrame:
        first = self.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("department_id"))
        rows = self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_at"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_custkey").alias("author_id"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("content_bytes"),
        )
        return rows.join(first, "id", "left")

    @property
    def subscriptions(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("school_id"), F.col("c_mktsegment").alias("segment")
        )

    @property
    def reads(self) -> DataFrame:
        return self.table("orders").where("o_orderstatus = 'F'").select(
            F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("notice_id"), F.col("o_orderdate").alias("read_at")
        )

    @property
    def states(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderkey").alias("notice_id"),
            (F.col("o_orderpriority") == "1-URGENT").alias("starred"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")).alias("trashed_at"),
        )

    @property
    def tasks(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("school_id"), F.col("event_type").alias("state"), F.col("ts").alias("queued_at"), "props"
        )
