"""Tables of the driver as samples and points, so each operator can be held against SQL over the same tables.

Business columns only stand in for counters and gauges here. Values are whole numbers until a last
division, so results don't depend on the order of sums. Each adapter has the same tables as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3600
WEEK = 7 * 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item (event type), start_ust, n, cents: hours without events are gaps."""
    ust = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("item"), (F.floor(ust / HOUR) * HOUR).cast("long").alias("start_ust"), F.round(F.col("value") * 100).cast("long").alias("c"))
    return rows.groupBy("item", "start_ust").agg(F.count("*").alias("n"), F.sum("c").alias("cents"))


SQL_HOURS = """hours as (
  select event_type as item, cast(floor(epoch(ts) / 3600) as bigint) * 3600 as start_ust, count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents
  from events group by all)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters, one sample an hour with events: restart every week; raw (64 bits) and raw32."""
    hours = event_hours(spark, sf_dir)
    start = hours.agg((F.floor(F.min("start_ust") / 86400) * 86400).alias("t0"))
    rows = hours.crossJoin(F.broadcast(start))  # one row
    rows = rows.withColumn("segment", F.floor((F.col("start_ust") - F.col("t0")) / WEEK).cast("long"))
    order = Window.partitionBy("item", "segment").orderBy("start_ust").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"raw": F.sum("n").over(order), "cum": F.sum("cents").over(order)})
    return rows.select(
        F.lit("h").alias("host"),
        "item",
        "segment",
        ((F.col("start_ust") - F.col("t0")) / HOUR).cast("long").alias("sample_id"),
        (F.col("start_ust") + HOUR).alias("ust"),
        ((F.col("start_ust") + HOUR - F.col("t0") - F.col("segment") * WEEK) * 100).alias("uptime_cs"),
        "raw",
        F.lit(64).alias("bits"),
        F.pmod(F.col("cum") * 40000, F.lit(1 << 32)).alias("raw32"),
        F.lit(32).alias("bits32"),
        "cum",
    )


SQL_SAMPLES = (
    SQL_HOURS
    + """,
t as (select cast(floor(min(start_ust) / 86400) as bigint) * 86400 as t0 from hours),
placed as (select *, cast(floor((start_ust - t0) / 604800) as bigint) as segment from hours, t),
samples as (
  select 'h' as host, item, segment, cast((start_ust - t0) / 3600 as bigint) as sample_id, start_ust + 3600 as ust, (start_ust + 3600 - t0 - segment * 604800) * 100 as uptime_cs,
    cast(sum(n) over w as bigint) as raw, cast(sum(cents) over w as bigint) as cum, cast((sum(cents) over w * 40000) % 4294967296 as bigint) as raw32
  from placed window w as (partition by item, segment order by start_ust)),
lagged as (
  select *, lag(raw) over w as raw_b, lag(raw32) over w as raw32_b, lag(cum) over w as cum_b, lag(segment) over w as segment_b, lag(sample_id) over w as sample_b, lag(ust) over w as ust_b, lag(uptime_cs) over w as up_b
  from samples window w as (partition by host, item order by sample_id)),
timed as (
  select *, case when sample_b is null and sample_id = (select min(sample_id) from samples) then 'first_sample' when sample_b is null then 'item_replaced' when segment_b <> segment then 'restart' when sample_b <> sample_id - 1 then 'item_replaced' when uptime_cs <= up_b then 'non_positive_elapsed' end as broken from lagged),
points as (
  select host, item, segment, sample_id, coalesce(ust_b, ust) as start_ust, ust as end_ust, case when broken is null then uptime_cs - up_b else 0 end as elapsed_cs,
    case when broken is null then raw - raw_b end as delta, broken as reason, case when broken is null then cast(raw - raw_b as double) / cast(uptime_cs - up_b as double) * 100 end as value
  from timed)"""
)


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a gauge: whole mean cents of four hosts by event type and hour; hours without events are gaps."""
    ust = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("h"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")).alias("host"),
        F.col("event_type").alias("item"),
        (F.floor(ust / HOUR) * HOUR).cast("long").alias("start_ust"),
        F.round(F.col("value") * 100).cast("long").alias("c"),
    )
    rows = rows.groupBy("host", "item", "start_ust").agg(F.floor(F.sum("c") / F.count("*")).cast("double").alias("value"))
    return rows.select("host", "item", "start_ust", (F.col("start_ust") + HOUR).alias("end_ust"), F.lit(HOUR * 100).cast("long").alias("elapsed_cs"), "value", F.lit(None).cast("string").alias("reason"))


SQL_GAUGE = """points as (
  select 'h' || cast(user_id % 4 as varchar) as host, event_type as item, cast(floor(epoch(ts) / 3600) as bigint) * 3600 as start_ust, cast(floor(epoch(ts) / 3600) as bigint) * 3600 + 3600 as end_ust,
    cast(360000 as bigint) as elapsed_cs, cast(floor(sum(cast(round(value * 100) as bigint)) / count(*)) as double) as value, cast(null as varchar) as reason
  from events group by all)"""


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals a day as memory sizes: total, available, cached, free (whole cents)."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, cents)), F.lit(0)).cast("long")
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    return table(spark, sf_dir, "orders").groupBy(day).agg(F.sum(cents).cast("long").alias("total"), of("O").alias("available"), of("F").alias("cached"), of("P").alias("free"))


SQL_DAYS = """days as (
  select strftime(o_orderdate, '%Y-%m-%d') as day, cast(sum(c) as bigint) as total, cast(coalesce(sum(c) filter (o_orderstatus = 'O'), 0) as bigint) as available,
    cast(coalesce(sum(c) filter (o_orderstatus = 'F'), 0) as bigint) as cached, cast(coalesce(sum(c) filter (o_orderstatus = 'P'), 0) as bigint) as free
  from (select *, cast(round(o_totalprice * 100) as bigint) as c from orders) group by all)"""


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items a day as a disk's counters, by return flag: ios, sectors and ticks of the day."""
    ticks = F.round("l_extendedprice").cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("item"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("ios"), F.sum(F.col("l_quantity").cast("long")).alias("sectors"), F.sum(ticks).alias("ticks")
    )


SQL_DISKS = """disks as (
  select l_returnflag as item, strftime(l_shipdate, '%Y-%m-%d') as day, count(*) as ios, cast(sum(cast(l_quantity as bigint)) as bigint) as sectors, cast(sum(cast(round(l_extendedprice) as bigint)) as bigint) as ticks
  from lineitem group by all)"""
