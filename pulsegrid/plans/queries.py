"""One query for each operator over the driver's tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import counters as fn
from pulsegrid.operators import detect, hosts, series
from pulsegrid.plans import adapters as ad

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


S, G, M, K, H = (f"with {x}\n" for x in (ad.SQL_SAMPLES, ad.SQL_GAUGE, ad.SQL_DAYS, ad.SQL_DISKS, ad.SQL_HOURS))
GAPS_RUNS = """, hits as (select * from points where value is not null and elapsed_cs > 0 and {hit}),
marks as (select *, case when start_ust = lag(end_ust) over (partition by host, item order by end_ust) then 0 else 1 end as fresh from hits),
grouped as (select *, sum(fresh) over (partition by host, item order by end_ust) as g from marks),
runs as (select host, item, min(start_ust) as start_ust, max(end_ust) as end_ust, count(*) as points, max(end_ust) - min(start_ust) as seconds, min(value) as min_value, max(value) as max_value,
  sum(value * elapsed_cs) / sum(elapsed_cs) as mean_value from grouped group by host, item, g)
"""
BASE = """, centre as (select host, item, count(*) as n, median(value) as median from points where value is not null group by host, item),
base0 as (select p.host, p.item, any_value(n) as n, any_value(c.median) as median, median(abs(value - c.median)) as mad, count(*) filter (abs(value - c.median) > 0) as off_centre
  from points p join centre c on p.host = c.host and p.item = c.item where value is not null group by p.host, p.item),
base as (select *, case when n < 12 then 'insufficient_samples' when mad = 0 then 'not_measurable' when off_centre < floor((n * 20 + 99) / 100) then 'too_sparse' else 'measured' end as state from base0)
"""


def with_long(rows):
    """Deltas as long, which the values of these tables fit."""
    return rows.withColumn("delta", F.col("delta").cast("long"))


def deltas(spark, d):
    return with_long(series.deltas(ad.samples(spark, d)))


def points(spark, d):
    return series.rates(deltas(spark, d))


# --- deltas and rates


@query(S + "select item, sample_id, case when broken is null then ((raw32 - raw32_b) % 4294967296 + 4294967296) % 4294967296 end as delta, broken is null and raw32 < raw32_b as wrapped, broken as reason from timed")
def delta_wrap32(spark, d):
    return with_long(series.deltas(ad.samples(spark, d), "raw32", "bits32")).select("item", "sample_id", "delta", F.coalesce("wrapped", F.lit(False)).alias("wrapped"), "reason")


@query(S + "select item, sample_id, delta, elapsed_cs, reason from points")
def delta_wrap64(spark, d):
    return deltas(spark, d).select("item", "sample_id", "delta", "elapsed_cs", "reason")


@query(S + ", x as (select *, cast(hash32 as bigint) as raw_c from (select *, (sample_id * 7919) % 101 as hash32 from timed)), y as (select *, lag(raw_c) over (partition by item order by sample_id) as b from x) select coalesce(case when broken is not null then broken when raw_c < b then 'ambiguous_decrease' end, 'valid') as reason, count(*) as n from y group by 1")
def delta_classified(spark, d):
    rows = ad.samples(spark, d).withColumn("raw", F.col("sample_id") * 7919 % 101)
    return series.deltas(rows).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(S + "select item, sample_id, value as rate from points where value is not null")
def rate_per_sec(spark, d):
    return points(spark, d).where("value is not null").select("item", "sample_id", F.col("value").alias("rate"))


@query(S + "select item, sample_id, case when raw32 < raw32_b then 0.0 else cast(raw32 - raw32_b as double) / cast(uptime_cs - up_b as double) * 100 end as rate from timed where broken is null")
def rate_clamped(spark, d):
    w = Window.partitionBy("host", "item").orderBy("sample_id")
    rows = series.deltas(ad.samples(spark, d)).withColumn("before", F.lag("raw32").over(w)).where("reason is null")
    return rows.select("item", "sample_id", fn.clamped_rate(F.col("raw32"), F.col("before"), F.col("elapsed_cs")).alias("rate"))


@query(S + "select item, sample_id, elapsed_cs from points where reason is null")
def interval_cs(spark, d):
    return deltas(spark, d).where("reason is null").select("item", "sample_id", "elapsed_cs")


TICKS = ", ticks as (select start_ust, item, n, cast(sum(n) over (partition by start_ust) as bigint) as total from hours)"


@query(H + TICKS + " select start_ust, item, cast(greatest(n, 0) as double) / cast(total as double) * 100 as share from ticks where total > 0")
def tick_percent(spark, d):
    rows = ad.event_hours(spark, d).withColumn("total", F.sum("n").over(Window.partitionBy("start_ust")))
    return rows.select("start_ust", "item", fn.tick_share(F.col("n"), F.col("total")).alias("share"))


@query(H + " select start_ust, cast(sum(n) as bigint) as total from hours group by 1")
def tick_total(spark, d):
    return ad.event_hours(spark, d).groupBy("start_ust").agg(F.sum("n").alias("total"))


@query(H + " select start_ust, count(*) as online, cast(sum(n) as bigint) as ticks, cast(coalesce(sum(n) filter (item = 'error'), 0) as double) * 100 / cast(sum(n) as double) as error_percent from hours where n > 0 group by 1")
def cpu_all_reaggregate(spark, d):
    part = F.coalesce(F.sum(F.when(F.col("item") == "error", F.col("n"))), F.lit(0))
    return ad.event_hours(spark, d).where("n > 0").groupBy("start_ust").agg(F.count("*").alias("online"), F.sum("n").alias("ticks"), fn.percent(part, F.sum("n")).alias("error_percent"))


@query(S + "select item, sample_id, (cast(cum as double) - cast(cum_b as double)) / (cast(greatest(uptime_cs - up_b, 1) as double) * 100) as pressure from timed where broken is null")
def psi_pressure(spark, d):
    w = Window.partitionBy("host", "item").orderBy("sample_id")
    rows = series.deltas(ad.samples(spark, d)).withColumn("before", F.lag("cum").over(w)).where("reason is null")
    return rows.select("item", "sample_id", fn.pressure(F.col("cum"), F.col("before"), F.col("elapsed_cs")).alias("pressure"))


@query(H + " select item, start_ust, cast(cents as double) / 100 as value from hours")
def gauge_scale(spark, d):
    return ad.event_hours(spark, d).select("item", "start_ust", fn.gauge_hundredths(F.col("cents")).alias("value"))


@query(K + " select item, day, case when ios > 1 then cast(ticks as double) / ios else 0.0 end as await_ms, case when ios > 0 then cast(sectors as double) / ios / 2 else 0.0 end as request_kb, cast(ticks as double) / 8640000.0 * 100 / 10 as busy from disks")
def disk_derived(spark, d):
    ios = F.col("ios")
    return ad.disks(spark, d).select("item", "day", F.when(ios > 1, fn.mean_wait_ms(F.col("ticks"), ios)).otherwise(0.0).alias("await_ms"), fn.mean_request_kb(F.col("sectors"), ios).alias("request_kb"), fn.device_busy_percent(F.col("ticks"), F.lit(8640000)).alias("busy"))


@query(M + " select day, greatest(total - available, 0) as used, case when total = 0 then 0.0 else cast(greatest(total - available, 0) as double) * 100 / cast(total as double) end as used_percent, greatest(total - free - cached, 0) as without_cache, case when total + available <> 0 then cast(cached as double) * 100 / cast(total + available as double) else 0.0 end as commit_percent, case when total <> 0 then cast(greatest(total - free, 0) as double) * 100 / cast(total as double) end as swap_percent from days")
def memory_derived(spark, d):
    c = F.col
    zero = F.lit(0).cast("long")
    return ad.order_days(spark, d).select(
        "day",
        fn.memory_used(c("total"), c("available")).alias("used"),
        fn.memory_used_percent(c("total"), c("available")).alias("used_percent"),
        fn.used_without_cache(c("total"), c("free"), zero, c("cached")).alias("without_cache"),
        fn.commit_percent(c("cached"), c("total"), c("available")).alias("commit_percent"),
        fn.swap_used_percent(c("total"), c("free")).alias("swap_percent"),
    )


@query(M + " select day, case when total <> 0 then cast(total - free as double) * 100 / cast(total as double) end as used, case when total <> 0 then cast(total - available as double) * 100 / cast(total as double) end as unprivileged from days")
def fs_used_pct(spark, d):
    c = F.col
    return ad.order_days(spark, d).select("day", fn.space_used_percent(c("total"), c("free")).alias("used"), fn.unprivileged_used_percent(c("total"), c("available")).alias("unprivileged"))


@query(H + " select item, start_ust, case when n % 10 <> 0 then cast(greatest(n, cents) as double) * 800 / (cast(n % 10 as double) * 1000000) end as full_duplex, case when n % 10 <> 0 then cast(n + cents as double) * 800 / (cast(n % 10 as double) * 1000000) end as half_duplex from hours")
def ifutil(spark, d):
    c = F.col
    busy = lambda full: fn.interface_busy_percent(c("n"), c("cents"), c("n") % 10, F.lit(full))
    return ad.event_hours(spark, d).select("item", "start_ust", busy(True).alias("full_duplex"), busy(False).alias("half_duplex"))


@query(H + ", r as (select item, min(cents) as lo, max(cents) as hi from hours group by 1) select item, start_ust, case when hi <> lo then cast(cents - lo as double) * 100 / cast(hi - lo as double) end as range_percent from hours join r using (item)")
def sensor_range_pct(spark, d):
    w = Window.partitionBy("item")
    rows = ad.event_hours(spark, d).withColumns({"lo": F.min("cents").over(w), "hi": F.max("cents").over(w)})
    return rows.select("item", "start_ust", fn.range_percent(F.col("cents"), F.col("lo"), F.col("hi")).alias("range_percent"))


@query(G + " select host, item, start_ust, (value - b) * 6000 / cast(elapsed_cs as double) as per_minute from (select *, lag(value) over (partition by host, item order by end_ust) as b from points) where b is not null")
def battery_per_min(spark, d):
    rows = ad.gauge(spark, d).withColumn("b", F.lag("value").over(Window.partitionBy("host", "item").orderBy("end_ust"))).where("b is not null")
    return rows.select("host", "item", "start_ust", fn.drain_per_minute(F.col("value"), F.col("b"), F.col("elapsed_cs")).alias("per_minute"))


@query(H + " select start_ust, cast(sum(floor(cents / 1000) * n) as double) / cast(sum(n) as double) as mhz from hours group by 1")
def weighted_mhz(spark, d):
    weighed = F.sum((F.floor(F.col("cents") / 1000) * F.col("n")).cast("long"))
    return ad.event_hours(spark, d).groupBy("start_ust").agg((weighed.cast("double") / F.sum("n").cast("double")).alias("mhz"))


# --- joins


@query(S + "select item, sample_id, raw_b as previous, broken from timed")
def prev_sample_match(spark, d):
    w = Window.partitionBy("host", "item").orderBy("sample_id")
    return series.deltas(ad.samples(spark, d)).select("item", "sample_id", F.lag("raw").over(w).alias("previous"), F.col("reason").alias("broken"))


TWO = "select a.host, a.start_ust, {} as value from points a join points b on a.host = b.host and a.start_ust = b.start_ust and a.end_ust = b.end_ust where a.item = 'click' and b.item = 'view'"


def two(spark, d, combine):
    rows = ad.gauge(spark, d)
    a, b = (rows.where(F.col("item") == i).select("host", "start_ust", "end_ust", F.col("value").alias(n)) for i, n in (("click", "a"), ("view", "b")))
    return a.join(b, ["host", "start_ust", "end_ust"]).select("host", "start_ust", combine(F.col("a"), F.col("b")).alias("value"))


@query(G + TWO.format("case when b.value <> 0 then a.value / b.value end"))
def timeline_ratio(spark, d):
    return two(spark, d, F.try_divide)


@query(G + TWO.format("a.value + b.value"))
def timeline_sum(spark, d):
    return two(spark, d, lambda a, b: a + b)


@query(G + TWO.format("a.value - b.value"))
def timeline_diff(spark, d):
    return two(spark, d, lambda a, b: a - b)


GRID = """, span as (select max(lo) as g0, min(hi) as g1 from (select host, min(start_ust) as lo, max(end_ust) as hi from points group by 1)),
cut as (select host, item, value, greatest(start_ust, g0) as lo, least(end_ust, g1) as hi, g0, g1 from points, span where greatest(start_ust, g0) < least(end_ust, g1)),
placed as (select *, unnest(range(cast((lo - g0) // 5400 as bigint), cast((hi - 1 - g0) // 5400 as bigint) + 1)) as bucket from cut),
weighed as (select *, least(hi, g0 + bucket * 5400 + 5400, g1) - greatest(lo, g0 + bucket * 5400) as w from placed),
grid as (select host, item, bucket, sum(value * w) / sum(w) as value, cast(sum(w) as bigint) as overlap_s from weighed group by 1, 2, 3)
"""


def grid(spark, d):
    rows = ad.gauge(spark, d)
    return series.align(rows.crossJoin(F.broadcast(hosts.common_window(rows))), F.col("window_start"), F.col("window_end"), 5400)


@query(G + GRID + "select * from grid")
def align_grid(spark, d):
    return grid(spark, d)


@query(G + GRID + "select item, host, sum(cast(round(value * 1000) as bigint))::bigint as thousandths, count(*) as buckets from grid group by 1, 2")
def compare_mean(spark, d):
    return grid(spark, d).groupBy("item", "host").agg(F.sum(F.round(F.col("value") * 1000).cast("long")).alias("thousandths"), F.count("*").alias("buckets"))


@query(G + "select max(lo) as window_start, min(hi) as window_end from (select host, min(start_ust) as lo, max(end_ust) as hi from points group by 1)")
def common_window(spark, d):
    return hosts.common_window(ad.gauge(spark, d))


# --- aggregations


@query(S + "select host, item, cast(sum(delta) as bigint) as delta_sum, cast(sum(elapsed_cs) filter (reason is null) as bigint) as elapsed_cs, cast(sum(delta) as double) / cast(sum(elapsed_cs) filter (reason is null) as double) * 100 as rate from points group by 1, 2")
def sum_rate_period(spark, d):
    return series.period_rate(deltas(spark, d))


@query(G + "select host, item, sum(value) / count(value) as mean from points group by 1, 2")
def mean_sample(spark, d):
    return ad.gauge(spark, d).groupBy("host", "item").agg((F.sum("value") / F.count("value")).alias("mean"))


WEIGHTED = "(1 + start_ust // 3600 % 3)"


@query(G + f"select host, item, sum(value * {WEIGHTED}) / sum({WEIGHTED}) as mean from points group by 1, 2")
def mean_time_weighted(spark, d):
    w = 1 + F.floor(F.col("start_ust") / 3600) % 3
    return ad.gauge(spark, d).groupBy("host", "item").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("mean"))


SUMMARY = """select host, item, count(*) as points, count(value) as observed, count(*) - count(value) as missing, cast(coalesce(sum(elapsed_cs) filter (value is not null), 0) as bigint) as observed_cs,
  cast(coalesce(sum(elapsed_cs) filter (value is null), 0) as bigint) as missing_cs, min(start_ust) as first_ust, max(end_ust) as last_ust, max(value) as max_value,
  min(end_ust) filter (value = top) as max_ust, min(value) as min_value, min(end_ust) filter (value = low) as min_ust, arg_max(value, end_ust) filter (value is not null) as last_value
from (select *, max(value) over (partition by host, item) as top, min(value) over (partition by host, item) as low from points) group by 1, 2"""


@query(S + SUMMARY)
def summary_flat(spark, d):
    return series.summarize(points(spark, d))


@query(G + SUMMARY)
def extrema_with_time(spark, d):
    return series.summarize(ad.gauge(spark, d))


@query(S + "select item, arg_max(value, end_ust) filter (value is not null) as last_value from points group by 1")
def last_valid(spark, d):
    return series.summarize(points(spark, d)).select("item", "last_value")


@query(S + "select item, cast(sum(delta) as bigint) as total from points group by 1")
def delta_sum(spark, d):
    return deltas(spark, d).groupBy("item").agg(F.sum("delta").alias("total"))


@query(G + "select host, item, quantile_disc(value, 0.95) as percentile from points group by 1, 2")
def p95_sample(spark, d):
    return series.weighted_percentile(ad.gauge(spark, d).withColumn("one", F.lit(1)), 0.95, "one")


@query(G + f", w as (select host, item, value, sum({WEIGHTED}) as w from points group by 1, 2, 3), r as (select *, sum(w) over (partition by host, item order by value) as run, sum(w) over (partition by host, item) as total from w) select host, item, min(value) filter (run >= floor((total * 950 + 999) / 1000)) as percentile from r group by 1, 2")
def p95_time_weighted(spark, d):
    return series.weighted_percentile(ad.gauge(spark, d).withColumn("w", 1 + F.floor(F.col("start_ust") / 3600) % 3), 0.95, "w")


@query(S + "select item, coalesce(reason, 'ok') as reason, count(*) as n from points group by 1, 2")
def exclusion_hist(spark, d):
    return deltas(spark, d).groupBy("item", F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(S + "select item, segment, min(start_ust) filter (reason is null) as first_ust, max(end_ust) as last_ust, count(*) as samples, count(*) filter (reason is null) as continuous, count(*) filter (reason is not null) as broken, cast(sum(elapsed_cs) as bigint) as covered_cs from points group by 1, 2")
def period_bounds(spark, d):
    ok = F.col("reason").isNull()
    return deltas(spark, d).groupBy("item", "segment").agg(
        F.min(F.when(ok, F.col("start_ust"))).alias("first_ust"), F.max("end_ust").alias("last_ust"), F.count("*").alias("samples"), F.count_if(ok).alias("continuous"), F.count_if(~ok).alias("broken"), F.sum("elapsed_cs").alias("covered_cs")
    )


@query(S + "select item, count(*) as points, count(value) as observed, count(*) - count(value) as missing from points group by 1")
def coverage(spark, d):
    return series.summarize(points(spark, d)).select("item", "points", "observed", "missing")


@query(H + ", shown as (select count(distinct start_ust) as n_shown from hours) select item, cast(sum(cents) as double) / cast(any_value(n_shown) as double) as average from hours, shown group by 1")
def avg_rows_activity_denominator(spark, d):
    hours = ad.event_hours(spark, d)
    shown = hours.agg(F.count_distinct("start_ust").alias("n_shown"))
    return hours.crossJoin(F.broadcast(shown)).groupBy("item").agg((F.sum("cents").cast("double") / F.first("n_shown").cast("double")).alias("average"))


@query(M + " select substr(day, 1, 7) as month, cast(sum(total - available) as double) * 100 / cast(sum(total) as double) as ratio from days group by 1")
def ratio_of_means(spark, d):
    c = F.col
    return ad.order_days(spark, d).groupBy(F.substring("day", 1, 7).alias("month")).agg(fn.percent(F.sum(c("total") - c("available")), F.sum("total")).alias("ratio"))


# --- windows


SEGMENTS = ", m as (select *, case when start_ust = lag(end_ust) over (partition by host, item order by end_ust) and elapsed_cs > 0 then 0 else 1 end as c from points), s as (select *, cast(sum(c) over (partition by host, item order by end_ust) as bigint) as run_segment from m)"


@query(G + SEGMENTS + " select host, item, run_segment, count(*) as points, min(start_ust) as start_ust from s group by 1, 2, 3")
def segments(spark, d):
    return series.with_segments(ad.gauge(spark, d)).groupBy("host", "item", "run_segment").agg(F.count("*").alias("points"), F.min("start_ust").alias("start_ust"))


@query(G + GAPS_RUNS.format(hit="value >= 15000") + "select * from runs")
def hit_runs(spark, d):
    return series.hit_runs(ad.gauge(spark, d), F.col("value") >= 15000)


@query(G + GAPS_RUNS.format(hit="value >= 10000") + "select * from runs qualify row_number() over (partition by host, item order by seconds desc, start_ust) = 1")
def longest_run(spark, d):
    return series.longest_run(ad.gauge(spark, d), F.col("value") >= 10000)


STEPS = ", g as (select host, item, end_ust - lag(end_ust) over (partition by host, item order by end_ust) as step from points)"


@query(G + STEPS + " select host, item, quantile_disc(step, 0.9) as p90 from g where step is not null group by 1, 2")
def interval_p90(spark, d):
    rows = ad.gauge(spark, d).withColumn("step", F.col("end_ust") - F.lag("end_ust").over(Window.partitionBy("host", "item").orderBy("end_ust")))
    return rows.where("step is not null").groupBy("host", "item").agg(F.expr("percentile_disc(0.9) within group (order by step)").alias("p90")).withColumn("p90", F.col("p90").cast("long"))


@query(G + STEPS + ", r as (select *, row_number() over (partition by host, item order by step) as k, count(*) over (partition by host, item) as n from g where step is not null) select host, item, step as upper_median from r where k = n // 2 + 1")
def upper_median(spark, d):
    w = Window.partitionBy("host", "item")
    rows = ad.gauge(spark, d).withColumn("step", F.col("end_ust") - F.lag("end_ust").over(w.orderBy("end_ust"))).where("step is not null")
    rows = rows.withColumns({"k": F.row_number().over(w.orderBy("step")), "n": F.count("*").over(w)})
    return rows.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select("host", "item", F.col("step").alias("upper_median"))


@query(G + GAPS_RUNS.format(hit="value >= 20000") + """, wide as (select host, item, start_ust - 7200 as lo, end_ust + 7200 as hi from runs),
m as (select *, case when lo <= max(hi) over (partition by host, item order by lo, hi rows between unbounded preceding and 1 preceding) then 0 else 1 end as c from wide),
s as (select *, sum(c) over (partition by host, item order by lo, hi rows between unbounded preceding and current row) as g from m) select host, item, min(lo) as start_ust, max(hi) as end_ust, count(*) as spans from s group by host, item, g""")
def chart_window_merge(spark, d):
    return series.merged_windows(series.hit_runs(ad.gauge(spark, d), F.col("value") >= 20000), 7200)


@query(S + "select item, sample_id, cast(sum(case when broken = 'restart' then 1 else 0 end) over (partition by host, item order by sample_id) as bigint) as boot from timed")
def boot_counter(spark, d):
    w = Window.partitionBy("host", "item").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, 0)
    restart = F.coalesce((F.col("reason") == "restart").cast("int"), F.lit(0))
    return deltas(spark, d).select("item", "sample_id", F.sum(restart).over(w).alias("boot"))


@query(H + ", b as (select *, lag(n) over (partition by item order by start_ust) as p from hours) select item, start_ust, n from b where n is distinct from p")
def zero_omit(spark, d):
    rows = ad.event_hours(spark, d).withColumn("p", F.lag("n").over(Window.partitionBy("item").orderBy("start_ust")))
    return rows.where(~F.col("n").eqNullSafe(F.col("p"))).select("item", "start_ust", "n")


# --- filters


@query(G + "select host, item, start_ust, value from points where start_ust % 86400 between 28800 and 64800 and end_ust % 86400 between 28800 and 64800 and end_ust - start_ust <= 36000")
def native_window(spark, d):
    return series.daily_window(ad.gauge(spark, d), 28800, 64800).select("host", "item", "start_ust", "value")


@query(G + "select host, item, start_ust, value from points where (start_ust % 86400 >= 79200 or start_ust % 86400 <= 14400) and (end_ust % 86400 >= 79200 or end_ust % 86400 <= 14400) and end_ust - start_ust <= 21600")
def native_window_cross_midnight(spark, d):
    return series.daily_window(ad.gauge(spark, d), 79200, 14400).select("host", "item", "start_ust", "value")


@query(G + ", f as (select *, end_ust % 86400 as tod from points), a as (select *, min(end_ust) filter (tod >= 28800) over (partition by host, item) as first_in from f), b as (select *, min(end_ust) filter (end_ust > first_in and tod > 64800) over (partition by host, item) as past from a) select host, item, end_ust, value from b where end_ust > first_in and (past is null or end_ust < past)")
def sar_start_consumed(spark, d):
    w = Window.partitionBy("host", "item")
    tod = F.pmod(F.col("end_ust"), F.lit(86400))
    rows = ad.gauge(spark, d).withColumn("first_in", F.min(F.when(tod >= 28800, F.col("end_ust"))).over(w))
    rows = rows.withColumn("past", F.min(F.when((F.col("end_ust") > F.col("first_in")) & (tod > 64800), F.col("end_ust"))).over(w))
    return rows.where("end_ust > first_in and (past is null or end_ust < past)").select("host", "item", "end_ust", "value")


@query(G + "select host, item, start_ust, value from points where start_ust >= 1704326400 and end_ust <= 1705536000")
def epoch_window(spark, d):
    return ad.gauge(spark, d).where("start_ust >= 1704326400 and end_ust <= 1705536000").select("host", "item", "start_ust", "value")


@query(S + "select item, segment, sample_id from samples qualify row_number() over (partition by item, segment order by sample_id) <= 10")
def count_per_segment(spark, d):
    rank = F.row_number().over(Window.partitionBy("item", "segment").orderBy("sample_id"))
    return ad.samples(spark, d).withColumn("r", rank).where("r <= 10").select("item", "segment", "sample_id")


# --- hosts and continuity


FULL = """, ends as (select host, item, min(start_ust) as lo, max(start_ust) as hi from points group by 1, 2), slots as (select host, item, unnest(range(lo, hi + 1, 3600)) as s from ends),
buckets as (select a.host, a.item, a.s // 3600 as bucket, value from slots a left join points p on p.host = a.host and p.item = a.item and p.start_ust = a.s)"""


def full_buckets(spark, d):
    rows = ad.gauge(spark, d)
    ends = rows.groupBy("host", "item").agg(F.min("start_ust").alias("lo"), F.max("start_ust").alias("hi"))
    slots = ends.select("host", "item", F.explode(F.sequence("lo", "hi", F.lit(3600).cast("long"))).alias("start_ust"))
    return slots.join(rows.select("host", "item", "start_ust", "value"), ["host", "item", "start_ust"], "left").select("host", "item", (F.col("start_ust") / 3600).cast("long").alias("bucket"), "value")


@query(G + FULL + ", f as (select *, last_value(case when value is not null then bucket end ignore nulls) over w as kb, last_value(value ignore nulls) over w as kv from buckets window w as (partition by host, item order by bucket rows between unbounded preceding and current row)) select host, item, bucket, case when bucket - kb <= 2 then kv end as filled from f")
def fill_hold_last(spark, d):
    return series.hold_last(full_buckets(spark, d), 2).select("host", "item", "bucket", "filled")


@query(G + FULL + """, f as (select *, last_value(case when value is not null then bucket end ignore nulls) over w as ab, last_value(value ignore nulls) over w as av, first_value(case when value is not null then bucket end ignore nulls) over v as bb, first_value(value ignore nulls) over v as bv
  from buckets window w as (partition by host, item order by bucket rows between unbounded preceding and current row), v as (partition by host, item order by bucket rows between current row and unbounded following))
select host, item, bucket, case when value is not null then value when bb - ab - 1 <= 3 then av + (bv - av) * (bucket - ab) / (bb - ab) end as filled from f""")
def fill_linear(spark, d):
    return series.linear_fill(full_buckets(spark, d), 3).select("host", "item", "bucket", "filled")


# --- detection


@query(G + BASE + "select host, item, n, median, mad, off_centre, state from base")
def baseline_mad(spark, d):
    return detect.baselines(ad.gauge(spark, d))


@query(G.replace("count(*)) as double) as value", "count(*)) as double) as value0") .replace("points as (", "points0 as (") + ", points as (select *, case when value0 > 30000 then value0 else 0.0 end as value from points0)" + BASE + "select state, count(*) as n from base group by 1")
def dispersion_state(spark, d):
    rows = ad.gauge(spark, d).withColumn("value", F.when(F.col("value") > 30000, F.col("value")).otherwise(0.0))
    return detect.baselines(rows).groupBy("state").agg(F.count("*").alias("n"))


@query(G + GAPS_RUNS.format(hit="value >= 15000") + "select * from runs where points >= 2")
def fixed_condition_runs(spark, d):
    return series.hit_runs(ad.gauge(spark, d), F.col("value") >= 15000).where("points >= 2")


@query(G.replace("points as (", "points1 as (") + BASE.replace("from points ", "from points1 ") + ", points as (select p.* from points1 p join base b on p.host = b.host and p.item = b.item where state = 'measured' and abs(value - median) >= 3 * mad and abs(value - median) >= 5000)" + GAPS_RUNS.format(hit="true") + "select * from runs")
def robust_deviation(spark, d):
    return detect.deviations(ad.gauge(spark, d), 5000.0, 3.0)


SPARSE = G.replace("count(*)) as double) as value", "count(*)) as double) as value0").replace("points as (", "points0 as (") + ", points1 as (select *, case when value0 > 30000 then value0 else 0.0 end as value from points0)"


@query(SPARSE + BASE.replace("from points ", "from points1 ") + ", points as (select p.* from points1 p join base b on p.host = b.host and p.item = b.item where state in ('not_measurable', 'too_sparse') and abs(value - median) >= 100)" + GAPS_RUNS.format(hit="true") + "select * from runs")
def absolute_departure(spark, d):
    rows = ad.gauge(spark, d).withColumn("value", F.when(F.col("value") > 30000, F.col("value")).otherwise(0.0))
    return detect.absolute_departures(rows, 100.0)


HOURLY = "with hours as (select * from (" + H + " select * from hours)), points as (select 'h' as host, item, start_ust, start_ust + 3600 as end_ust, cast(cents as double) as value from hours)"


@query(HOURLY + """, w as (select host, item, start_ust, row_number() over o as n, median(value) over (o rows between 3 preceding and 1 preceding) as b, median(value) over (o rows between current row and 2 following) as a,
  count(*) over (o rows between 3 preceding and 2 following) as k, first_value(start_ust) over (o rows between 3 preceding and 1 preceding) as f, last_value(end_ust) over (o rows between current row and 2 following) as t from points window o as (partition by host, item order by end_ust)),
h as (select *, a - b as shift from w where k = 6 and t - f = 6 * 3600 and abs(a - b) >= 40000), i as (select *, n - row_number() over (partition by host, item order by n) as island from h)
select host, item, start_ust, b as level_before, a as level_after, shift from i qualify row_number() over (partition by host, item, island order by abs(shift) desc, n) = 1""")
def level_shift_fixed_w(spark, d):
    rows = ad.event_hours(spark, d).select(F.lit("h").alias("host"), "item", "start_ust", (F.col("start_ust") + 3600).alias("end_ust"), F.col("cents").cast("double").alias("value"))
    return detect.window_shifts(rows, 3, 40000.0)


SHIFTS = HOURLY + """, w as (select item, start_ust, row_number() over o as n, list(value) over (o rows between 5 preceding and 1 preceding) as a, list(value) over (o rows between current row and 4 following) as b,
  first_value(start_ust) over (o rows between 5 preceding and 1 preceding) as f, last_value(end_ust) over (o rows between current row and 4 following) as t from points window o as (partition by item order by end_ust)),
m as (select *, list_median(a) as level, list_median(b) - list_median(a) as shift, ((a[4] + a[5]) / 2 - (a[1] + a[2]) / 2) / 10800.0::double as sa, ((b[4] + b[5]) / 2 - (b[1] + b[2]) / 2) / 10800.0::double as sb from w where len(a) = 5 and len(b) = 5 and t - f = 36000),
e as (select *, (sa + sb) / 2 * 18000 as explained, len(list_filter(b, lambda x: (x - level) * sign(shift) >= 2000)) / 5.0::double as stays,
  list_median(list_concat(list_transform(a, lambda x: abs(x - level)), list_transform(b, lambda x: abs(x - (level + shift))))) * 1.4826::double as scatter from m),
s as (select *, case when explained * shift <= 0 then shift else sign(shift) * greatest(abs(shift) - abs(explained), 0) end as step from e),
h as (select *, case when scatter > 0 then abs(step) / scatter else abs(step) / 2000 end as strength from s where least(abs(shift), abs(step)) >= 2000 and stays >= 0.7 and (scatter = 0 or abs(step) / scatter >= 3)),
i as (select *, n - row_number() over (partition by item order by n) as island from h)
select 'h' as host, item, start_ust, shift from i qualify row_number() over (partition by item, island order by strength desc, stays desc, n) = 1"""


@query(SHIFTS)
def level_shift_dynamic(spark, d):
    rows = ad.event_hours(spark, d).select(F.lit("h").alias("host"), "item", "start_ust", (F.col("start_ust") + 3600).alias("end_ust"), F.col("cents").cast("double").alias("value"))
    return detect.level_shifts(rows, 2000.0).select("host", "item", "start_ust", "shift")


@query(G + GAPS_RUNS.format(hit="value >= 100") + ", e as (select min(start_ust) as lo, max(end_ust) as hi from points) select host, item, start_ust, (end_ust - start_ust) * 100 >= (hi - lo) * 90 as standing from runs, e where points >= 3")
def standing_split(spark, d):
    rows = ad.gauge(spark, d)
    ends = rows.agg(F.min("start_ust").alias("lo"), F.max("end_ust").alias("hi"))
    found = series.hit_runs(rows, F.col("value") >= 100).where("points >= 3").crossJoin(F.broadcast(ends))
    return detect.standing(found, F.col("lo"), F.col("hi")).select("host", "item", "start_ust", "standing")


@query(f"""with recursive found as ({SQL["robust_deviation"]}),
d as (select host, item, start_ust, end_ust, row_number() over (partition by host order by start_ust, end_ust, item) as n from found),
e as (select *, start_ust as first, 1 as episode from d where n = 1
  union all select d.*, case when d.start_ust - e.start_ust > 7200 or d.start_ust - e.first > 28800 then d.start_ust else e.first end, e.episode + case when d.start_ust - e.start_ust > 7200 or d.start_ust - e.first > 28800 then 1 else 0 end
  from e join d on d.host = e.host and d.n = e.n + 1)
select host, item, start_ust, end_ust, cast(episode as bigint) as episode from e""")
def episodes(spark, d):
    return detect.episodes(detect.deviations(ad.gauge(spark, d), 5000.0, 3.0), 7200, 28800)


RUNS = G + GAPS_RUNS.format(hit="value >= 12000")


@query(RUNS + "select host, item, start_ust, case when points < 2 then 'thin' when points >= 6 and (seconds // 3600 - points) * 10 < points + (seconds // 3600 - points) then 'adequate' else 'moderate' end as evidence from runs")
def sufficiency(spark, d):
    rows = series.hit_runs(ad.gauge(spark, d), F.col("value") >= 12000)
    return rows.select("host", "item", "start_ust", detect.sufficiency(F.col("points"), 2, (F.col("seconds") / 3600).cast("long") - F.col("points")).alias("evidence"))


@query(RUNS + "select host, item, start_ust, greatest(1 + case when points >= 3 and seconds >= 1800 then 1 else 0 end - case when points < 2 then 1 else 0 end, 0) as priority from runs")
def priority(spark, d):
    rows = series.hit_runs(ad.gauge(spark, d), F.col("value") >= 12000)
    return rows.select("host", "item", "start_ust", detect.priority(F.lit(1), F.col("points"), F.col("seconds"), F.col("points") < 2, F.lit(False)).alias("priority"))


# --- sinks


@query(S + "select item, sample_id, '{\"item\":\"' || item || '\",\"sample_id\":' || cast(sample_id as varchar) || ',\"raw\":\"' || cast(raw as varchar) || '\"}' as line from samples")
def ndjson_contract(spark, d):
    rows = ad.samples(spark, d)
    return rows.select("item", "sample_id", F.to_json(F.struct("item", "sample_id", F.col("raw").cast("string").alias("raw"))).alias("line"))
