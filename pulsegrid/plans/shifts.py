"""Queries of level shifts and of what each route could and couldn't look at: the driver's events, one after the other, as values every two minutes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators import catalog, detect, series
from pulsegrid.plans import adapters as ad
from pulsegrid.plans.telemetry import names_of, values_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STEP, SEGMENT, LONG = 120, 900, 60
#: Event type, the series that its events stand for, their value, and which of them are there.
SERIES = [
    ("click", "QUEUE", "-", "runq_sz", "x + up * 40", "event_id % 97 <> 0"),
    ("view", "CPU", "all", "idle", "x + up * 60", "event_id % 97 <> 0"),
    ("purchase", "MEMORY", "-", "kbavail", "(x + 20 - up * 12) * 100000", "event_id % 89 <> 0"),
    ("signup", "NET_SOCK", "-", "totsck", "x * 10 + up * 400 + i", "true"),
    ("error", "SWAP", "-", "pswpin", "x", "true"),
    ("click", "PCSW", "-", "cswch", "x", "i % 20 <> 0"),
    ("view", "QUEUE", "-", "blocked", "5", "true"),
    ("view", "PAGE", "-", "majflt", "x", "i < 8"),
    ("click", "DISK", "dev8-0", "await", "x + 50 + up * 300", "i % 400 < 70"),
    ("signup", "IO", "-", "tps", "null", "i < 50"),
    ("purchase", "KTABLES", "-", "file_nr", "x + up * 2000", "true"),
]
SELECTED = sorted({s[1] for s in SERIES} - {"KTABLES"})
KEYS = "host, activity, item, field"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def lined(spark: SparkSession, d: str) -> DataFrame:
    """Points (host, activity, item, field, segment, start_ust, end_ust, elapsed_cs, value) of ``SERIES``."""
    order = Window.partitionBy("event_type").orderBy("event_id")
    rows = ad.table(spark, d, "events").select("event_type", "event_id", (F.row_number().over(order) - 1).cast("long").alias("i"), F.pmod(F.floor("value"), F.lit(16)).cast("long").alias("x"))
    rows = rows.withColumn("up", F.floor(F.col("i") / LONG) % 2)
    each = [f"case when event_type = '{t}' and ({there}) then named_struct('activity', '{a}', 'item', '{i}', 'field', '{f}', 'value', cast({x} as double)) end" for t, a, i, f, x, there in SERIES]
    rows = rows.withColumn("s", F.explode(F.expr(f"array({', '.join(each)})"))).where("s is not null")
    start = (F.col("i") * STEP).cast("long")
    return rows.select(
        F.lit("h").alias("host"), "s.activity", "s.item", "s.field", F.floor(F.col("i") / SEGMENT).cast("long").alias("segment"), start.alias("start_ust"), (start + STEP).alias("end_ust"),
        F.lit(STEP * 100).cast("long").alias("elapsed_cs"), "s.value",
    )


SQL_LINED = f"""with e as (select event_type, event_id, row_number() over (partition by event_type order by event_id) - 1 as i, cast(floor(value) as bigint) % 16 as x from events),
u as (select *, i // {LONG} % 2 as up from e),
points as ({" union all ".join(f"select 'h' as host, '{a}' as activity, '{i}' as item, '{f}' as field, cast(i // {SEGMENT} as bigint) as segment, cast(i * {STEP} as bigint) as start_ust, cast((i + 1) * {STEP} as bigint) as end_ust, cast({x} as double) as value from u where event_type = '{t}' and ({there})" for t, a, i, f, x, there in SERIES)}),
catalog({names_of(catalog.CATALOG_SCHEMA)}) as ({values_sql(catalog.CATALOG)}),
known as (select p.*, change, amount, change_floor, shift from points p join catalog c using (activity, field) where value is not null)"""
# half an hour has 15 of them; halves have 7
SQL_SHIFTS = f"""{SQL_LINED},
w as (
  select *, row_number() over o - 1 as n, list(value) over (o rows between 15 preceding and 1 preceding) as a, list(value) over (o rows between current row and 14 following) as b,
    first_value(start_ust) over (o rows between 15 preceding and 1 preceding) as f, last_value(end_ust) over (o rows between current row and 14 following) as t
  from known window o as (partition by {KEYS}, segment order by end_ust)),
full_ as (select *, list_median(a) as level, list_median(b) as after from w where len(a) = 15 and len(b) = 15 and t - f = 30 * {STEP}),
m as (
  select *, after - level as move, case change when 'absolute' then amount else greatest(abs(level) * amount, change_floor) end as least,
    ((list_median(a[9:15]) - list_median(a[1:7])) / 960.0::double + (list_median(b[9:15]) - list_median(b[1:7])) / 960.0::double) / 2 * 1800 as trend
  from full_ where change <> 'none'),
s as (
  select *, case when trend * move <= 0 then move when abs(trend) >= abs(move) then 0 else move - trend end as step, len(list_filter(b, lambda v: (v - level) * sign(move) > 0 and (v - level) * sign(move) >= least)) / 15.0::double as stays,
    list_median(list_concat(list_transform(a, lambda v: abs(v - level)), list_transform(b, lambda v: abs(v - after)))) * 1.4826::double as scatter
  from m where shift = 'both' or (shift = 'upper' and move > 0) or (shift = 'lower' and move < 0)),
h as (
  select *, case when scatter > 0 then abs(step) / scatter else abs(step) / least end as strength from s
  where abs(move) >= least and abs(step) >= least and stays >= 0.7 and (scatter = 0 or abs(step) / scatter >= 3)),
i as (select *, n - row_number() over (partition by {KEYS}, segment order by n) as island from h),
shifts as (
  select {KEYS}, segment, start_ust, t as end_ust, level as level_before, after as level_after, move as shift from i
  qualify row_number() over (partition by {KEYS}, segment, island order by strength desc, stays desc, n) = 1)"""


@query(SQL_SHIFTS + " select * from shifts")
def level_shift_catalog(spark, d):
    return catalog.level_shift_route(lined(spark, d)).drop("normalized", "route")


SQL_STATUS = (
    SQL_SHIFTS
    + f""",
base as (select {KEYS}, count(*) as n, median(value) as med from known group by all),
mads as (select {KEYS}, any_value(b.n) as n, median(abs(value - med)) as mad from known join base b using ({KEYS}) group by {KEYS}),
present as (select distinct {KEYS} from points join catalog using (activity, field)),
sized as (select {KEYS}, segment, count(*) as points from known group by all),
joined as (select {KEYS}, segment, count(*) as joined from full_ group by all),
win as (
  select {KEYS}, sum(greatest(points - 29, 0)) as candidates, sum(points - greatest(points - 29, 0)) as blind, sum(coalesce(joined, 0)) as joined
  from sized left join joined using ({KEYS}, segment) group by {KEYS}),
every as (
  select 'h' as host, c.activity, p.item, c.field, c.deviation, c.change, p.item is not null as present, n, mad, candidates, coalesce(blind, 0) as blind, coalesce(joined, 0) as joined
  from catalog c left join present p using (activity, field) left join mads m on m.activity = c.activity and m.field = c.field and m.item = p.item left join win w on w.activity = c.activity and w.field = c.field and w.item = p.item),
routed as (select *, unnest(['fixed', 'robust', 'absolute', 'level_shift']) as route from every),
counts as (select {KEYS}, 'level_shift' as route, count(*) as count from shifts group by all),
why as (
  select r.*, coalesce(count, 0) as count, case
    when not list_contains({SELECTED!r}, r.activity) then 'excluded_by_selection'
    when not present then 'series_absent_from_source'
    when r.route = 'fixed' and (r.activity, r.field) not in ({", ".join(f"('{c[0]}', '{c[1]}')" for c in catalog.CONDITIONS)}) then 'no_fixed_condition_declared'
    when r.route = 'level_shift' and change = 'none' then 'level_shift_not_declared'
    when n is null then 'no_usable_observation'
    when r.route in ('robust', 'absolute') and n < 12 then 'too_few_baseline_samples'
    when r.route = 'robust' and mad = 0 then 'dispersion_not_measurable'
    when r.route = 'absolute' and change = 'none' then 'no_magnitude_floor_declared'
    when r.route = 'level_shift' and joined = 0 then case when candidates > 0 then 'window_spans_missing_samples' else 'no_window_long_enough' end end as reason
  from routed r left join counts c on c.activity = r.activity and c.field = r.field and c.item = r.item and c.route = r.route),
statuses as (
  select {KEYS}, route, case when reason is not null then 'not_evaluated' when count > 0 then 'detected' when route = 'level_shift' and blind > 0 then 'evaluated_with_blind_edges' else 'evaluated' end as status, reason,
    count, cast(case when route = 'level_shift' and reason is null then blind else 0 end as bigint) as blind_edges
  from why)"""
)


def statuses(spark: SparkSession, d: str) -> DataFrame:
    rows = lined(spark, d)
    return catalog.route_status(rows, catalog.level_shift_route(rows), selected=SELECTED)


@query(SQL_STATUS + " select * from statuses")
def route_status(spark, d):
    return statuses(spark, d)


BY_DESIGN = "('excluded_by_selection', 'no_fixed_condition_declared', 'no_deviation_interest_declared', 'level_shift_not_declared')"


@query(SQL_STATUS + f""" select host, route, count(*) as series, count(*) filter (status <> 'not_evaluated') as evaluated, count(*) filter (status = 'detected') as detected,
  count(*) filter (reason is not null and reason not in {BY_DESIGN}) as blocked, count(*) filter (reason in {BY_DESIGN}) as by_design from statuses group by all""")
def coverage_tally(spark, d):
    return catalog.coverage_tally(statuses(spark, d))


#: Runs of these values; marks of the whole host and of one series.
HIT = "(activity in ('QUEUE', 'NET_SOCK') and value >= 15) or (activity = 'DISK' and value >= 340)"
SQL_EPISODES = f"""{SQL_LINED},
hit as (select *, case when start_ust = lag(end_ust) over (partition by {KEYS} order by end_ust) then 0 else 1 end as fresh from known where field in ('runq_sz', 'await') and {HIT}),
runs as (select *, sum(fresh) over (partition by {KEYS} order by end_ust) as g from hit),
found as (select {KEYS}, min(start_ust) as start_ust, max(end_ust) as end_ust from runs group by {KEYS}, g),
marks as (
  select cast(i * {STEP} as bigint) as ust, cast(null as varchar) as activity from u where event_type = 'click' and i % 61 = 0
  union all select cast(i * {STEP} as bigint), 'DISK' from u where event_type = 'click' and i % 7 = 0),
steps as (select end_ust - start_ust as step, count(*) as n from points group by 1),
p90 as (select min(step) as p from (select step, sum(n) over (order by step) as run, sum(n) over () as every from steps) where run * 10 >= every * 9),
limits as (select least(p * 2, 1800) as gap, greatest((select max(end_ust) - min(start_ust) from points) // 4, least(p * 2, 1800) * 4) as cap from p90),
d as (select *, row_number() over (order by start_ust, end_ust, activity, item, field) as n from found),
e as (
  select host, activity, item, field, start_ust, end_ust, n, start_ust as first, end_ust as covered, [activity] as held, 1 as episode from d where n = 1
  union all
  select d.host, d.activity, d.item, d.field, d.start_ust, d.end_ust, d.n, case when j.joins then e.first else d.start_ust end, case when j.joins then greatest(e.covered, d.end_ust) else d.end_ust end,
    case when j.joins then list_append(e.held, d.activity) else [d.activity] end, e.episode + case when j.joins then 0 else 1 end
  from e join d on d.n = e.n + 1, limits, lateral (
    select d.start_ust - e.start_ust <= gap and d.start_ust - e.first <= cap and not exists (
      select 1 from marks m where m.ust > e.first and m.ust <= greatest(e.covered, d.end_ust) and (m.activity is null or m.activity = d.activity or list_contains(e.held, m.activity))) as joins) j)"""


def marked(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("event_type").orderBy("event_id")
    rows = ad.table(spark, d, "events").select("event_type", (F.row_number().over(order) - 1).cast("long").alias("i")).where("event_type = 'click'")
    of = F.explode(F.expr("filter(array(case when i % 61 = 0 then '' end, case when i % 7 = 0 then 'DISK' end), x -> x is not null)"))
    return rows.select(F.lit("h").alias("host"), (F.col("i") * STEP).alias("ust"), of.alias("activity")).withColumn("activity", F.nullif("activity", F.lit("")))


@query(SQL_EPISODES.replace("with e as", "with recursive ev as", 1).replace("from e),", "from ev),", 1) + f" select {KEYS}, start_ust, end_ust, cast(episode as bigint) as episode from e")
def episodes_with_marks(spark, d):
    rows = lined(spark, d)
    found = series.hit_runs(rows.where("field in ('runq_sz', 'await')"), F.expr(HIT))
    limits = detect.episode_limits(rows).first()
    return detect.episodes(found, limits["gap_s"], limits["span_cap_s"], marked(spark, d))
