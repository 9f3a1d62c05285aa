"""Queries of the chain from samples to points: the driver's events as samples of several activities, by hour.

The SQL is written out activity by activity, from what each column is meant to be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators import filters, hosts
from pulsegrid.operators import points as pt
from pulsegrid.plans import adapters as ad

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: Of each activity whether its items are event types, and its fields: name, value (of n and cents), bits.
FIELDS = {
    "DISK": (
        True,
        [
            ("tps", "n", 64), ("read_sectors", "cents", 64), ("write_sectors", "cents % 1000", 64), ("discard_sectors", "(n * 7) % 3", 64), ("read_ticks", "cents % 97", 32), ("write_ticks", "n * 3", 32),
            ("discard_ticks", "0", 32), ("tot_ticks", "cents % 5000", 32), ("rq_ticks", "cents % 7000", 32), ("major", "8", 32), ("minor", "length(item) % 3", 32),
        ],
    ),
    "NET_DEV": (
        True,
        [
            ("rxpck_per_sec", "n", 64), ("txpck_per_sec", "n * 2", 64), ("rx_bytes_per_sec", "case when n % 4 = 0 then {big} - cents else cents end", 64), ("tx_bytes_per_sec", "cents * 3", 64),
            ("rxcmp_per_sec", "0", 64), ("txcmp_per_sec", "0", 64), ("rxmcst_per_sec", "n % 5", 64), ("speed", "(n % 3) * 10", 32), ("duplex", "n % 3", 8),
        ],
    ),
    "NET_EDEV": (True, [("rxerr_per_sec", "n % 3", 64), ("txcarr_per_sec", "cents % 5", 64)]),
    "IO": (False, [("tps", "n", 64), ("bread", "cents", 64)]),
    "PAGE": (False, [("fault", "cents", 64), ("majflt", "n", 64)]),
    "QUEUE": (False, [("runq_sz", "n", 64), ("ldavg_1", "cents", 32)]),
    "PSI_IO": (False, [("sio", "cents", 64), ("sio_10", "n", 64)]),
    "MEMORY": (
        False,
        [
            ("kbmemtotal", "cents * 2", 64), ("kbmemfree", "cents % 700", 64), ("kbavail", "cents", 64), ("kbbuffers", "n", 64), ("kbcached", "n * 5", 64), ("kbcommit", "cents + n", 64),
            ("kbswptotal", "(n % 3) * 100", 64), ("kbswpfree", "(n % 3) * 50", 64), ("kbswpcad", "n % 40", 64),
        ],
    ),
}
BIG = "18446744073709551615"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Hours with events as samples of a host: fields go up and down, types that a sample lacks move the places of others."""
    hours = ad.event_hours(spark, d)
    start = hours.agg(F.min("start_ust").alias("t0"))
    hours = hours.crossJoin(F.broadcast(start))  # one row
    rows = hours.withColumns({
        "item_index": F.row_number().over(Window.partitionBy("start_ust").orderBy("item")) - 1,
        "item_count": F.count("*").over(Window.partitionBy("start_ust")).cast("int"),
        "segment": F.floor((F.col("start_ust") - F.col("t0")) / ad.WEEK).cast("long"),
    })
    # hours are few: one for each hour of the time that the table covers
    ids = hours.select("start_ust").distinct().withColumn("sample_id", (F.row_number().over(Window.orderBy("start_ust")) - 1).cast("long"))
    rows = rows.join(ids, "start_ust")
    total = rows.groupBy("start_ust", "segment", "sample_id", "t0").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents")).withColumns({"item": F.lit("-"), "item_index": F.lit(0), "item_count": F.lit(1)})
    big = f"cast({BIG} as decimal(38,0))"

    def long(rows: DataFrame, single: bool) -> DataFrame:
        each = [f"named_struct('activity', '{a}', 'field', '{f}', 'raw', cast({x.replace('{big}', big)} as decimal(20,0)), 'bits', {b})" for a, (named, own) in FIELDS.items() if named != single for f, x, b in own]
        rows = rows.selectExpr("*", f"explode(array({', '.join(each)})) as x")
        up = ((F.col("start_ust") - F.col("t0") - F.col("segment") * ad.WEEK + 7200) * 100).cast("decimal(20,0)")
        return rows.select(F.lit("h").alias("host"), "segment", "sample_id", F.col("start_ust").alias("ust"), up.alias("uptime_cs"), "x.activity", "item", "x.field", "x.raw", "x.bits", "item_index", "item_count")

    return long(rows, False).unionByName(long(total, True))


def fields_sql(activity: str) -> str:
    return ", ".join(f"{x.replace('{big}', BIG + '::hugeint')} as {f}" for f, x, _ in FIELDS[activity][1])


SQL_BASE = (
    "with "
    + ad.SQL_HOURS
    + """,
t as (select min(start_ust) as t0 from hours),
h as (
  select item, start_ust, n, cents, cast(floor((start_ust - t0) / 604800) as bigint) as segment, cast(dense_rank() over (order by start_ust) - 1 as bigint) as sample_id,
    row_number() over (partition by start_ust order by item) - 1 as idx, count(*) over (partition by start_ust) as cnt
  from hours, t),
one as (select '-' as item, start_ust, segment, sample_id, cast(sum(n) as bigint) as n, cast(sum(cents) as bigint) as cents from h group by start_ust, segment, sample_id)"""
)


def pairs_sql(activity: str, fields: str) -> str:
    """Rows of ``activity`` as c and those of the sample before as p, in ``m_...``; anew says that the item is a new one."""
    names = [f for f, _, _ in FIELDS[activity][1]]
    both = ", ".join(f"c.{f}, p.{f} as {f}_b" for f in names)
    one = "h" if FIELDS[activity][0] else "one"
    rest = ", idx, cnt" if one == "h" else ", 0 as idx, 1 as cnt"
    found = "p.item = c.item"
    if activity == "DISK":
        found = "p.minor = c.minor qualify row_number() over (partition by c.sample_id, c.idx order by case when p.idx >= least(c.idx, p.cnt - 1) then 0 else 1 end, p.idx) = 1"
    return f""",
v_{activity} as (select item, start_ust, segment, sample_id{rest}, {fields_sql(activity)} from {one}),
p_{activity} as (
  select c.item, c.idx, c.segment, c.sample_id, c.start_ust as end_ust, coalesce(p.start_ust, c.start_ust) as start_ust, p.sample_id is null as alone, p.segment <> c.segment as restarted,
    case when p.segment = c.segment then (c.start_ust - p.start_ust) * 100 else 0 end as elapsed_cs, {both}
  from v_{activity} c left join v_{activity} p on p.sample_id = c.sample_id - 1 and {found}),
m_{activity} as (
  select *, case when alone and sample_id = 0 then 'first_sample' when restarted then 'restart' when alone or ({fields}) then 'item_replaced' end as broken from p_{activity})"""


DISK_NEW = " and ".join(["tps < tps_b"] + [f"({f}_b = 0 or {f} < {f}_b)" for f in ("read_sectors", "write_sectors", "discard_sectors")])
NET_BACK = " or ".join(f"{f} < {f}_b" for f in ("rxpck_per_sec", "txpck_per_sec", "rx_bytes_per_sec", "tx_bytes_per_sec", "rxcmp_per_sec", "txcmp_per_sec", "rxmcst_per_sec"))
NET_OVER = " or ".join(
    f"({a} < {a}_b and {b} > {b}_b and {a}_b > 9223372036854775807)"
    for a, b in (("rx_bytes_per_sec", "rxpck_per_sec"), ("tx_bytes_per_sec", "txpck_per_sec"), ("rxpck_per_sec", "rx_bytes_per_sec"), ("txpck_per_sec", "tx_bytes_per_sec"))
)
NEW = {"DISK": DISK_NEW, "NET_DEV": f"({NET_BACK}) and not ({NET_OVER})", "NET_EDEV": "rxerr_per_sec < rxerr_per_sec_b"}
SQL_PAIRS = SQL_BASE + "".join(pairs_sql(a, NEW.get(a, "false")) for a in FIELDS)


def counter_sql(f: str, bits: int = 64, divided: float = 1.0, clamped: bool = False) -> tuple[str, str]:
    """Value and reason of a counter."""
    delta = f"case when {f} >= {f}_b then cast({f} - {f}_b as double) else cast({f} - {f}_b + 4294967296 as double) end"
    value = f"{delta} / cast(elapsed_cs as double) * 100 / {divided}::double"
    back = f"{f} < {f}_b" if bits == 64 else "false"
    if clamped:
        return f"case when broken is not null then null when {f} < {f}_b then 0.0 else {value} end", "broken"
    return f"case when broken is null and not ({back}) then {value} end", f"coalesce(broken, case when {back} then 'ambiguous_decrease' end)"


def gauge_sql(x: str) -> tuple[str, str]:
    return f"case when broken is distinct from 'item_replaced' then {x} end", f"case when broken = 'item_replaced' then broken end"


def share_sql(part: str, whole: str, zero: str) -> tuple[str, str]:
    """A derived percent: of a whole of 0 it is 0 or missing."""
    x = f"case when {whole} <> 0 then cast({part} as double) * 100 / cast({whole} as double) {'else 0.0' if zero == 'zero' else ''} end"
    return x, f"case when {x} is null then 'missing_in_sample' end"


IOS = "(tps - tps_b)"
SECTOR_SUM = " + ".join(f"(case when {f} < {f}_b then null else {f} - {f}_b end)" for f in ("read_sectors", "write_sectors", "discard_sectors"))
TICK_SUM = " + ".join(f"(case when {f} < {f}_b then {f} - {f}_b + 4294967296 else {f} - {f}_b end)" for f in ("read_ticks", "write_ticks", "discard_ticks"))
RX, TX = (f"(cast({f} - {f}_b as double) / cast(elapsed_cs as double) * 100)" for f in ("rx_bytes_per_sec", "tx_bytes_per_sec"))
RX_BACK, TX_BACK = (f"{f} < {f}_b" for f in ("rx_bytes_per_sec", "tx_bytes_per_sec"))
USED, FREE_CACHED, SWAP = "greatest(kbmemtotal - kbavail, 0)", "(kbmemfree + kbbuffers + kbcached)", "greatest(kbswptotal - kbswpfree, 0)"
COLUMN_SQL: dict[str, dict[str, tuple[str, str]]] = {
    "DISK": {
        "tps": counter_sql("tps"),
        "read_kb_per_sec": counter_sql("read_sectors", divided=2),
        "write_kb_per_sec": counter_sql("write_sectors", divided=2),
        "discard_kb_per_sec": counter_sql("discard_sectors", divided=2),
        "avg_queue_size": counter_sql("rq_ticks", 32, 1000),
        "util_pct": counter_sql("tot_ticks", 32, 10, clamped=True),
        "read_ticks": counter_sql("read_ticks", 32),
        "write_ticks": counter_sql("write_ticks", 32),
        "discard_ticks": counter_sql("discard_ticks", 32),
        "avg_request_size": (
            f"case when broken is not null then null when {IOS} <= 0 then 0.0 else cast({SECTOR_SUM} as double) / {IOS} / 2 end",
            f"coalesce(broken, case when {IOS} > 0 and ({SECTOR_SUM}) is null then 'ambiguous_decrease' end)",
        ),
        "await": (f"case when broken is not null then null when {IOS} <= 0 then 0.0 else cast({TICK_SUM} as double) / {IOS} end", "broken"),
    },
    "NET_DEV": {f: counter_sql(f) for f, _, b in FIELDS["NET_DEV"][1] if b == 64}
    | {"speed": gauge_sql("cast(speed as double)"), "duplex": gauge_sql("cast(duplex as double)")}
    | {
        "ifutil_pct": (
            f"case when broken is null and speed <> 0 and not ({RX_BACK}) and not ({TX_BACK}) then (case when duplex = 2 then greatest({RX}, {TX}) else {RX} + {TX} end) * 800 / (speed * 1000000.0::double) end",
            f"case when broken is not null then broken when speed = 0 then 'missing_in_sample' when ({RX_BACK}) or ({TX_BACK}) then 'ambiguous_decrease' end",
        )
    },
    "NET_EDEV": {f: counter_sql(f) for f in ("rxerr_per_sec", "txcarr_per_sec")},
    "IO": {f: counter_sql(f, clamped=True) for f in ("tps", "bread")},
    "PAGE": {f: counter_sql(f) for f in ("fault", "majflt")},
    "QUEUE": {"runq_sz": gauge_sql("cast(runq_sz as double)"), "ldavg_1": gauge_sql("cast(ldavg_1 as double) / 100")},
    "PSI_IO": {"sio": ("case when broken is null then (cast(sio as double) - cast(sio_b as double)) / (cast(elapsed_cs as double) * 100) end", "broken"), "sio_10": gauge_sql("cast(sio_10 as double) / 100")},
    "MEMORY": {f: gauge_sql(f"cast({f} as double)") for f, _, _ in FIELDS["MEMORY"][1]}
    | {
        "kbmemused": (f"cast({USED} as double)", "null"),
        "memused_pct": share_sql(USED, "kbmemtotal", "zero"),
        "kbmemused_nocache": (f"cast(greatest(kbmemtotal - {FREE_CACHED}, 0) as double)", "null"),
        "memused_nocache_pct": share_sql(f"greatest(kbmemtotal - {FREE_CACHED}, 0)", "kbmemtotal", "none"),
        "kbmemfree_withcache": (f"cast({FREE_CACHED} as double)", "null"),
        "memused_withcache_pct": share_sql("greatest(kbmemtotal - kbmemfree, 0)", "kbmemtotal", "none"),
        "commit_pct": share_sql("kbcommit", "(kbmemtotal + kbswptotal)", "zero"),
        "kbswpused": (f"cast({SWAP} as double)", "null"),
        "swpused_pct": share_sql(SWAP, "kbswptotal", "none"),
        "swpcad_pct": (f"case when kbswptotal <> 0 then case when {SWAP} = 0 then 0.0 else cast(kbswpcad as double) * 100 / cast({SWAP} as double) end end", "case when kbswptotal = 0 then 'missing_in_sample' end"),
    },
}


def columns_sql(activity: str) -> str:
    parts = ", ".join(f"{{field: '{f}', value: cast({v} as double), reason: cast({r} as varchar)}}" for f, (v, r) in COLUMN_SQL[activity].items())
    return f"select '{activity}' as activity, item, segment, sample_id, start_ust, end_ust, elapsed_cs, unnest([{parts}], recursive := true) from m_{activity}"


@query(SQL_PAIRS + " " + " union all ".join(columns_sql(a) for a in FIELDS))
def column_values(spark, d):
    return pt.points(samples(spark, d)).drop("host")


@query(SQL_PAIRS + " " + " union all ".join(f"select '{a}' as activity, item, cast(idx as int) as item_index, sample_id, broken from m_{a}" for a in NEW))
def item_reregistered(spark, d):
    rows = pt.matched(pt.items(samples(spark, d).where(F.col("activity").isin(*NEW))))
    return rows.select("activity", "item", "item_index", "sample_id", "broken")


PROCESSORS = 3


def processor_samples(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of processors: events of the hours so far by user, odd and even ones; hours without either are tickless."""
    ust = F.unix_seconds(F.col("ts").cast("timestamp"))
    hour = (F.floor(ust / ad.HOUR) * ad.HOUR).cast("long")
    rows = ad.table(spark, d, "events").select(hour.alias("ust"), (F.col("user_id") % PROCESSORS).cast("int").alias("c"), (F.col("event_id") % 5).alias("k"))
    ids = rows.select("ust").distinct().withColumn("sample_id", (F.row_number().over(Window.orderBy("ust")) - 1).cast("long"))
    cells = ids.select("ust", "sample_id", F.explode(F.array(*(F.lit(c) for c in range(PROCESSORS)))).alias("c"))
    counts = rows.groupBy("ust", "c").agg(F.count_if(F.col("k") == 0).alias("a"), F.count_if(F.col("k") == 1).alias("b"))
    so_far = Window.partitionBy("c").orderBy("ust").rowsBetween(Window.unboundedPreceding, 0)
    ticks = cells.join(counts, ["ust", "c"], "left").fillna(0, ["a", "b"]).withColumns({"user": F.sum("a").over(so_far), "idle": F.sum("b").over(so_far)})
    singles = ticks.select("ust", "sample_id", "user", "idle", (F.col("c") + 1).alias("item_index"), F.concat(F.lit("cpu"), F.col("c").cast("string")).alias("item"))
    whole = ticks.groupBy("ust", "sample_id").agg(F.sum("user").alias("user"), F.sum("idle").alias("idle")).withColumns({"item_index": F.lit(0), "item": F.lit("all")})
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("decimal(20,0)").alias("raw")) for f in ("user", "idle"))))
    rows = singles.unionByName(whole).withColumn("x", each)
    return rows.select(
        F.lit("h").alias("host"), F.lit(0).cast("long").alias("segment"), "sample_id", "ust", (F.col("ust") * 100).cast("decimal(20,0)").alias("uptime_cs"), F.lit("CPU").alias("activity"), "item",
        "x.field", "x.raw", F.lit(64).alias("bits"), "item_index", F.lit(PROCESSORS + 1).alias("item_count"),
    )


@query("""with e as (select cast(floor(epoch(ts) / 3600) as bigint) * 3600 as ust, cast(user_id % 3 as int) as c, event_id % 5 as k from events),
ids as (select ust, row_number() over (order by ust) - 1 as sample_id from (select distinct ust from e)),
cells as (select ust, sample_id, unnest([0, 1, 2]) as c from ids),
counts as (select ust, c, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b from e group by all),
ticks as (select sample_id, ust, c, sum(coalesce(a, 0)) over w as u, sum(coalesce(b, 0)) over w as i from cells left join counts using (ust, c) window w as (partition by c order by ust)),
paired as (select *, lag(ust) over w as ust_b, lag(u) over w as u_b, lag(i) over w as i_b from ticks window w as (partition by c order by sample_id)),
state as (select *, u - u_b + i - i_b as total, u + i = 0 or u_b + i_b = 0 as gone from paired),
single as (select 'cpu' || c as item, sample_id, coalesce(ust_b, ust) as start_ust, ust as end_ust,
  case when ust_b is null then 'first_sample' when gone then 'missing_in_sample' end as reason,
  case when ust_b is null or gone then null when total = 0 then 0.0 else cast(u - u_b as double) / cast(total as double) * 100 end as usr,
  case when ust_b is null or gone then null when total = 0 then 100.0 else cast(i - i_b as double) / cast(total as double) * 100 end as idl from state),
sums as (select sample_id, sum(u - u_b) filter (u_b + i_b > 0) as du, sum(i - i_b) filter (u_b + i_b > 0) as di, max(ust_b) as start_ust, max(ust) as end_ust from state where ust_b is not null group by 1 having count(*) filter (u_b + i_b > 0) > 0),
alls as (select 'all' as item, sample_id, start_ust, end_ust, cast(null as varchar) as reason, cast(du as double) / cast(greatest(du + di, 1) as double) * 100 as usr, cast(di as double) / cast(greatest(du + di, 1) as double) * 100 as idl from sums
  union all select 'all', sample_id, ust, ust, 'first_sample', null, null from ids where sample_id = 0),
rows_ as (select * from single union all select * from alls)
select item, cast(sample_id as bigint) as sample_id, start_ust, end_ust, unnest([{field: 'user', value: usr}, {field: 'idle', value: idl}], recursive := true), reason from rows_""")
def processor_columns(spark, d):
    rows = pt.points(processor_samples(spark, d)).where(F.col("field").isin("user", "idle"))
    return rows.select("item", "sample_id", "start_ust", "end_ust", "field", "value", "reason")


DAY = 86400


def files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hours of events as samples of one host's files, one for each day, and a row per sample of what the files say of it.

    Days of another layout and release, a restart record at six of every fifth day, and a clock that starts anew every nine days.
    """
    rows = samples(spark, d).where("activity in ('PAGE', 'QUEUE')").drop("segment", "sample_id", "uptime_cs")
    day = F.floor(F.col("ust") / DAY).cast("long")
    rows = rows.withColumns({"day": day, "path": F.concat(F.lit("sa"), day.cast("string"))})
    heads = rows.select("path", "day", "ust").distinct()
    number = F.row_number().over(Window.partitionBy("path").orderBy("ust")) - 1
    cpus, release = F.when(F.col("day") % 23 == 0, 4).otherwise(8), F.lit("6.1")
    heads = heads.withColumns({"number": number.cast("long"), "restarts": ((F.col("day") % 5 == 0) & (F.col("ust") % DAY >= 6 * 3600)).cast("int")})
    heads = heads.withColumns({"uptime_cs": ((F.col("ust") % (9 * DAY)) + 60) * 100, "layout": F.when(F.col("day") % 7 == 0, "a").otherwise("b"), "nodename": F.lit("h"), "sysname": F.lit("s"), "machine": F.lit("m"), "release": release, "cpus": cpus})
    values = rows.join(heads.select("path", "ust", F.col("number").alias("sample_id"), F.col("restarts").cast("long").alias("segment"), F.col("uptime_cs").cast("decimal(20,0)").alias("uptime_cs")), ["path", "ust"])
    return values.drop("day"), heads.withColumnRenamed("path", "file").drop("day")


def merged_sql(carry: bool) -> str:
    broken_file = "false" if carry else "day <> day_b"
    return SQL_BASE + f""",
v as (select start_ust as ust, start_ust // {DAY} as day, n, cents from one),
heads as (select *, case when day % 5 = 0 and ust % {DAY} >= 21600 then 1 else 0 end as restarts, (ust % {9 * DAY} + 60) * 100 as up, day % 7 = 0 as layout, case when day % 23 = 0 then 4 else 8 end as cpus from v),
b as (
  select *, lag(ust) over w as ust_b, lag(day) over w as day_b, lag(restarts) over w as restarts_b, lag(up) over w as up_b, lag(layout) over w as layout_b, lag(cpus) over w as cpus_b, lag(cents) over w as cents_b,
    lag(n) over w as n_b, row_number() over w - 1 as id from heads window w as (order by ust)),
d as (
  select *, case when ust_b is null then 'first' when restarts > case when day = day_b then restarts_b else 0 end then 'restart' when cpus <> cpus_b then 'restart' when layout <> layout_b then 'layout_changed'
    when abs((ust - up // 100) - (ust_b - up_b // 100)) > 5 then 'restart' when up < up_b then 'file_boundary_unverified' when up - up_b > 720000 then 'file_boundary_unverified' when {broken_file} then 'file_boundary_unverified' end as cut from b),
e as (select *, sum(case when cut = 'restart' then 1 else 0 end) over (order by ust) as segment from d),
f as (select *, case when cut = 'first' then 'first_sample' else cut end as broken, case when cut is null then up - up_b else 0 end as elapsed from e),
out_ as (
  select 'PAGE' as activity, 'fault' as field, cents as now, cents_b as before, * from f union all select 'PAGE', 'majflt', n, n_b, * from f)
select activity, field, cast(segment as bigint) as segment, cast(id as bigint) as sample_id, coalesce(ust_b, ust) as start_ust, ust as end_ust, cast(elapsed as bigint) as elapsed_cs,
  case when broken is null and now >= before then cast(now - before as double) / cast(elapsed as double) * 100 end as value, coalesce(broken, case when now < before then 'ambiguous_decrease' end) as reason from out_
union all select 'QUEUE', unnest(['runq_sz', 'ldavg_1']), cast(segment as bigint), cast(id as bigint), coalesce(ust_b, ust), ust, cast(elapsed as bigint), unnest([cast(n as double), cast(cents as double) / 100]), null from f"""


def merged_points(spark: SparkSession, d: str, carry: bool) -> DataFrame:
    values, heads = files(spark, d)
    return pt.points(hosts.merge_files(values, heads, carry)).drop("host", "item")


@query(merged_sql(True))
def merged_files(spark, d):
    return merged_points(spark, d, True)


@query(merged_sql(False))
def merged_files_without_carry(spark, d):
    return merged_points(spark, d, False)


ZONE, OPENS, CLOSES = "Europe/Berlin", 2 * 3600 + 1800, 2 * 3600 + 1200
#: The hours of events, moved to times in which the zone's clock goes forward, and back.
MOVED = (5_000_400, 24_001_200)


def zoned_points(spark: SparkSession, d: str) -> DataFrame:
    moved = ad.gauge(spark, d).withColumn("by", F.explode(F.array(*(F.lit(m) for m in MOVED))))
    return moved.withColumns({"start_ust": F.col("start_ust") + F.col("by"), "end_ust": F.col("end_ust") + F.col("by")}).drop("by")


ZONED_SQL = (
    "with "
    + ad.SQL_GAUGE
    + f""",
moved as (select host, item, start_ust + plus as start_ust, end_ust + plus as end_ust, value from points, (values {", ".join(f"({m})" for m in MOVED)}) as q(plus)),
-- summer time is from 31 March to 27 October 2024, each at one o'clock UTC
told as (select *, (start_ust + case when start_ust >= 1711846800 and start_ust < 1729990800 then 7200 else 3600 end) % 86400 as a, (end_ust + case when end_ust >= 1711846800 and end_ust < 1729990800 then 7200 else 3600 end) % 86400 as b from moved),
entered as (select *, a >= {OPENS} or a <= {CLOSES} as starts from told where b >= {OPENS} or b <= {CLOSES}),
seconds as (select distinct start_ust, end_ust, unnest(range(start_ust, end_ust + 1)) as t from (select distinct start_ust, end_ust from entered where starts)),
leaves as (select distinct start_ust from seconds where (t + case when t >= 1711846800 and t < 1729990800 then 7200 else 3600 end) % 86400 in ({CLOSES + 1}, {OPENS - 1})),
out_ as (select e.*, case when starts and l.start_ust is null then 'emit' else 'reference' end as admitted from entered e left join leaves l using (start_ust))"""
)


@query(ZONED_SQL + " select host, item, start_ust, end_ust, value, admitted from out_")
def zoned_daily_window(spark, d):
    return filters.zoned_window(zoned_points(spark, d), OPENS, CLOSES, ZONE).select("host", "item", "start_ust", "end_ust", "value", "admitted")


SLOTS = ["click", "error", "purchase", "signup", "view"]


def slot_samples(spark: SparkSession, d: str) -> DataFrame:
    """Time that two processors spend at each of five frequencies: events of even and odd users so far; now and then a slot without a frequency comes before others."""
    ust = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = ad.table(spark, d, "events").select((F.floor(ust / ad.HOUR) * ad.HOUR).cast("long").alias("ust"), (F.col("user_id") % 2).cast("int").alias("c"), (F.array_position(F.array(*(F.lit(s) for s in SLOTS)), F.col("event_type")) - 1).cast("int").alias("k"))
    ids = rows.select("ust").distinct().withColumn("sample_id", (F.row_number().over(Window.orderBy("ust")) - 1).cast("long"))
    cells = ids.select("ust", "sample_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("c")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    counts = rows.groupBy("ust", "c", "k").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("c", "k").orderBy("ust").rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.join(counts, ["ust", "c", "k"], "left").fillna(0, ["n"])
    frequency = F.when((F.col("sample_id") + F.col("k")) % 7 == 0, 0).otherwise(800000 + F.col("k") * 400000 + F.col("sample_id") % 3 * 500)
    rows = rows.withColumns({"time_in_state": F.sum("n").over(so_far), "freq_khz": frequency})
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("decimal(20,0)").alias("raw")) for f in ("time_in_state", "freq_khz"))))
    item = F.concat(F.when(F.col("c") == 0, "all").otherwise("cpu0"), F.lit("/"), F.col("k").cast("string"))
    rows = rows.select("ust", "sample_id", item.alias("item"), (F.col("c") * 5 + F.col("k")).alias("item_index"), each.alias("x"))
    return rows.select(
        F.lit("h").alias("host"), F.lit(0).cast("long").alias("segment"), "sample_id", "ust", (F.col("ust") * 100).cast("decimal(20,0)").alias("uptime_cs"), F.lit("PWR_FREQ").alias("activity"), "item",
        "x.field", "x.raw", F.lit(64).alias("bits"), "item_index", F.lit(10).alias("item_count"),
    )


@query(f"""with e as (select cast(floor(epoch(ts) / 3600) as bigint) * 3600 as ust, user_id % 2 as c, list_position({SLOTS!r}, event_type) - 1 as k from events),
ids as (select ust, row_number() over (order by ust) - 1 as sample_id from (select distinct ust from e)),
counts as (select ust, c, k, count(*) as n from e group by all),
cells as (select i.*, c, k, coalesce(n, 0) as n from ids i cross join (values (0), (1)) as p(c) cross join (values (0), (1), (2), (3), (4)) as q(k) left join counts using (ust, c, k)),
slots as (select *, case when (sample_id + k) % 7 = 0 then 0 else 800000 + k * 400000 + sample_id % 3 * 500 end as freq from cells),
ended as (select sample_id, c, coalesce(min(k) filter (freq = 0), 5) as stop from slots group by 1, 2)
select case when c = 0 then 'all' else 'cpu0' end as item, cast(sample_id as bigint) as sample_id, case when sample_id > 0 then coalesce(cast(sum(freq // 1000 * n) filter (k < stop) as double) / nullif(sum(n) filter (k < stop), 0), 0.0) end as value,
  case when sample_id = 0 then 'first_sample' end as reason
from slots join ended using (sample_id, c) group by c, sample_id""")
def weighted_mhz_of_slots(spark, d):
    return pt.points(slot_samples(spark, d)).where("field = 'weighted_mhz'").select("item", "sample_id", "value", "reason")
