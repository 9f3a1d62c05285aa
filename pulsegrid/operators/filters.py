"""Which samples, items and columns a report takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.series import series_of

#: Columns that are worked out from others.
DERIVED = ["system", "usr", "nice_excl_gnice", "kbmemused", "memused_pct", "kbmemused_nocache", "memused_nocache_pct", "kbmemfree_withcache", "memused_withcache_pct", "commit_pct", "kbswpused", "swpused_pct", "swpcad_pct", "kbhugused", "hugused_pct", "avg_request_size", "await", "ifutil_pct", "rpm_delta", "temp_pct", "in_pct", "weighted_mhz", "fs_used", "fs_used_pct", "fs_used_pct_unpriv", "inodes_used", "inodes_used_pct", "capacity_per_min"]


def activities(points: DataFrame, names: list[str] | None) -> DataFrame:
    """Points of the named activities; None: of all."""
    return points if names is None else points.where(F.col("activity").isin(names))


def namespace(points: DataFrame, which: str) -> DataFrame:
    """``raw``: columns as sampled; ``derived``: those worked out from others; ``both``."""
    if which not in ("raw", "derived", "both"):
        raise ValueError(f"no such namespace: {which}")
    is_derived = F.col("field").isin(DERIVED)
    return points if which == "both" else points.where(is_derived if which == "derived" else ~is_derived)


def items(points: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Of the activities named in ``wanted`` only the items listed; all items of others."""
    keep = ~F.col("activity").isin(list(wanted))
    for activity, names in wanted.items():
        keep = keep | ((F.col("activity") == activity) & F.col("item").isin(names))
    return points.where(keep)


def retained(points: DataFrame, keys: DataFrame) -> DataFrame:
    """Points of the series named in ``keys``."""
    return points.join(keys, [c for c in series_of(points) if c in keys.columns], "left_semi")


def compat_time_filter(samples: DataFrame, start_s: int, end_s: int, cross_day: bool = False) -> DataFrame:
    """What a start and end time of the day leave of a day's samples in order (ust): after the first that is not before the

    start, which is a reference and gives no row, up to the first beyond the end. ``cross_day``: samples after
    midnight count on from the day before.
    """
    keys = series_of(samples)
    order = Window.partitionBy(*keys).orderBy("ust").rowsBetween(Window.unboundedPreceding, 0)
    tod = F.pmod(F.col("ust"), F.lit(86400))
    rows = samples.withColumn("__t", tod)
    if cross_day:
        back = (F.col("__t") < F.lag("__t").over(Window.partitionBy(*keys).orderBy("ust"))).cast("int")
        rows = rows.withColumn("__d", F.coalesce(back, F.lit(0))).withColumn("__t", F.col("__t") + 86400 * F.least(F.sum("__d").over(order), F.lit(1)))
    rows = rows.withColumn("__in", F.max((F.col("__t") >= start_s).cast("int")).over(order))
    rows = rows.withColumn("__n", F.sum("__in").over(order))
    rows = rows.withColumn("__past", F.max(((F.col("__n") > 1) & (F.col("__t") > end_s)).cast("int")).over(order))
    return rows.where((F.col("__n") > 1) & (F.col("__past") == 0)).drop("__t", "__d", "__in", "__n", "__past")


def _rounded_seconds(hundredths: Column) -> Column:
    f = hundredths.cast("double") / 100.0
    whole = F.floor(f)
    return whole + F.when(f * 10.0 - whole.cast("double") * 10.0 >= 5.0, 1).otherwise(0)


def _int(x: Column) -> Column:
    """As a 32-bit signed number."""
    return F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def thinned(samples: DataFrame, interval_s: int, wraps: bool = True) -> DataFrame:
    """Samples of each segment near a multiple of the interval: one that lies within half the file's own interval.

    Times count from the segment's first sample, which is left out, and are rounded to seconds. ``wraps``: differences
    are taken modulo 2^32 and bounds compared as 32-bit signed numbers, as files' own tools do, so a sample whose uptime
    went back counts as a very long interval. Else both are whole numbers, and near such a sample no multiple lies.
    An interval of 1 keeps all.
    """
    keys = [*series_of(samples), "segment"]
    order = Window.partitionBy(*keys).orderBy("sample_id")
    rows = samples.withColumns({"__ref": F.first("uptime_cs").over(order), "__last": F.lag("uptime_cs").over(order)}).where("__last is not null")
    if interval_s == 1:
        return rows.drop("__ref", "__last")
    since = lambda c: F.pmod(F.col("uptime_cs") - F.col(c), F.lit(1 << 32)) if wraps else F.col("uptime_cs") - F.col(c)
    bound = _int if wraps else lambda x: x
    rows = rows.withColumns({"__step": _rounded_seconds(since("__last")), "__at": _rounded_seconds(since("__ref"))})
    low = bound(F.expr("__at - __step div 2"))
    high = bound(F.expr("__at + __step div 2 + __step % 2"))
    one = F.expr(f"__at div {interval_s} * {interval_s}")
    near = lambda x: (bound(x) >= low) & (bound(x) < high)
    return rows.where(near(one) | near(one + interval_s)).drop("__ref", "__last", "__step", "__at")


def first_samples(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the first ``most`` samples with any item, of each activity and segment."""
    keys = [c for c in ("host", "activity", "segment") if c in rows.columns]
    return rows.withColumn("__r", F.dense_rank().over(Window.partitionBy(*keys).orderBy("sample_id"))).where(F.col("__r") <= most).drop("__r")


def changed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of an item that differ in any of ``columns`` from the item's sample before."""
    order = Window.partitionBy(*[c for c in series_of(rows) if c != "field"]).orderBy("sample_id")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(order))
    first = F.lag("sample_id").over(order).isNull()
    return rows.withColumn("__keep", first | ~same).where("__keep").drop("__keep")


def overlaps_daily_window(spans: DataFrame, start_s: int, end_s: int, zone: str) -> DataFrame:
    """Spans (start_ust, end_ust) that meet the daily window in the time zone's own clock, across changes of it.

    Each local day that a span touches gives one window, from the instant that shows the start to the one
    that shows the end (the earlier of two such starts and the later of two such ends); an end before the
    start is of the next day. Both ends count.
    """
    own = [f"`{c}`" for c in spans.columns]
    day = lambda c: F.to_date(F.from_utc_timestamp(F.timestamp_seconds(c), zone))
    days = F.sequence(F.date_sub(day(F.col("start_ust")), 1), day(F.col("end_ust")))
    rows = spans.withColumn("__day", F.explode(days))
    local = lambda s, d: F.timestamp_seconds(F.unix_date(d).cast("long") * 86400 + s)
    instant = lambda s, d: F.unix_seconds(F.to_utc_timestamp(local(s, d), zone))
    # the same clock time may come twice: look one hour to either side
    shows = lambda t, s, d: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(t), zone)) == F.unix_date(d).cast("long") * 86400 + s
    end_day = F.date_add("__day", 1) if end_s < start_s else F.col("__day")
    opens, closes = instant(start_s, F.col("__day")), instant(end_s, end_day)
    opens = F.when(shows(opens - 3600, start_s, F.col("__day")), opens - 3600).otherwise(opens)
    closes = F.when(shows(closes + 3600, end_s, end_day), closes + 3600).otherwise(closes)
    return rows.where((F.col("start_ust") <= closes) & (F.col("end_ust") >= opens)).select(*own).distinct()


#: Seconds by which clocks are changed; the same clock time may come again so much later.
CLOCK_CHANGES = [0, 3600, -3600, 1800, -1800]


def zoned_window(points: DataFrame, start_s: int, end_s: int, zone: str) -> DataFrame:
    """Points of a daily window of a zone's own clock, seconds of the day from ``start_s`` to ``end_s``, both included.

    ``admitted`` is emit where a point begins and ends in the window without leaving it between, and reference where
    it only ends in it: the sample with which the window is entered counts as a start and gives no value. Others are
    left out. An end before the start crosses midnight; a window of the whole day leaves nothing out. Whether a
    point leaves the window is told by the instants, on the local days that it touches, at which the clock shows the first second
    after the window or the last before it: none where the clock jumps over it, two where it comes again. No row meets another.
    """
    clock = lambda t: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(t), zone))
    within = lambda t: in_clock(F.pmod(clock(t), F.lit(86400)), start_s, end_s)
    start, end = F.col("start_ust"), F.col("end_ust")
    if (end_s - start_s) % 86400 == 86399:
        return points.withColumn("admitted", F.lit("emit"))
    outside = [(end_s + 1) % 86400, (start_s - 1) % 86400]
    days = F.sequence(F.floor(F.least(clock(start), clock(end)) / 86400) - 1, F.floor(F.greatest(clock(start), clock(end)) / 86400) + 1)

    def shown(day: Column) -> Column:
        found = F.lit(False)
        for second in outside:
            local = day * 86400 + second
            instant = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))
            for change in CLOCK_CHANGES:
                t = instant + change
                found = found | ((t >= start) & (t <= end) & (clock(t) == local))
        return found

    inside = within(start) & within(end) & ~F.exists(days, shown)
    return points.where(within(end)).withColumn("admitted", F.when(inside, "emit").otherwise("reference"))


def in_clock(second: Column, start_s: int, end_s: int) -> Column:
    return second.between(start_s, end_s) if start_s <= end_s else (second >= start_s) | (second <= end_s)
