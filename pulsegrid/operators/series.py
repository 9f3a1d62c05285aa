"""Operators on points: one row per series and interval (host, activity, item, field, segment, start_ust, end_ust, elapsed_cs, value, reason).

A series is named by those of the columns of ``SERIES`` that a table has: the reader's samples have all
four, tables of one activity and field may leave these out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import counters

SERIES = ["host", "activity", "item", "field"]


def series_of(rows: DataFrame) -> list[str]:
    """The columns that name a series of ``rows``."""
    return [c for c in SERIES if c in rows.columns]


def deltas(samples: DataFrame, raw: str = "raw", bits: str = "bits") -> DataFrame:
    """Each sample against the one before of its series: delta, wrapped, reason, elapsed_cs.

    Rows with a reason have no delta. A series that misses the sample before counts as replaced, and so
    does one that begins after the first sample of its host's activity (the least of a group, one row for
    each, which Spark broadcasts where it is small). Equal uptimes and ones that go back have no length.
    """
    keys = series_of(samples)
    group = [c for c in ("host", "activity") if c in keys]
    order = Window.partitionBy(*keys).orderBy("sample_id")
    before = {c: F.lag(c).over(order) for c in (raw, "uptime_cs", "segment", "sample_id", "ust")}
    rows = samples.withColumns({f"__{c}": x for c, x in before.items()})
    rows = rows.join(samples.groupBy(*group).agg(F.min("sample_id").alias("__least")), group)
    alone = F.col("__sample_id").isNull()
    first = alone & (F.col("sample_id") == F.col("__least"))
    restart = ~alone & (F.col("__segment") != F.col("segment"))
    replaced = alone | (F.col("__sample_id") != F.col("sample_id") - 1)
    elapsed = F.when(first | restart | replaced, F.lit(0).cast("long")).otherwise(counters.native_interval_cs(F.col("uptime_cs"), F.col("__uptime_cs")))
    found = counters.classified_delta(F.col(raw), F.col(f"__{raw}"), F.col(bits), first, restart, replaced, F.col("elapsed_cs"))
    rows = rows.withColumn("elapsed_cs", elapsed).withColumn("d", found).drop("__least").withColumns({"start_ust": F.coalesce("__ust", "ust"), "end_ust": F.col("ust"), "delta": F.col("d.delta"), "wrapped": F.col("d.wrapped"), "reason": F.col("d.reason")})
    return rows.drop("d", *(f"__{c}" for c in before))


def rates(points: DataFrame) -> DataFrame:
    """``value``: units a second; null where ``reason`` says why."""
    return points.withColumn("value", F.when(F.col("reason").isNull(), counters.per_second(F.col("delta"), F.col("elapsed_cs"))))


def with_segments(points: DataFrame) -> DataFrame:
    """``run_segment``: counts on where a point doesn't start at the end of the one before, or a discontinuity stands."""
    order = Window.partitionBy(*series_of(points)).orderBy("end_ust")
    cut = F.coalesce(F.col("start_ust") != F.lag("end_ust").over(order), F.lit(True)) | (F.col("elapsed_cs") <= 0)
    return points.withColumn("__cut", cut.cast("int")).withColumn("run_segment", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__cut")


def hit_runs(points: DataFrame, hit: Column, carry: list[str] | None = None) -> DataFrame:
    """Maximal runs of adjacent points that hold ``hit``: start, end, points, seconds, least and greatest value.

    ``carry``: columns that are the same for all points of a series, and come along.
    """
    order = Window.partitionBy(*series_of(points)).orderBy("end_ust")
    rows = points.where(hit & F.col("value").isNotNull() & (F.col("elapsed_cs") > 0))
    new = F.coalesce(F.col("start_ust") != F.lag("end_ust").over(order), F.lit(True))
    rows = rows.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*series_of(points), "__run").agg(
        F.min("start_ust").alias("start_ust"),
        F.max("end_ust").alias("end_ust"),
        F.count("*").alias("points"),
        (F.max("end_ust") - F.min("start_ust")).alias("seconds"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        (F.sum(F.col("value") * F.col("elapsed_cs")) / F.sum("elapsed_cs")).alias("mean_value"),
        *(F.first(c).alias(c) for c in carry or []),
    ).drop("__run")


def longest_run(points: DataFrame, hit: Column) -> DataFrame:
    """The longest run of each series; the earliest on ties."""
    rank = Window.partitionBy(*series_of(points)).orderBy(F.col("seconds").desc(), "start_ust")
    return hit_runs(points, hit).withColumn("__r", F.row_number().over(rank)).where("__r = 1").drop("__r")


def first_at(value: str, order: str, greatest: bool) -> Column:
    """The time of the greatest (or least) value, the first on ties."""
    key = F.struct(F.col(value), -F.col(order)) if greatest else F.struct(-F.col(value), -F.col(order))
    return F.max_by(F.col(order), F.when(F.col(value).isNotNull(), key))


def summarize(points: DataFrame) -> DataFrame:
    """A row per series: period rate over valid intervals, means, extrema with their first time, last value, coverage."""
    valid = F.col("value").isNotNull()
    seconds = lambda c: F.coalesce(F.sum(F.when(c, F.col("elapsed_cs"))), F.lit(0))
    return points.groupBy(*series_of(points)).agg(
        F.count("*").alias("points"),
        F.count("value").alias("observed"),
        (F.count("*") - F.count("value")).alias("missing"),
        seconds(valid).alias("observed_cs"),
        seconds(~valid).alias("missing_cs"),
        F.min("start_ust").alias("first_ust"),
        F.max("end_ust").alias("last_ust"),
        F.max("value").alias("max_value"),
        first_at("value", "end_ust", True).alias("max_ust"),
        F.min("value").alias("min_value"),
        first_at("value", "end_ust", False).alias("min_ust"),
        F.max_by("value", F.when(valid, F.col("end_ust"))).alias("last_value"),
    )


def period_rate(points: DataFrame) -> DataFrame:
    """Sum of deltas over sum of their time: not a mean of rates."""
    ok = F.col("reason").isNull()
    num, den = F.sum(F.when(ok, F.col("delta"))), F.sum(F.when(ok, F.col("elapsed_cs")))
    return points.groupBy(*series_of(points)).agg(num.alias("delta_sum"), den.alias("elapsed_cs"), counters.per_second(num, den).alias("rate"))


def weighted_percentile(points: DataFrame, q: float, weight: str, cap: int | None = None) -> DataFrame:
    """Exact weighted nearest rank: the first value whose running weight reaches ceil(q * total). Above ``cap`` values, if given: null.

    ``q`` is in thousandths, so the rank is computed in whole numbers.
    """
    thousandths = round(q * 1000)
    rows = points.where(F.col("value").isNotNull() & (F.col(weight) > 0))
    by_value = rows.groupBy(*series_of(points), "value").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    order = Window.partitionBy(*series_of(points)).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*series_of(points))
    ranked = by_value.withColumns({"run": F.sum("w").over(order), "total": F.sum("w").over(whole), "all": F.sum("n").over(whole)})
    need = F.floor((F.col("total") * thousandths + 999) / 1000)
    return ranked.groupBy(*series_of(points)).agg(F.when(F.lit(cap is None) | (F.max("all") <= (cap or 0)), F.min(F.when(F.col("run") >= need, F.col("value")))).alias("percentile"))


def in_daily_window(ust: Column, start_s: int, end_s: int) -> Column:
    """Seconds of the day from start to end, both included; an end before the start crosses midnight."""
    tod = F.pmod(ust, F.lit(86400))
    return ((tod >= start_s) & (tod <= end_s)) if start_s <= end_s else ((tod >= start_s) | (tod <= end_s))


def daily_window(points: DataFrame, start_s: int, end_s: int) -> DataFrame:
    """Points that lie wholly in the window; the first sample of each entry is a reference and gives no point."""
    span = (end_s - start_s) % 86400
    inside = in_daily_window(F.col("start_ust"), start_s, end_s) & in_daily_window(F.col("end_ust"), start_s, end_s)
    return points.where(inside & (F.col("end_ust") - F.col("start_ust") <= span))


def align(points: DataFrame, start: Column, end: Column, step: int) -> DataFrame:
    """Overlap-weighted means on a grid from ``start`` to ``end``; the last bucket may be short. Buckets without a value are absent."""
    cut = points.where(F.col("value").isNotNull()).withColumns({"lo": F.greatest("start_ust", start), "hi": F.least("end_ust", end), "g0": start, "g1": end}).where("lo < hi")
    number = lambda c: F.floor((c - F.col("g0")) / step).cast("long")
    rows = cut.withColumn("bucket", F.explode(F.sequence(number(F.col("lo")), number(F.col("hi") - 1))))
    b0 = F.col("g0") + F.col("bucket") * step
    weight = F.least("hi", F.least(b0 + step, F.col("g1"))) - F.greatest("lo", b0)
    rows = rows.withColumn("w", weight)
    return rows.groupBy(*series_of(points), "bucket").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"), F.sum("w").cast("long").alias("overlap_s"))


def hold_last(buckets: DataFrame, limit: int) -> DataFrame:
    """Fills up to ``limit`` buckets after a value with it; expects a row per bucket, null where nothing was seen."""
    order = Window.partitionBy(*series_of(buckets)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("value").isNotNull(), F.struct("bucket", "value")), ignorenulls=True).over(order)
    rows = buckets.withColumn("__s", seen)
    return rows.withColumn("filled", F.when(F.col("bucket") - F.col("__s.bucket") <= limit, F.col("__s.value"))).drop("__s")


def linear_fill(buckets: DataFrame, limit: int) -> DataFrame:
    """Straight lines over gaps of at most ``limit`` buckets."""
    w = Window.partitionBy(*series_of(buckets)).orderBy("bucket")
    known = F.when(F.col("value").isNotNull(), F.struct("bucket", "value"))
    rows = buckets.withColumns({"__a": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__b": F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    gap = F.col("__b.bucket") - F.col("__a.bucket")
    line = F.col("__a.value") + (F.col("__b.value") - F.col("__a.value")) * (F.col("bucket") - F.col("__a.bucket")) / gap
    return rows.withColumn("filled", F.coalesce("value", F.when(gap - 1 <= limit, line))).drop("__a", "__b")


def merged_windows(spans: DataFrame, context: int) -> DataFrame:
    """Spans (item, start_ust, end_ust) widened by ``context`` seconds, overlapping ones as one."""
    rows = spans.withColumns({"lo": F.col("start_ust") - context, "hi": F.col("end_ust") + context})
    w = Window.partitionBy(*series_of(spans)).orderBy("lo", "hi")
    past = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__n", F.coalesce(F.col("lo") > past, F.lit(True)).cast("int"))
    rows = rows.withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*series_of(spans), "__g").agg(F.min("lo").alias("start_ust"), F.max("hi").alias("end_ust"), F.count("*").alias("spans")).drop("__g")


def rollup(points: DataFrame) -> DataFrame:
    """Coverage by activity, by item of it and by field of that: ``level`` 1 to 3 and nulls below it; level 0 is the whole."""
    out = points.rollup("activity", "item", "field").agg(
        (F.lit(3) - F.bit_count(F.grouping_id())).cast("int").alias("level"),
        F.count("*").alias("points"),
        F.count("value").alias("observed"),
        F.min("start_ust").alias("first_ust"),
        F.max("end_ust").alias("last_ust"),
    )
    return out


def integer_mean(points: DataFrame, value: str) -> DataFrame:
    """Means of whole numbers as old reports give them: divided as integers, towards zero."""
    total, n = F.sum(F.col(value).cast("long")), F.count(value)
    return points.groupBy(*series_of(points)).agg((F.signum(total) * F.floor(F.abs(total) / n)).cast("long").alias("mean"))


def carried_counts(activities: DataFrame) -> DataFrame:
    """``denominator`` of the mean values of each activity that printed rows: host, activity, position (in the report), samples, rows.

    A report counts the samples of each activity and begins anew only where it has printed an average: the count of
    an activity that printed no row stays and adds to that of the next one that does.
    """
    order = Window.partitionBy("host").orderBy("position")
    block = F.coalesce(F.count_if(F.col("rows") > 0).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = activities.withColumn("__block", block)
    so_far = Window.partitionBy("host", "__block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("denominator", F.sum("samples").over(so_far)).where("rows > 0").drop("__block")


def average_rows(points: DataFrame, counted: DataFrame) -> DataFrame:
    """Mean of each gauge of ``points`` over the samples that its report counted: not those of the item, but all of its activity,

    and what was left over before. ``counted``: the activities of a host's report (host, activity, position, samples).
    """
    sums = points.where(F.col("value").isNotNull()).groupBy(*series_of(points)).agg(F.sum("value").alias("total"), F.count("*").alias("observed"))
    rows = sums.groupBy("host", "activity").agg(F.sum("observed").alias("rows"))
    known = carried_counts(counted.join(rows, ["host", "activity"], "left").withColumn("rows", F.coalesce("rows", F.lit(0))))
    means = sums.join(known.select("host", "activity", "denominator"), ["host", "activity"])
    return means.select(*series_of(points), "observed", "denominator", F.try_divide(F.col("total"), F.col("denominator").cast("double")).alias("average"))


#: Reasons that concern every series of a host.
WHOLE_HOST = ["restart", "file_boundary_unverified", "layout_changed"]


def marks(points: DataFrame) -> DataFrame:
    """Discontinuities of hosts as a whole, each once: host, ust, reason."""
    return points.where(F.col("reason").isin(WHOLE_HOST)).select("host", F.col("end_ust").alias("ust"), "reason").distinct()
