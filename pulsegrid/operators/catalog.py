"""The detection catalog: which series are watched, how, and what their detections say about a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.operators.detect import DEVIATION_RATIO, baselines, level_shifts, shift_windows
from pulsegrid.operators.series import hit_runs, series_of

#: Activity, field, scope (aggregate: item all; single: the activity's only item; each: every item), kind,
#: direction of deviations, least change that matters (absolute, or relative to the centre with a floor, or none),
#: direction of level shifts.
CATALOG = [
    ("CPU", "idle", "aggregate", "counter", "lower", "absolute", 20.0, 0.0, "both"),
    ("CPU", "iowait", "aggregate", "counter", "upper", "absolute", 10.0, 0.0, "upper"),
    ("CPU", "steal", "aggregate", "counter", "upper", "absolute", 5.0, 0.0, "upper"),
    ("CPU", "sys", "aggregate", "counter", "upper", "absolute", 15.0, 0.0, "upper"),
    ("QUEUE", "runq_sz", "single", "gauge", "upper", "absolute", 4.0, 0.0, "upper"),
    ("QUEUE", "blocked", "single", "gauge", "upper", "absolute", 2.0, 0.0, "upper"),
    ("QUEUE", "ldavg_1", "single", "gauge", "upper", "absolute", 2.0, 0.0, "upper"),
    ("QUEUE", "ldavg_15", "single", "gauge", "upper", "absolute", 2.0, 0.0, "upper"),
    ("MEMORY", "kbavail", "single", "gauge", "lower", "relative", 0.3, 262144.0, "lower"),
    ("MEMORY", "memused_pct", "single", "gauge", "upper", "absolute", 10.0, 0.0, "upper"),
    ("MEMORY", "commit_pct", "single", "gauge", "upper", "absolute", 25.0, 0.0, "upper"),
    ("MEMORY", "swpused_pct", "single", "gauge", "upper", "absolute", 10.0, 0.0, "upper"),
    ("SWAP", "pswpin", "single", "counter", "upper", "none", 0.0, 0.0, "upper"),
    ("SWAP", "pswpout", "single", "counter", "upper", "none", 0.0, 0.0, "upper"),
    ("PAGE", "pgscank", "single", "counter", "upper", "none", 0.0, 0.0, "upper"),
    ("PAGE", "pgscand", "single", "counter", "upper", "none", 0.0, 0.0, "upper"),
    ("PAGE", "majflt", "single", "counter", "upper", "relative", 1.0, 10.0, "upper"),
    ("IO", "tps", "single", "counter", "upper", "relative", 0.5, 20.0, "both"),
    ("DISK", "util_pct", "each", "counter", "upper", "absolute", 25.0, 0.0, "both"),
    ("DISK", "await", "each", "gauge", "upper", "relative", 1.0, 10.0, "upper"),
    ("DISK", "avg_queue_size", "each", "counter", "upper", "relative", 1.0, 1.0, "upper"),
    ("DISK", "tps", "each", "counter", "upper", "relative", 0.5, 20.0, "both"),
    ("NET_DEV", "ifutil_pct", "each", "gauge", "upper", "absolute", 25.0, 0.0, "upper"),
    ("NET_DEV", "rx_bytes_per_sec", "each", "counter", "upper", "relative", 1.0, 1048576.0, "both"),
    ("NET_DEV", "tx_bytes_per_sec", "each", "counter", "upper", "relative", 1.0, 1048576.0, "both"),
    ("NET_EDEV", "rxerr_per_sec", "each", "counter", "upper", "none", 0.0, 0.0, "upper"),
    ("NET_EDEV", "txerr_per_sec", "each", "counter", "upper", "none", 0.0, 0.0, "upper"),
    ("NET_EDEV", "rxdrop_per_sec", "each", "counter", "upper", "none", 0.0, 0.0, "upper"),
    ("NET_EDEV", "txdrop_per_sec", "each", "counter", "upper", "none", 0.0, 0.0, "upper"),
    ("NET_SOCK", "totsck", "single", "gauge", "upper", "relative", 0.5, 100.0, "both"),
    ("NET_SOCK", "tcp_tw", "single", "gauge", "upper", "relative", 1.0, 200.0, "upper"),
    ("FS", "fs_used_pct", "each", "gauge", "upper", "absolute", 5.0, 0.0, "upper"),
    ("FS", "inodes_used_pct", "each", "gauge", "upper", "absolute", 5.0, 0.0, "upper"),
    ("KTABLES", "file_nr", "single", "gauge", "upper", "relative", 0.5, 256.0, "upper"),
    ("PCSW", "cswch", "single", "counter", "upper", "relative", 1.0, 1000.0, "both"),
    ("PCSW", "proc", "single", "counter", "upper", "relative", 1.0, 20.0, "both"),
    ("PSI_CPU", "scpu", "single", "counter", "upper", "absolute", 10.0, 0.0, "upper"),
    ("PSI_IO", "sio", "single", "counter", "upper", "absolute", 10.0, 0.0, "upper"),
    ("PSI_IO", "fio", "single", "counter", "upper", "absolute", 5.0, 0.0, "upper"),
    ("PSI_MEM", "smem", "single", "counter", "upper", "absolute", 10.0, 0.0, "upper"),
    ("PSI_MEM", "fmem", "single", "counter", "upper", "absolute", 5.0, 0.0, "upper"),
]
CATALOG_SCHEMA = "activity string, field string, scope string, kind string, deviation string, change string, amount double, change_floor double, shift string"
#: Activity, field, name of the condition, comparison, bound, least number of samples, what it means, priority.
CONDITIONS = [
    ("CPU", "idle", "cpu-idle-exhausted", "at_most", 5.0, 2, "sustained", "watch"),
    ("CPU", "iowait", "cpu-iowait-high", "at_least", 30.0, 2, "sustained", "watch"),
    ("CPU", "steal", "cpu-steal-present", "above", 2.0, 2, "sustained", "watch"),
    ("QUEUE", "blocked", "queue-blocked-present", "above", 0.0, 3, "emergence", "watch"),
    ("MEMORY", "memused_pct", "memory-available-scarce", "at_least", 97.0, 2, "depletion", "watch"),
    ("MEMORY", "swpused_pct", "swap-space-in-use", "above", 1.0, 2, "sustained", "informational"),
    ("SWAP", "pswpin", "swap-in-occurred", "above", 0.0, 1, "emergence", "watch"),
    ("SWAP", "pswpout", "swap-out-occurred", "above", 0.0, 1, "emergence", "informational"),
    ("PAGE", "pgscank", "page-reclaim-kswapd", "above", 0.0, 1, "emergence", "informational"),
    ("PAGE", "pgscand", "page-reclaim-direct", "above", 0.0, 1, "emergence", "investigate"),
    ("DISK", "util_pct", "disk-utilization-saturated", "at_least", 95.0, 2, "sustained", "watch"),
    ("DISK", "await", "disk-latency-high", "at_least", 100.0, 2, "sustained", "watch"),
    ("NET_DEV", "ifutil_pct", "net-interface-saturated", "at_least", 90.0, 2, "sustained", "watch"),
    ("NET_EDEV", "rxerr_per_sec", "net-rx-error-occurred", "above", 0.0, 1, "emergence", "watch"),
    ("NET_EDEV", "txerr_per_sec", "net-tx-error-occurred", "above", 0.0, 1, "emergence", "watch"),
    ("NET_EDEV", "rxdrop_per_sec", "net-rx-drop-occurred", "above", 0.0, 1, "emergence", "informational"),
    ("NET_EDEV", "txdrop_per_sec", "net-tx-drop-occurred", "above", 0.0, 1, "emergence", "watch"),
    ("FS", "fs_used_pct", "filesystem-nearly-full", "at_least", 95.0, 1, "depletion", "investigate"),
    ("FS", "inodes_used_pct", "filesystem-inodes-nearly-exhausted", "at_least", 95.0, 1, "depletion", "investigate"),
    ("PSI_CPU", "scpu", "psi-cpu-some-stalled", "at_least", 20.0, 2, "sustained", "watch"),
    ("PSI_IO", "fio", "psi-io-full-stalled", "above", 1.0, 2, "sustained", "investigate"),
    ("PSI_MEM", "fmem", "psi-mem-full-stalled", "above", 1.0, 2, "sustained", "investigate"),
]
CONDITION_SCHEMA = "activity string, field string, condition string, comparison string, bound double, min_samples int, meaning string, priority string"
#: The order of priorities.
PRIORITIES = ["informational", "watch", "investigate"]
KEPT_OBSERVATIONS = 8


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, CATALOG_SCHEMA).coalesce(1)


def conditions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONDITIONS, CONDITION_SCHEMA).coalesce(1)


def watched(points: DataFrame) -> DataFrame:
    """Points of the catalog's series with what it says of them. An activity's aggregate item is watched only where the scope says so."""
    known = F.broadcast(catalog(points.sparkSession))  # 41 rows
    scope = F.when(F.col("scope") == "aggregate", F.col("item") == "all").when(F.col("scope") == "single", F.col("item") == "-").otherwise(F.col("item") != "all")
    return points.join(known, ["activity", "field"]).where(scope)


def absent(points: DataFrame) -> DataFrame:
    """The catalog's series (activity, field) that a host of ``points`` doesn't have."""
    hosts = points.select("host").distinct()
    every = hosts.crossJoin(F.broadcast(catalog(points.sparkSession).select("activity", "field")))  # hosts by 41 rows
    return every.join(watched(points).select("host", "activity", "field").distinct(), ["host", "activity", "field"], "left_anti")


def origin(activity: Column, field: Column, kind: Column) -> Column:
    """How values come about: from an interval's counters, at an instant, or as a mean over requests."""
    per_request = (activity == "DISK") & (field == "await")
    return F.when(per_request, "per_request_average").when((kind == "counter") | (field == "ifutil_pct"), "interval_rate").otherwise("instant_gauge")


def satisfies(value: Column, comparison: Column, bound: Column) -> Column:
    return F.when(comparison == "at_least", value >= bound).when(comparison == "at_most", value <= bound).otherwise(value > bound)


def fixed_conditions(points: DataFrame) -> DataFrame:
    """Runs of at least ``min_samples`` adjacent points of watched series that satisfy a condition."""
    known = F.broadcast(conditions(points.sparkSession))  # 22 rows
    rows = watched(points).drop("scope", "kind", "deviation", "change", "amount", "change_floor", "shift").join(known, ["activity", "field"])
    runs = hit_runs(rows, satisfies(F.col("value"), F.col("comparison"), F.col("bound")))
    named = runs.join(F.broadcast(conditions(points.sparkSession).drop("comparison", "bound")), ["activity", "field"])
    return named.where(F.col("points") >= F.col("min_samples"))


def change_floor(centre: Column, change: Column, amount: Column, floor: Column) -> Column:
    """The least distance from the centre that matters; null where none is declared."""
    return F.when(change == "absolute", amount).when(change == "relative", F.greatest(F.abs(centre) * amount, floor))


def departures(points: DataFrame, ratio: float = DEVIATION_RATIO) -> DataFrame:
    """Runs of points that lie far from their series' median in a direction that matters: ``route`` and ``shape``.

    robust: by ``ratio`` MADs and the least change that matters, where the dispersion is measured. absolute:
    by the least change alone, where it is not measurable or too sparse and such a change is declared.
    """
    rows = watched(points)
    keys = series_of(rows)
    rows = rows.join(baselines(rows).select(*keys, "median", "mad", "state"), keys)
    apart = F.col("value") - F.col("median")
    floor = change_floor(F.col("median"), F.col("change"), F.col("amount"), F.col("change_floor"))
    meant = F.when(F.col("deviation") == "upper", apart > 0).when(F.col("deviation") == "lower", apart < 0).otherwise(apart != 0)
    robust = (F.col("state") == "measured") & (F.abs(apart) >= ratio * F.col("mad")) & (F.abs(apart) >= F.coalesce(floor, F.lit(0.0)))
    absolute = F.col("state").isin("not_measurable", "too_sparse") & (floor > 0) & (F.abs(apart) >= floor)
    runs = hit_runs(rows, meant & (robust | F.coalesce(absolute, F.lit(False))), ["median", "state"])
    shape = F.when(F.col("max_value") > F.col("median"), "spike").otherwise("dip")
    return runs.withColumns({"route": F.when(F.col("state") == "measured", "robust").otherwise("absolute"), "shape": shape}).drop("state")


def shift_points(points: DataFrame) -> DataFrame:
    """Points of watched series with what ``detect.level_shifts`` asks for."""
    rows = watched(points)
    return rows.withColumn("instant", origin(F.col("activity"), F.col("field"), F.col("kind")) == "instant_gauge")


def level_shift_route(points: DataFrame) -> DataFrame:
    """Level shifts of watched series in the catalog's directions, by its least changes."""
    return level_shifts(shift_points(points)).withColumn("route", F.lit("level_shift"))


#: Reasons why a route is not taken that lie in the catalog or the selection, not in the data.
BY_DESIGN = ["excluded_by_selection", "no_fixed_condition_declared", "no_deviation_interest_declared", "level_shift_not_declared"]
ROUTES = ["fixed", "robust", "absolute", "level_shift"]


def route_status(points: DataFrame, found: DataFrame, routes: list[str] = ROUTES, selected: list[str] | None = None) -> DataFrame:
    """A row per host, series that is watched or should be, and route: ``status`` with ``reason``, ``count`` and ``blind_edges``.

    detected; evaluated, or evaluated_with_blind_edges (level shifts: points too near an end of a segment for
    windows on both sides); or not_evaluated, why: the series is absent from the source (item and all: null), its
    activity isn't among ``selected``, it has no value, no condition or direction or level shift is declared, its
    dispersion can't be measured or is too sparse, it has too few samples, no segment is long enough for windows,
    or all windows span missing samples. ``found``: detections (series, route).
    """
    rows = watched(points)
    keys = series_of(rows)
    known = rows.groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("deviation", "change")))
    missing = absent(points).join(F.broadcast(catalog(points.sparkSession).select("activity", "field", "deviation", "change")), ["activity", "field"])  # 41 rows
    conditioned = F.broadcast(conditions(points.sparkSession).select("activity", "field").distinct().withColumn("condition", F.lit(True)))  # 22 rows
    windows = shift_windows(shift_points(points)).groupBy(*keys).agg(F.sum("joined").alias("joined"), F.sum("candidates").alias("candidates"), F.sum("blind").alias("blind"))
    seen = known.join(baselines(rows).select(*keys, "n", "state"), keys, "left").join(windows, keys, "left").withColumn("present", F.lit(True))
    seen = seen.unionByName(missing, allowMissingColumns=True).join(conditioned, ["activity", "field"], "left")
    each = seen.withColumn("route", F.explode(F.array(*(F.lit(r) for r in routes))))
    counts = found.groupBy(*keys, "route").agg(F.count("*").alias("count"))
    each = each.join(counts, [*keys, "route"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    route, state, shifts = F.col("route"), F.col("state"), F.col("route") == "level_shift"
    chosen = F.col("activity").isin(selected) if selected is not None else F.lit(True)
    why = (
        F.when(~chosen, "excluded_by_selection")
        .when(F.col("present").isNull(), "series_absent_from_source")
        .when((route == "fixed") & F.col("condition").isNull(), "no_fixed_condition_declared")
        .when(route.isin("robust", "absolute") & (F.col("deviation") == "none"), "no_deviation_interest_declared")
        .when(shifts & (F.col("change") == "none"), "level_shift_not_declared")
        .when(F.coalesce("n", F.lit(0)) == 0, "no_usable_observation")
        .when(route.isin("robust", "absolute") & (state == "insufficient_samples"), "too_few_baseline_samples")
        .when((route == "robust") & (state == "not_measurable"), "dispersion_not_measurable")
        .when((route == "robust") & (state == "too_sparse"), "dispersion_too_sparse")
        .when((route == "absolute") & (F.col("change") == "none"), "no_magnitude_floor_declared")
        .when(shifts & (F.coalesce("joined", F.lit(0)) == 0), F.when(F.coalesce("candidates", F.lit(0)) > 0, "window_spans_missing_samples").otherwise("no_window_long_enough"))
    )
    out = each.withColumn("reason", why)
    blind = F.when(shifts & F.col("reason").isNull(), F.coalesce("blind", F.lit(0))).otherwise(0)
    status = F.when(F.col("reason").isNotNull(), "not_evaluated").when(F.col("count") > 0, "detected").when(blind > 0, "evaluated_with_blind_edges").otherwise("evaluated")
    return out.select(*keys, "route", status.alias("status"), "reason", "count", blind.alias("blind_edges"))


def coverage_tally(statuses: DataFrame) -> DataFrame:
    """Of each host and route how many series were evaluated, how many found something, and how many were kept out by data or by design."""
    status, reason = F.col("status"), F.col("reason")
    return statuses.groupBy("host", "route").agg(
        F.count("*").alias("series"),
        F.count_if(status != "not_evaluated").alias("evaluated"),
        F.count_if(status == "detected").alias("detected"),
        F.count_if(reason.isNotNull() & ~reason.isin(BY_DESIGN)).alias("blocked"),
        F.count_if(reason.isin(BY_DESIGN)).alias("by_design"),
    )


def support(points: DataFrame) -> DataFrame:
    """The time that a series' observations cover: for gauges from the first sample to the last, without a duration; else all intervals."""
    rows = watched(points).where(F.col("value").isNotNull())
    instant = origin(F.col("activity"), F.col("field"), F.col("kind")) == "instant_gauge"
    start = F.when(instant, F.col("end_ust")).otherwise(F.col("start_ust"))
    return rows.groupBy(*series_of(rows)).agg(F.min(start).alias("first_ust"), F.max("end_ust").alias("last_ust"), F.sum(F.when(instant, F.lit(0)).otherwise(F.col("elapsed_cs"))).alias("observed_cs"), F.count("*").alias("samples"))


def ordinal(priority: Column) -> Column:
    return F.coalesce(*(F.when(priority == p, i) for i, p in enumerate(PRIORITIES)))


def at_least_priority(found: DataFrame, least: str) -> DataFrame:
    return found.where(ordinal(F.col("priority")) >= PRIORITIES.index(least))


def in_report_window(found: DataFrame, start: Column, end: Column) -> DataFrame:
    """Detections whose time overlaps the window; both ends count."""
    return found.where((F.col("start_ust") <= end) & (F.col("end_ust") >= start))


def scope_counts(found: DataFrame, start: Column, end: Column, least: str) -> DataFrame:
    """One row: detections of the whole input, of the window, and of those left by the priority."""
    inside = (F.col("start_ust") <= end) & (F.col("end_ust") >= start)
    return found.agg(F.count("*").alias("in_input"), F.count_if(inside).alias("in_window"), F.count_if(inside & (ordinal(F.col("priority")) >= PRIORITIES.index(least))).alias("reported"))


def corroborated(shifts: DataFrame, found: DataFrame) -> DataFrame:
    """Level shifts (series, start_ust, end_ust) that another detection of the same series overlaps; both ends count."""
    keys = series_of(shifts)
    other = found.select(*keys, F.col("start_ust").alias("o_start"), F.col("end_ust").alias("o_end"))
    # closed intervals meet iff one begins within the other: the latest end of what began before tells it without pairs
    marks = shifts.select(*keys, F.col("end_ust").alias("t"), F.lit(1).alias("probe"), "start_ust", "end_ust").unionByName(other.select(*keys, F.col("o_start").alias("t"), F.lit(0).alias("probe"), "o_end"), allowMissingColumns=True)
    past = Window.partitionBy(*keys).orderBy("t", "probe").rowsBetween(Window.unboundedPreceding, 0)
    reach = marks.withColumn("reach", F.max("o_end").over(past)).where("probe = 1")
    return reach.where("reach >= start_ust").select(*keys, "start_ust", "end_ust")


def episode_leads(found: DataFrame) -> DataFrame:
    """Of each episode (host, episode) the detection that stands for it: by priority, base, samples, span, then name."""
    keys = [c for c in series_of(found) if c != "host"]
    order = Window.partitionBy("host", "episode").orderBy(F.col("priority").desc(), F.col("base").desc(), F.col("points").desc(), (F.col("end_ust") - F.col("start_ust")).desc(), *keys, "start_ust")
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def ranked_groups(found: DataFrame, group: list[str], most: int = 5, onsets: int = 3) -> DataFrame:
    """Groups of a host's detections by priority, size and name: the first ``most``, each with its first ``onsets`` onsets."""
    inner = Window.partitionBy("host", *group).orderBy("start_ust")
    rows = found.withColumn("k", F.row_number().over(inner))
    sizes = rows.groupBy("host", *group).agg(F.max("priority").alias("priority"), F.count("*").alias("size"), F.sort_array(F.collect_list(F.when(F.col("k") <= onsets, F.col("start_ust")))).alias("onsets"))
    order = Window.partitionBy("host").orderBy(F.col("priority").desc(), F.col("size").desc(), *group)
    return sizes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def kept_observations(points: DataFrame, hit: Column, most: int = KEPT_OBSERVATIONS) -> DataFrame:
    """Runs of ``hit`` with their first ``most`` values, in order."""
    keys = series_of(points)
    runs = hit_runs(points, hit).select(*keys, F.col("start_ust").alias("run_start"), "end_ust", F.col("points").alias("n"))
    rows = points.where(hit & F.col("value").isNotNull() & (F.col("elapsed_cs") > 0))
    order = Window.partitionBy(*keys).orderBy("end_ust")
    new = F.coalesce(F.col("start_ust") != F.lag("end_ust").over(order), F.lit(True)).cast("int")
    rows = rows.withColumn("new", new).withColumn("run", F.sum("new").over(order))
    inner = Window.partitionBy(*keys, "run").orderBy("end_ust")
    rows = rows.withColumn("k", F.row_number().over(inner)).where(F.col("k") <= most)
    few = rows.groupBy(*keys, "run").agg(F.min("start_ust").alias("run_start"), F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("kept"))
    return runs.join(few.drop("run"), [*keys, "run_start"])


def sorted_detections(found: DataFrame) -> DataFrame:
    return found.orderBy("start_ust", *series_of(found), "route")
