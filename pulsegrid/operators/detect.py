"""Rules and anomaly detection on points."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.series import hit_runs, series_of

#: Defaults of the detector.
DEVIATION_RATIO = 8.0
LEAST_SAMPLES = 12
OFF_CENTRE_PERCENT = 20
SHIFT_SECONDS, SHIFT_POINTS, SHIFT_NORMALIZED, PERSISTENCE, MAD_SCALE = 1800, 5, 3.0, 0.7, 1.4826
GAP_FACTOR, GAP_CAP = 2, 1800
STANDING_PERCENT = 90
PROMOTION_SAMPLES, PROMOTION_SECONDS = 3, 1800


def baselines(points: DataFrame) -> DataFrame:
    """Median, raw MAD and the state of the dispersion of each series: too few samples, flat, too sparse or measured.

    Exact, from counts by value: a series' different values are ranked by running sums, once by value and once by their
    distance from the median. No aggregate keeps them; the windows' rows are sorted, and spilled where there are many.
    """
    keys = series_of(points)
    whole = Window.partitionBy(*keys)
    ranks = [F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1]

    def middle(value: str, run: str) -> Column:
        low, high = (F.min(F.when(F.col(run) >= rank, F.col(value))).over(whole) for rank in ranks)
        return (low + high) / 2

    running = lambda by: F.sum("__c").over(whole.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    counts = points.where(F.col("value").isNotNull()).groupBy(*keys, "value").agg(F.count("*").alias("__c"))
    ranked = counts.withColumns({"n": F.sum("__c").over(whole), "__run": running("value")}).withColumn("median", middle("value", "__run"))
    apart = ranked.withColumn("__apart", F.abs(F.col("value") - F.col("median")))
    apart = apart.withColumn("__run", running("__apart")).withColumn("mad", middle("__apart", "__run"))
    out = apart.groupBy(*keys, "n", "median", "mad").agg(F.coalesce(F.sum(F.when(F.col("__apart") > 0, F.col("__c"))), F.lit(0)).alias("off_centre"))
    needed = F.floor((F.col("n") * OFF_CENTRE_PERCENT + 99) / 100)
    state = F.when(F.col("n") < LEAST_SAMPLES, "insufficient_samples").when(F.col("mad") == 0, "not_measurable").when(F.col("off_centre") < needed, "too_sparse").otherwise("measured")
    return out.withColumn("state", state)


def deviations(points: DataFrame, floor: float, ratio: float = DEVIATION_RATIO) -> DataFrame:
    """Runs of points whose distance from the median is ``ratio`` MADs and ``floor`` or more, for measured series."""
    known = baselines(points).where("state = 'measured'").select(*series_of(points), "median", "mad")
    rows = points.join(known, series_of(points))
    apart = F.abs(F.col("value") - F.col("median"))
    return hit_runs(rows, (apart >= ratio * F.col("mad")) & (apart >= floor))


def absolute_departures(points: DataFrame, floor: float) -> DataFrame:
    """The same by the floor alone, where no dispersion can be measured."""
    known = baselines(points).where("state in ('not_measurable', 'too_sparse')").select(*series_of(points), "median")
    return hit_runs(points.join(known, series_of(points)), F.abs(F.col("value") - F.col("median")) >= floor)


def window_shifts(points: DataFrame, width: int, least: float) -> DataFrame:
    """Splits whose ``width`` points after differ in their median by ``least`` or more from those before; the best of each run of splits.

    All 2 * width points must follow each other in time.
    """
    order = Window.partitionBy(*series_of(points)).orderBy("end_ust")
    rows = points.where(F.col("value").isNotNull())
    rows = rows.withColumns(
        {
            "before": F.collect_list("value").over(order.rowsBetween(-width, -1)),
            "after": F.collect_list("value").over(order.rowsBetween(0, width - 1)),
            "from_ust": F.first("start_ust").over(order.rowsBetween(-width, -1)),
            "to_ust": F.last("end_ust").over(order.rowsBetween(0, width - 1)),
            "gaps": F.sum(F.col("end_ust") - F.col("start_ust")).over(order.rowsBetween(-width, width - 1)),
            "n": F.row_number().over(order),
        }
    )
    middle = lambda a: (F.get(F.array_sort(a), F.lit((width - 1) // 2)) + F.get(F.array_sort(a), F.lit(width // 2))) / 2
    full = rows.where((F.size("before") == width) & (F.size("after") == width) & (F.col("gaps") == F.col("to_ust") - F.col("from_ust")))
    full = full.withColumns({"level_before": middle("before"), "level_after": middle("after")}).withColumn("shift", F.col("level_after") - F.col("level_before"))
    hits = full.where(F.abs("shift") >= least).select(*series_of(points), "n", "start_ust", "level_before", "level_after", "shift")
    island = F.col("n") - F.row_number().over(Window.partitionBy(*series_of(points)).orderBy("n"))
    best = Window.partitionBy(*series_of(points), "island").orderBy(F.abs("shift").desc(), "n")
    return hits.withColumn("island", island).withColumn("r", F.row_number().over(best)).where("r = 1").select(*series_of(points), "start_ust", "level_before", "level_after", "shift")


def standing(found: DataFrame, first_ust: Column, last_ust: Column) -> DataFrame:
    """``standing``: a detection over at least 90 % of the input is background, but a level shift never is; an input without a span has none."""
    span = last_ust - first_ust
    share = F.floor(F.try_divide((F.col("end_ust") - F.col("start_ust")) * 100, span))
    local = F.col("route") == "level_shift" if "route" in found.columns else F.lit(False)
    return found.withColumn("standing", ~local & F.coalesce(share >= STANDING_PERCENT, F.lit(False)))


def episode_limits(points: DataFrame) -> DataFrame:
    """One row: ``gap_s``, twice the 90th percentile of the sampling interval but 1800 s at most, and ``span_cap_s``,

    a quarter of the input's span or four gaps, whichever is longer.
    """
    step = F.col("end_ust") - F.col("start_ust")
    steps = points.where(step > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n"))  # few different lengths
    order = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.withColumns({"run": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy())})
    p90 = ranked.agg(F.min(F.when(F.col("run") * 10 >= F.col("all") * 9, F.col("step"))).alias("p90"))
    span = points.agg((F.max("end_ust") - F.min("start_ust")).alias("span"))
    gap = F.least(F.col("p90") * GAP_FACTOR, F.lit(GAP_CAP))
    return p90.crossJoin(span).select(gap.alias("gap_s"), F.greatest(F.floor(F.col("span") / 4), gap * 4).alias("span_cap_s"))  # one row each


def marks_of_stretches(spans: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks that lie after the beginning of a host's stretch (host, stretch, lo, hi) and not after its end: by days, so few meet that don't belong together."""
    day = lambda c: F.floor(F.col(c) / 86400)
    days = spans.withColumn("day", F.explode(F.sequence(day("lo"), day("hi"))))
    return days.join(marks.withColumn("day", day("ust")), ["host", "day"]).where("ust > lo and ust <= hi").drop("day", "lo", "hi")


#: Detections that one call folds, besides the rest of the last one's stretch.
FOLDED = 10_000


def episodes(found: DataFrame, gap_s: int, span_cap_s: int, marks: DataFrame | None = None) -> DataFrame:
    """Groups detections of a host by onset. A new episode begins where the next onset is later than ``gap_s`` after

    the last one or ``span_cap_s`` after the episode's first, or where one of ``marks`` lies after the episode's first
    onset and not after the end of what it would cover. ``marks`` have host and ust; those that name a series (any of
    activity, item, field not null) stand in the way only of episodes that hold it, or would then; others of all.
    Stretches without a gap are told by a window over the host's detections; as cap, marks and series depend on where an
    episode began, each stretch is folded in order, with the marks of its time. Stretches are short and many, so whole
    blocks of them go through one call. ``episode`` counts within the host.
    """
    keys = series_of(found)
    rest = [c for c in keys if c != "host"]
    order = Window.partitionBy("host").orderBy("start_ust", "end_ust", *rest)
    rows = found.select(*keys, "start_ust", "end_ust").distinct()
    cut = F.coalesce(F.col("start_ust") - F.lag("start_ust").over(order) > gap_s, F.lit(True))
    rows = rows.withColumns({"cut": cut, "n": F.row_number().over(order)})
    begun = F.max(F.when(F.col("cut"), F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("stretch", begun.cast("long")).withColumn("block", F.floor(F.col("stretch") / FOLDED)).drop("cut")
    kinds = dict(rows.dtypes)
    if marks is None:
        marks = found.sparkSession.createDataFrame([], "host string, ust long")
    marks = marks.select("host", "ust", *(F.col(c) if c in marks.columns else F.lit(None).cast("string").alias(c) for c in rest))
    spans = rows.groupBy("host", "block", "stretch").agg(F.min("start_ust").alias("lo"), F.max("end_ust").alias("hi"))
    own_marks = marks_of_stretches(spans, marks).select(F.col("host").alias("m_host"), F.col("block").alias("m_block"), F.col("stretch").alias("m_stretch"), "ust", *(F.col(c).alias(f"m_{c}") for c in rest))

    def fold(part: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n").reset_index(drop=True)
        marks = marks.sort_values(["m_stretch", "ust"])
        times, of = marks["ust"].tolist(), marks["m_stretch"].to_numpy()
        # what a mark names of a series, by place; nothing: every series
        named = [tuple((k, v) for k, v in enumerate(m) if v is not None and v == v) for m in zip(*(marks[f"m_{c}"].tolist() for c in rest))] if rest else [()] * len(times)
        meets = lambda names, series: any(all(series[k] == v for k, v in mark) for mark in names)
        each = list(zip(*(part[c].tolist() for c in rest))) if rest else [()] * len(part)
        stretch, fresh = part["stretch"].to_numpy(), []
        lows, highs = np.searchsorted(of, stretch, "left").tolist(), np.searchsorted(of, stretch, "right").tolist()
        first, now = 0, None
        for series, own, low, high, at, end in zip(each, stretch.tolist(), lows, highs, part["start_ust"].tolist(), part["end_ust"].tolist()):
            joins = own == now and at - first <= span_cap_s
            if joins:
                # marks up to ``looked`` are known not to meet what the episode holds
                until = bisect_right(times, max(covered, end), looked, high)
                new = set(named[looked:until])
                joins = not (any(meets(new, s) for s in held) or meets(new, series) or (series not in held and meets(passed, series)))
            if joins:
                covered, looked = max(covered, end), until
                passed |= new
                held.add(series)
            else:
                now, first, covered, held, passed = own, at, end, {series}, set()
                looked = bisect_right(times, at, low, high)
            fresh.append(not joins)
        return part[[*keys, "start_ust", "end_ust"]].assign(fresh=fresh)

    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", start_ust long, end_ust long, fresh boolean"
    folded = rows.groupBy("host", "block").cogroup(own_marks.groupBy("m_host", "m_block")).applyInPandas(fold, schema)
    return folded.withColumn("episode", F.sum(F.col("fresh").cast("long")).over(order)).drop("fresh")


def sufficiency(points: Column, needed: int, missing: Column) -> Column:
    """thin / moderate / adequate evidence."""
    return F.when(points < needed, "thin").when((points >= 3 * needed) & (missing * 10 < points + missing), "adequate").otherwise("moderate")


def priority(base: Column, points: Column, seconds: Column, thin: Column, level_shift: Column) -> Column:
    """Ordinal: one up for what lasts (never for level shifts), one down for thin evidence, 0 at least."""
    lasts = ~level_shift & (points >= PROMOTION_SAMPLES) & (seconds >= PROMOTION_SECONDS)
    return F.greatest(base + F.when(lasts, 1).otherwise(0) - F.when(thin, 1).otherwise(0), F.lit(0))


#: Values in the windows of a block of a series that one call looks at, and the least splits of it.
SHIFT_VALUES, SHIFT_SPLITS = 1 << 20, 256


def shift_width(points: DataFrame) -> DataFrame:
    """``width`` of a series (and segment): points in half an hour by the upper median of its intervals, five at least."""
    keys = parts_of(points)
    steps = points.groupBy(*keys, (F.col("end_ust") - F.col("start_ust")).alias("step")).agg(F.count("*").alias("n")).where("step > 0")
    past = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.withColumns({"run": F.sum("n").over(past), "all": F.sum("n").over(Window.partitionBy(*keys))})
    median = ranked.groupBy(*keys).agg(F.min(F.when(F.col("run") > F.floor(F.col("all") / 2), F.col("step"))).alias("step"))
    return median.select(*keys, F.greatest(F.ceil(F.lit(SHIFT_SECONDS) / F.col("step")), F.lit(SHIFT_POINTS)).cast("int").alias("width"))


def parts_of(points: DataFrame) -> list[str]:
    """What names a stretch of a series that windows don't leave: the series, and its segment where there is one."""
    return series_of(points) + (["segment"] if "segment" in points.columns else [])


def sliding_medians(values: np.ndarray, width: int) -> np.ndarray:
    """Medians of all stretches of ``width`` values: a sorted list of them that one leaves and one enters at each step."""
    own = sorted(values[:width].tolist())
    low, high, out = (width - 1) // 2, width // 2, np.empty(len(values) - width + 1)
    out[0] = (own[low] + own[high]) / 2
    for k, (gone, new) in enumerate(zip(values.tolist(), values[width:].tolist()), 1):
        del own[bisect_left(own, gone)]
        insort(own, new)
        out[k] = (own[low] + own[high]) / 2
    return out


def shift_windows(points: DataFrame) -> DataFrame:
    """Of each stretch of a series (``parts_of``) what windows it allows: ``points``, ``width``, ``candidates`` (splits with room

    for a window on both sides), ``joined`` (those whose windows miss no sample) and ``blind`` (points that are no candidate).
    Runs of points that follow each other tell it: one of L points has L - 2 width + 1 such splits.
    """
    keys = parts_of(points)
    order = Window.partitionBy(*keys).orderBy("end_ust")
    known = points.where(F.col("value").isNotNull())
    new = F.coalesce(F.col("start_ust") != F.lag("end_ust").over(order), F.lit(True)).cast("int")
    runs = known.withColumn("__new", new).withColumn("__run", F.sum("__new").over(order)).groupBy(*keys, "__run").agg(F.count("*").alias("size"))
    rows = runs.join(shift_width(known), keys, "left")
    room = F.greatest(F.col("size") - 2 * F.col("width") + 1, F.lit(0))
    out = rows.groupBy(*keys).agg(F.sum("size").alias("points"), F.first("width").alias("width"), F.sum(room).alias("joined"))
    candidates = F.greatest(F.col("points") - 2 * F.col("width") + 1, F.lit(0))
    # a stretch without any interval is passed over
    return out.withColumn("candidates", F.coalesce(candidates, F.lit(0))).withColumn("blind", F.when(F.col("width").isNotNull(), F.col("points") - F.col("candidates")).otherwise(0)).withColumn("joined", F.coalesce("joined", F.lit(0)))


def level_shifts(points: DataFrame, least: float | None = None, block: int | None = None) -> DataFrame:
    """Level shifts of each stretch of a series; the width of a window depends on its own interval.

    For each split into ``width`` points before and after that follow each other in time: the shift is the difference
    of the medians; what the windows' own slope explains of it is taken off and never added (windows of four points
    at least). Shift and step must reach the least change, 70 % of the points after must lie that far on the same
    side of the level before, and the step must be three times the scatter around the two levels where there is any.
    Of adjacent splits the strongest stays; ties go to the steadier, then the earlier. The result has the time of the
    windows too: ``start_ust`` to ``end_ust`` is that after the split.

    The least change is ``least``, or by series: ``change`` (absolute; relative to the level before; none: no shift
    is looked for), ``amount``, ``change_floor``, ``shift`` (upper, lower, both) and ``instant`` (values of a moment count at the end
    of their interval), as in the catalog. Series are cut into blocks of splits (``block``, or by the
    width) with ``width`` points more at both ends, so no task holds a whole series.
    """
    keys = parts_of(points)
    if least is not None:
        points = points.withColumns({"change": F.lit("absolute"), "amount": F.lit(float(least)), "change_floor": F.lit(0.0), "shift": F.lit("both"), "instant": F.lit(False)})
    own = ["change", "amount", "change_floor", "shift", "instant"]
    known = points.where(F.col("value").isNotNull() & (F.col("change") != "none")).select(*keys, "start_ust", "end_ust", "value", *own)
    order = Window.partitionBy(*keys).orderBy("end_ust")
    rows = known.join(shift_width(known), keys).withColumn("n", F.row_number().over(order) - 1)
    size = F.lit(block) if block else F.greatest(F.lit(SHIFT_SPLITS), F.floor(F.lit(SHIFT_VALUES) / F.col("width")))
    number = lambda c: F.floor(F.greatest(c, F.lit(0)) / F.col("size"))
    rows = rows.withColumn("size", size).withColumn("block", F.explode(F.sequence(number(F.col("n") - F.col("width")), number(F.col("n") + F.col("width")))))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("n").reset_index(drop=True)
        width, count = int(part["width"][0]), len(part)
        starts, ends, values, n = (part[c].to_numpy() for c in ("start_ust", "end_ust", "value", "n"))
        change, amount, floor, wanted, instant = (part[c][0] for c in own)
        names = [part[c][0] for c in keys]

        def rows_of(n, start, end, before, after, shift, normalized, strength, stays) -> pd.DataFrame:
            named = {c: pd.Series([x] * len(n), dtype=object) for c, x in zip(keys, names)}
            return pd.DataFrame(named | {"n": n, "start_ust": start, "end_ust": end, "level_before": before, "level_after": after, "shift": shift, "normalized": normalized, "strength": strength, "stays": stays})

        none = rows_of(*(np.zeros(0, t) for t in (int, int, int, float, float, float, float, float, float)))
        if count < 2 * width:
            return none
        joined = np.append(0, np.cumsum(np.append(True, starts[1:] == ends[:-1])))
        split = np.arange(width, count - width + 1)
        split = split[(n[split] // part["size"][0] == part["block"][0]) & (joined[split + width] - joined[split - width + 1] == 2 * width - 1)]
        if not len(split):
            return none
        times, half = (ends if instant else (starts + ends) / 2).astype(float), width // 2
        level, level_time = sliding_medians(values, width), sliding_medians(times, width)
        before, after = level[split - width], level[split]
        shift = after - before
        least = np.full(len(split), amount) if change == "absolute" else np.maximum(np.abs(before) * amount, floor)
        explained = np.zeros(len(split))
        if width >= 4:
            short, short_time = sliding_medians(values, half), sliding_medians(times, half)
            slope = lambda at: (short[at + width - half] - short[at]) / np.maximum(short_time[at + width - half] - short_time[at], 1e-9)
            explained = (slope(split - width) + slope(split)) / 2 * (level_time[split] - level_time[split - width])
        step = np.where(explained * shift <= 0, shift, np.where(np.abs(explained) >= np.abs(shift), 0.0, shift - explained))
        meant = np.ones(len(split), bool) if wanted == "both" else shift > 0 if wanted == "upper" else shift < 0
        far = meant & (np.minimum(np.abs(shift), np.abs(step)) >= least)
        split, before, after, shift, least, step = (x[far] for x in (split, before, after, shift, least, step))
        windows = np.lib.stride_tricks.sliding_window_view(values, width)
        stays, scatter = np.empty(len(split)), np.empty(len(split))
        for k in range(0, len(split), SHIFT_SPLITS):
            at = slice(k, k + SHIFT_SPLITS)
            old, new = windows[split[at] - width], windows[split[at]]
            moved = (new - before[at, None]) * np.sign(shift[at])[:, None]
            stays[at] = ((moved > 0) & (moved >= least[at, None])).mean(axis=1)
            scatter[at] = np.median(np.abs(np.concatenate([old - before[at, None], new - after[at, None]], axis=1)), axis=1) * MAD_SCALE
        normalized = np.where(scatter > 0, np.abs(step) / np.where(scatter > 0, scatter, 1.0), np.inf)
        strength = np.where(scatter > 0, normalized, np.abs(step) / np.where(least > 0, least, 1.0))
        hit = (stays >= PERSISTENCE) & (normalized >= SHIFT_NORMALIZED)
        at = split[hit]
        return rows_of(n[at], starts[at], ends[at + width - 1], before[hit], after[hit], shift[hit], normalized[hit], strength[hit], stays[hit])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", n long, start_ust long, end_ust long, level_before double, level_after double, shift double, normalized double, strength double, stays double"
    hits = rows.groupBy(*keys, "block").applyInPandas(fold, schema)
    island = F.col("n") - F.row_number().over(Window.partitionBy(*keys).orderBy("n"))
    best = Window.partitionBy(*keys, "island").orderBy(F.col("strength").desc(), F.col("stays").desc(), "n")
    return hits.withColumn("island", island).withColumn("r", F.row_number().over(best)).where("r = 1").select(*keys, "start_ust", "end_ust", "level_before", "level_after", "shift", "normalized")
