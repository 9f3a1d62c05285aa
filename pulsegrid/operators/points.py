"""From samples of any activities to points by column: the chain from ``sources.sa.read_sa`` to summaries, rules and catalog.

Samples are long, a row per field. An item's fields become one row (a map), items are matched with those of
the sample before, columns are worked out by their kind, and become rows again. All steps but those of
processors share one exchange, by host, activity and item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import counters
from pulsegrid.operators import cpu

#: Activities whose items are matched by name, and those that have sensors' values as 64-bit floating point.
NAMED = ["NET_DEV", "NET_EDEV", "FS"]
FLOATING = ["PWR_FAN", "PWR_TEMP", "PWR_IN"]
FULL_DUPLEX = 2
D = counters.D
POINTS = ["host", "activity", "item", "field", "segment", "sample_id", "start_ust", "end_ust", "elapsed_cs", "value", "reason"]


def items(samples: DataFrame) -> DataFrame:
    """A row per item and sample: ``v`` and ``bits`` are maps by field; ``key`` is what matches it with the sample before.

    A disk's key is its device number, that of named activities the name, and else its place.
    """
    if "cut" not in samples.columns:
        samples = samples.withColumn("cut", F.lit(None).cast("string"))
    whole = ["host", "activity", "item", "item_index", "item_count", "segment", "sample_id", "ust", "uptime_cs", "cut"]
    rows = samples.repartition("host", "activity", "item").groupBy(*whole).agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.col("raw").cast(D)))).alias("v"), F.map_from_entries(F.collect_list(F.struct("field", "bits"))).alias("bits")
    )
    number = lambda f: F.coalesce(F.try_element_at("v", F.lit(f)), F.lit(0).cast(D)).cast("string")
    key = F.when(F.col("activity") == "DISK", F.concat(number("major"), F.lit(":"), number("minor"))).when(F.col("activity").isin(NAMED), F.col("item"))
    return rows.withColumn("key", F.coalesce(key, F.col("item_index").cast("string")))


def matched(rows: DataFrame) -> DataFrame:
    """``items`` with ``p``, the map of the item's sample before (null if it has none), start_ust, elapsed_cs and ``broken``.

    Of several items with one key each name takes the first; a disk that from its own place on, and then from the
    first. ``broken``: first_sample of its host's activity, restart, item_replaced (not in the sample before, or
    registered anew since), non_positive_elapsed; or what the samples' own ``cut`` says (``hosts.merge_files``).
    """
    place = ["host", "activity", "key"]
    sample = ["item_count", "segment", "sample_id", "ust", "uptime_cs", "cut"]
    # maps can't be ordered, but their entries can; items of a sample differ in their places
    listed = rows.withColumns({"v": F.map_entries("v"), "bits": F.map_entries("bits")})
    grouped = listed.groupBy(*place, *sample).agg(F.array_sort(F.collect_list(F.struct("item_index", "item", "v", "bits"))).alias("own"))
    order = Window.partitionBy(*place).orderBy("sample_id")
    last = F.lag(F.struct(*sample, "own")).over(order)
    first = grouped.groupBy("host", "activity").agg(F.min("sample_id").alias("least"))
    rows = grouped.withColumn("last", last).join(first, ["host", "activity"]).withColumn("x", F.explode("own"))
    near = F.col("last.sample_id") == F.col("sample_id") - 1
    start = F.least(F.col("x.item_index"), F.col("last.item_count") - 1)
    from_place = F.filter("last.own", lambda o: o["item_index"] >= start)
    found = F.when(F.col("activity") == "DISK", F.coalesce(F.get(from_place, F.lit(0)), F.get("last.own", F.lit(0)))).otherwise(F.get("last.own", F.lit(0)))
    rows = rows.select(
        "host", "activity", F.col("x.item").alias("item"), F.col("x.item_index").alias("item_index"), *sample,
        F.map_from_entries("x.v").alias("v"), F.map_from_entries("x.bits").alias("bits"), F.map_from_entries(F.when(near, found)["v"]).alias("p"),
        "least", F.col("last.segment").alias("last_segment"), F.col("last.ust").alias("last_ust"), F.col("last.uptime_cs").alias("last_uptime"), near.alias("near"),
    )
    anew = counters.reregistered(F.col("activity"), field_of("v"), field_of("p"))
    none = F.col("p").isNull()
    broken = F.when(none & (F.col("sample_id") == F.col("least")), "first_sample").when(F.col("cut").isNotNull(), F.col("cut")).when(F.col("near") & (F.col("last_segment") != F.col("segment")), "restart").when(none | anew, "item_replaced")
    elapsed = F.when(F.col("near") & (F.col("last_segment") == F.col("segment")) & F.col("cut").isNull(), counters.native_interval_cs(F.col("uptime_cs"), F.col("last_uptime"))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumns({"broken": broken, "elapsed_cs": elapsed})
    rows = rows.withColumn("broken", F.coalesce("broken", F.when(F.col("elapsed_cs") <= 0, "non_positive_elapsed")))
    return rows.withColumns({"start_ust": F.when(F.col("near"), F.col("last_ust")).otherwise(F.col("ust")), "end_ust": F.col("ust")}).drop("least", "last_segment", "last_ust", "last_uptime", "near")


def field_of(of: str) -> Callable[[str], Column]:
    """A field of a map, 0 where it has none."""
    return lambda f: F.coalesce(F.try_element_at(of, F.lit(f)), F.lit(0).cast(D))


def floating(bits: Column) -> Column:
    """The number whose 64 bits, as IEEE 754 lays them out, are ``bits``."""
    sign = F.when(bits >= F.lit(str(1 << 63)).cast(D), -1.0).otherwise(1.0)
    rest = F.pmod(bits, F.lit(str(1 << 63)).cast(D)).cast("long")
    exponent, fraction = F.shiftright(rest, 52), rest.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    return F.when(exponent == 0, sign * fraction * F.pow(F.lit(2.0), F.lit(-1022.0))).when(exponent < 2047, sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 1023))


def derived(value: str, before: str) -> list[tuple[str, str, Column, Column | None]]:
    """(activity, column, its value, why it has none) of columns that are made of several fields of ``value`` and ``before``."""
    v = lambda f: F.try_element_at(value, F.lit(f))
    now, last, broken = field_of(value), field_of(before), F.col("broken")
    memory = counters.memory_derived({f: v(f) for f in ("kbmemtotal", "kbmemfree", "kbavail", "kbbuffers", "kbcached", "kbcommit", "kbswptotal", "kbswpfree", "kbswpcad")})
    out = [("MEMORY", name, x, None) for name, x in memory.items()]
    used, share = counters.huge_pages(v("kbhugtotal"), v("kbhugfree"))
    out += [("HUGE", "kbhugused", used, None), ("HUGE", "hugused_pct", share, None)]
    inodes, inodes_share = counters.inodes_used(v("inodes_total"), v("inodes_free"))
    out += [
        ("FS", "fs_used", counters.next_or_zero(v("fs_total") - v("fs_free")), None),
        ("FS", "fs_used_pct", counters.percent_or_zero(v("fs_total") - v("fs_free"), v("fs_total")), None),
        ("FS", "fs_used_pct_unpriv", counters.percent_or_zero(v("fs_total") - v("fs_available"), v("fs_total")), None),
        ("FS", "inodes_used", inodes, None),
        ("FS", "inodes_used_pct", inodes_share, None),
        ("PWR_FAN", "rpm_delta", floating(v("rpm")) - floating(v("rpm_min")), None),
    ]
    for activity, name, x, low, high in (("PWR_TEMP", "temp_pct", "temp_celsius", "temp_min", "temp_max"), ("PWR_IN", "in_pct", "volts", "volts_min", "volts_max")):
        share = counters.range_percent(*(floating(v(f)) for f in (x, low, high)))
        out.append((activity, name, F.when(floating(v(low)) == floating(v(high)), F.lit(0.0)).otherwise(share), None))
    # a sum of counters each of which may have wrapped; none if one went back that can't have
    ios = now("tps") - last("tps")

    def grown(fields: list[str]) -> tuple[Column, Column]:
        bits = [F.coalesce(F.try_element_at("bits", F.lit(f)), F.lit(64)) for f in fields]
        total = sum((counters.wrapping_delta(now(f), last(f), b) for f, b in zip(fields, bits)), F.lit(0).cast(D))
        back = [(now(f) < last(f)) & (b == 64) for f, b in zip(fields, bits)]
        return total, back[0] | back[1] | back[2]

    for name, fields, make in (("avg_request_size", counters.SECTORS, counters.mean_request_kb), ("await", ["read_ticks", "write_ticks", "discard_ticks"], counters.mean_wait_ms)):
        total, back = grown(fields)
        issue = F.coalesce(broken, F.when((ios > 0) & back, "ambiguous_decrease"))
        out.append(("DISK", name, F.when(ios <= 0, F.lit(0.0)).otherwise(make(total, ios)), issue))
    rate = lambda f: counters.per_second(counters.wrapping_delta(now(f), last(f), F.lit(64)), F.col("elapsed_cs"))
    busy = counters.interface_busy_percent(rate("rx_bytes_per_sec"), rate("tx_bytes_per_sec"), F.nullif(now("speed"), F.lit(0).cast(D)), now("duplex") == FULL_DUPLEX)
    gone_back = (now("rx_bytes_per_sec") < last("rx_bytes_per_sec")) | (now("tx_bytes_per_sec") < last("tx_bytes_per_sec"))
    out.append(("NET_DEV", "ifutil_pct", busy, F.coalesce(broken, F.when(now("speed") == 0, "missing_in_sample"), F.when(gone_back, "ambiguous_decrease"))))
    return out


def columns(rows: DataFrame) -> DataFrame:
    """Points of ``matched`` items, each column by its kind (``counters.column_value``) and those made of several fields.

    A derived column of a replaced item has no value, and none whose fields the file doesn't have.
    """
    entry = "struct<field:string, now:decimal(38,0), before:decimal(38,0), bits:int, made:boolean, value:double, issue:string>"
    # an item that wasn't there counts from 0; ``broken`` says why that is no value
    plain = F.transform(
        F.map_entries("v"),
        lambda e: F.struct(
            e["key"].alias("field"), e["value"].alias("now"), F.coalesce(F.try_element_at("p", e["key"]), F.lit(0).cast(D)).alias("before"), F.try_element_at("bits", e["key"]).alias("bits"),
            F.lit(False).alias("made"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("issue"),
        ),
    )
    replaced = F.coalesce(F.col("broken") == "item_replaced", F.lit(False))
    by_activity: dict[str, list[Column]] = {}
    for activity, name, value, issue in derived("v", "p"):
        why = F.when(replaced, F.lit("item_replaced")).otherwise(F.lit(None).cast("string") if issue is None else issue)
        made = F.struct(F.lit(name).alias("field"), F.lit(None).cast(D).alias("now"), F.lit(None).cast(D).alias("before"), F.lit(None).cast("int").alias("bits"), F.lit(True).alias("made"), F.when(why.isNull(), value.cast("double")).alias("value"), why.alias("issue"))
        by_activity.setdefault(activity, []).append(made)
    extra = F.lit(None).cast(f"array<{entry}>")
    for activity, made in by_activity.items():
        extra = F.when(F.col("activity") == activity, F.array(*made)).otherwise(extra)
    rows = rows.withColumn("x", F.explode(F.concat(plain, F.coalesce(extra, F.array().cast(f"array<{entry}>")))))
    names = F.create_map(*(F.lit(x) for pair in counters.DISK_COLUMNS.items() for x in pair))
    field = F.when(F.col("activity") == "DISK", F.coalesce(F.try_element_at(names, F.col("x.field")), F.col("x.field"))).otherwise(F.col("x.field"))
    rows = rows.withColumn("field", field).where(~((F.col("activity").isin("DISK", "SERIAL")) & F.col("field").isin(counters.IDENTITIES)))
    item = F.when((F.col("activity") == "IRQ") & ~F.col("item").contains("/"), F.lit("sum")).otherwise(F.col("item"))
    found = counters.column_value(F.col("activity"), F.col("field"), item, F.col("x.now"), F.col("x.before"), F.col("x.bits"), F.col("elapsed_cs"), F.col("broken"))
    rows = rows.withColumn("found", found)
    sensor = F.col("activity").isin(FLOATING) & ~F.col("x.made")
    value = F.when(F.col("x.made"), F.col("x.value")).when(sensor & ~replaced, floating(F.col("x.now"))).when(~sensor, F.col("found.value"))
    reason = F.when(F.col("x.made"), F.coalesce("x.issue", F.when(F.col("x.value").isNull(), "missing_in_sample"))).when(~sensor | replaced, F.col("found.reason"))
    return rows.withColumns({"value": value, "reason": reason}).select(*POINTS)


def wide(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``items`` with columns for ``fields``, 0 where the file has none."""
    return rows.select("host", "item", "item_index", "item_count", "segment", "sample_id", "ust", "uptime_cs", *(field_of("v")(f).alias(f) for f in fields))


def intervals(rows: DataFrame) -> DataFrame:
    """host, sample_id and what there is to say of the time since the host's sample before: start_ust, elapsed_cs, broken."""
    order = Window.partitionBy("host").orderBy("sample_id")
    heads = rows.select("host", "sample_id", "segment", "ust", "uptime_cs", "cut").distinct()
    last = F.lag(F.struct("sample_id", "segment", "ust", "uptime_cs")).over(order)
    heads = heads.withColumn("last", last)
    same = (F.col("last.segment") == F.col("segment")) & (F.col("last.sample_id") == F.col("sample_id") - 1) & F.col("cut").isNull()
    elapsed = F.when(same, counters.native_interval_cs(F.col("uptime_cs"), F.col("last.uptime_cs"))).otherwise(F.lit(0).cast("long"))
    broken = F.when(F.col("last").isNull(), "first_sample").when(F.col("cut").isNotNull(), F.col("cut")).when(F.col("last.segment") != F.col("segment"), "restart").when(~same, "item_replaced")
    heads = heads.withColumns({"elapsed_cs": elapsed, "broken": broken, "start_ust": F.coalesce("last.ust", "ust"), "end_ust": F.col("ust")})
    return heads.withColumn("broken", F.coalesce("broken", F.when(F.col("elapsed_cs") <= 0, "non_positive_elapsed"))).drop("last", "ust", "uptime_cs", "cut")


def processor_points(rows: DataFrame) -> DataFrame:
    """Points of CPU ``items``: percent of an interval's ticks, one total for all fields of a processor.

    ``all`` is the sum of the processors where there are several. An offline processor, or one that was so in the
    sample before, has no values (missing_in_sample); a tickless one was idle.
    """
    table = wide(rows, cpu.ALL)
    ticks = [c for c in table.columns if c not in ("item_index", "item_count", "segment", "ust", "uptime_cs")]
    own = cpu.with_previous(table)
    several = F.col("item_count") > 1
    singles = cpu.shares(cpu.states(cpu.corrected(own.where(~(several & (F.col("item") == "all"))))))
    was_off = (F.col("item") != "all") & F.col("has_previous") & (sum((F.col(f"p_{t}") for t in cpu.TICKS), F.lit(0).cast(D)) == 0)
    singles = singles.withColumn("off", (F.col("state") == "offline") | was_off)
    whole = cpu.shares(cpu.states(cpu.all_of_singles(table.where(several).select(*ticks)))).withColumn("off", F.lit(False))
    names = [*cpu.ALL, "system", "usr", "nice_excl_gnice"]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), F.col(f"{name}_pct").alias("value")) for name in names)))
    both = singles.select("host", "item", "sample_id", "off", "has_previous", "tick_total", each.alias("x")).unionByName(whole.select("host", "item", "sample_id", "off", "has_previous", "tick_total", each.alias("x")))
    # the sum has no row where no processor was there before; then it is the kernel's own that is missing
    out = both.join(intervals(rows), ["host", "sample_id"])
    reason = F.coalesce(F.col("broken"), F.when(~F.col("has_previous"), "item_replaced"), F.when(F.col("off"), "missing_in_sample"), F.when(F.col("x.value").isNull(), "non_positive_elapsed"))
    value = F.when(reason.isNull(), F.col("x.value"))
    first = rows.where((F.col("item") == "all") & several).select("host", "item", "sample_id").join(intervals(rows).where("broken = 'first_sample'"), ["host", "sample_id"])
    start = first.select("host", "item", "sample_id", F.explode(F.array(*(F.lit(n) for n in names))).alias("field"), "segment", "start_ust", "end_ust", "elapsed_cs", F.lit(None).cast("double").alias("value"), F.lit("first_sample").alias("reason"))
    out = out.select("host", "item", "sample_id", F.col("x.field").alias("field"), "segment", "start_ust", "end_ust", "elapsed_cs", value.alias("value"), reason.alias("reason"))
    return out.unionByName(start).withColumn("activity", F.lit("CPU")).select(*POINTS)


def frequency_points(rows: DataFrame) -> DataFrame:
    """``weighted_mhz`` of each processor from ``matched`` slots of frequencies: the mean of whole MHz, weighed by the time spent at each.

    A processor's slots are folded up to the first one without a frequency; without any time the mean is 0.
    """
    name = F.split("item", "/")
    spent = F.pmod(field_of("v")("time_in_state") - F.coalesce(F.try_element_at("p", F.lit("time_in_state")), F.lit(0).cast(D)), counters.modulus(F.lit(64)))
    slot = F.struct(F.element_at(name, 2).cast("int").alias("slot"), F.floor(field_of("v")("freq_khz") / 1000).cast(D).alias("mhz"), field_of("v")("freq_khz").alias("khz"), spent.alias("spent"))
    whole = ["host", "activity", "segment", "sample_id", "start_ust", "end_ust", "elapsed_cs"]
    rows = rows.groupBy(*whole, F.element_at(name, 1).alias("item")).agg(F.array_sort(F.collect_list(slot)).alias("slots"), F.min("broken").alias("broken"))
    used = F.filter("slots", lambda s, i: ~F.exists(F.slice("slots", 1, i + 1), lambda t: t["khz"] == 0))
    total = lambda of: F.aggregate(used, F.lit(0).cast(D), lambda sum_, s: (sum_ + of(s)).cast(D))
    value = F.coalesce(F.try_divide(total(lambda s: s["mhz"] * s["spent"]).cast("double"), total(lambda s: s["spent"]).cast("double")), F.lit(0.0))
    reason = F.when(F.col("broken") != "non_positive_elapsed", F.col("broken"))
    return rows.withColumns({"field": F.lit("weighted_mhz"), "value": F.when(reason.isNull(), value), "reason": reason}).select(*POINTS)


def points(samples: DataFrame) -> DataFrame:
    """Points (host, activity, item, field, segment, sample_id, start_ust, end_ust, elapsed_cs, value, reason) of samples.

    ``samples``: as ``read_sa`` gives them; ``sample_id`` counts the samples of a host. Names of columns are those of
    the catalog, the rules and the registry in ``counters``: gauges as they are, counters a second or in percent,
    processors in percent of ticks, and the derived columns of memory, huge pages, disks, interfaces, file systems
    and sensors. No row is left out: where there is no value ``reason`` says why.
    """
    others = matched(items(samples.where("activity <> 'CPU'")))
    slots = matched(items(samples.where("activity = 'PWR_FREQ'")))
    return columns(others).unionByName(frequency_points(slots)).unionByName(processor_points(items(samples.where("activity = 'CPU'"))))
