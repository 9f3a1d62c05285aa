"""Column expressions on sampled counters and gauges. Raw values are unsigned: decimal(20,0) or a non-negative long."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

D = "decimal(38,0)"


def modulus(bits: Column) -> Column:
    return F.when(bits == 32, F.lit(1 << 32).cast(D)).otherwise(F.lit("18446744073709551616").cast(D))


def interval_cs(now: Column, before: Column) -> Column:
    """Hundredths of a second between two uptimes for sar-compatible output: a 64-bit wrap counts on, and 0 becomes 1.

    As decimal(20,0): a clock that goes back gives nearly 2^64.
    """
    return F.greatest(F.pmod(now.cast(D) - before.cast(D), F.lit("18446744073709551616").cast(D)), F.lit(1).cast(D)).cast("decimal(20,0)")


def native_interval_cs(now: Column, before: Column) -> Column:
    """Hundredths of a second between two uptimes; 0 where no time passed or the clock went back, which is never made a length."""
    apart = now.cast(D) - before.cast(D)
    return F.when((apart > 0) & (apart < F.lit(1 << 62).cast(D)), apart).otherwise(F.lit(0).cast(D)).cast("long")


def wrapping_delta(now: Column, before: Column, bits: Column) -> Column:
    return F.pmod(now.cast(D) - before.cast(D), modulus(bits))


def per_second(delta: Column, elapsed_cs: Column) -> Column:
    return F.try_divide(delta.cast("double"), elapsed_cs.cast("double")) * 100


def clamped_rate(now: Column, before: Column, elapsed_cs: Column) -> Column:
    """0 for a counter that went back."""
    return F.when(now < before, F.lit(0.0)).otherwise(per_second(now - before, elapsed_cs))


def classified_delta(now: Column, before: Column, bits: Column, first: Column, restart: Column, replaced: Column, elapsed_cs: Column) -> Column:
    """struct(delta, wrapped, reason): why there is no delta, in the order of the checks. ``delta`` is decimal(20,0)."""
    reason = (
        F.when(first, "first_sample")
        .when(restart, "restart")
        .when(replaced, "item_replaced")
        .when(elapsed_cs <= 0, "non_positive_elapsed")
        .when((now < before) & (bits == 64), "ambiguous_decrease")
    )
    delta = F.when(reason.isNull(), wrapping_delta(now, before, bits)).cast("decimal(20,0)")
    return F.struct(delta.alias("delta"), (reason.isNull() & (now < before)).alias("wrapped"), reason.alias("reason"))


def percent(part: Column, whole: Column) -> Column:
    """Null for a whole of 0: missing is not zero."""
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def tick_share(delta: Column, total: Column) -> Column:
    """A share of the ticks of an interval, in percent; a tick counter that went back counts 0."""
    return F.when(total > 0, F.greatest(delta, F.lit(0)).cast("double") / total.cast("double") * 100)


def pressure(now: Column, before: Column, elapsed_cs: Column) -> Column:
    """Microseconds stalled to percent of the interval."""
    return (now.cast("double") - before.cast("double")) / (elapsed_cs.cast("double") * 100)


def gauge_hundredths(raw: Column) -> Column:
    return raw.cast("double") / 100


def memory_used(total: Column, available: Column) -> Column:
    return F.greatest(total - available, F.lit(0))


def memory_used_percent(total: Column, available: Column) -> Column:
    """0, and not missing, where the total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(percent(memory_used(total, available), total))


def used_without_cache(total: Column, free: Column, buffers: Column, cached: Column) -> Column:
    return F.greatest(total - free - buffers - cached, F.lit(0))


def percent_or_zero(part: Column, whole: Column) -> Column:
    """0, and not missing, for a whole of 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(percent(part, whole))


def commit_percent(committed: Column, total: Column, swap: Column) -> Column:
    return percent_or_zero(committed, total + F.coalesce(swap, F.lit(0)))


def swap_used_percent(total: Column, free: Column) -> Column:
    return percent(F.greatest(total - free, F.lit(0)), total)


def mean_request_kb(sectors: Column, ios: Column) -> Column:
    """0 where no request ended."""
    return F.when(ios > 0, sectors.cast("double") / ios / 2).otherwise(0.0)


def mean_wait_ms(ticks: Column, ios: Column) -> Column:
    return F.when(ios > 0, ticks.cast("double") / ios).otherwise(0.0)


def device_busy_percent(ticks_ms: Column, elapsed_cs: Column) -> Column:
    return per_second(ticks_ms, elapsed_cs) / 10


def space_used_percent(total: Column, free: Column) -> Column:
    return percent(total - free, total)


def unprivileged_used_percent(total: Column, available: Column) -> Column:
    return percent(total - available, total)


def interface_busy_percent(received: Column, sent: Column, megabits: Column, full_duplex: Column) -> Column:
    """Bytes a second to percent of the speed; missing without a speed."""
    load = F.when(full_duplex, F.greatest(received, sent)).otherwise(received + sent)
    return F.try_divide(load.cast("double") * 800, megabits.cast("double") * 1_000_000)


def range_percent(value: Column, low: Column, high: Column) -> Column:
    return percent(value - low, high - low)


def drain_per_minute(now: Column, before: Column, elapsed_cs: Column) -> Column:
    return F.try_divide((now - before).cast("double") * 6000, elapsed_cs.cast("double"))


#: Counters of an interface whose going back makes it a new one, and pairs (of which the first may overflow while the second grows).
INTERFACE_COUNTERS = ["rxpck_per_sec", "txpck_per_sec", "rx_bytes_per_sec", "tx_bytes_per_sec", "rxcmp_per_sec", "txcmp_per_sec", "rxmcst_per_sec"]
OVERFLOWS = [("rx_bytes_per_sec", "rxpck_per_sec"), ("tx_bytes_per_sec", "txpck_per_sec"), ("rxpck_per_sec", "rx_bytes_per_sec"), ("txpck_per_sec", "tx_bytes_per_sec")]
INTERFACE_ERRORS = ["coll_per_sec", "rxerr_per_sec", "txerr_per_sec", "rxdrop_per_sec", "txdrop_per_sec", "rxfifo_per_sec", "txfifo_per_sec", "rxfram_per_sec"]
SECTORS = ["read_sectors", "write_sectors", "discard_sectors"]


def reregistered(activity: Column, now: Callable[[str], Column], before: Callable[[str], Column]) -> Column:
    """Whether an item of the same name is a new one; ``now`` and ``before`` give its fields, 0 where it has none.

    A disk whose requests went back while each count of sectors went back or was 0 before; an interface any of
    whose counters went back, unless one did so from the upper half of 64 bits while its partner grew; any error
    counter of an interface that went back (but not lost carriers).
    """
    back = lambda f: now(f) < before(f)
    disk = reduce(lambda a, b: a & b, [(before(f) == 0) | back(f) for f in SECTORS], back("tps"))
    half = F.lit(str((1 << 63) - 1)).cast(D)
    overflow = reduce(lambda a, b: a | b, [back(f) & (now(o) > before(o)) & (before(f) > half) for f, o in OVERFLOWS])
    interface = reduce(lambda a, b: a | b, map(back, INTERFACE_COUNTERS)) & ~overflow
    errors = reduce(lambda a, b: a | b, map(back, INTERFACE_ERRORS))
    return F.when(activity == "DISK", disk).when(activity == "NET_DEV", interface).when(activity == "NET_EDEV", errors).otherwise(F.lit(False))


def next_or_zero(x: Column) -> Column:
    return F.greatest(x, F.lit(0))


def memory_derived(c: dict[str, Column]) -> dict[str, Column]:
    """The derived memory columns from kbmemtotal, kbmemfree, kbavail, kbbuffers, kbcached, kbcommit, kbswptotal, kbswpfree, kbswpcad.

    Shares of a whole of 0 are missing, but those of all memory and of what is committed are 0; so is the share of cached
    swap when there is swap and none of it used.
    """
    used = memory_used(c["kbmemtotal"], c["kbavail"])
    nocache = used_without_cache(c["kbmemtotal"], c["kbmemfree"], c["kbbuffers"], c["kbcached"])
    withcache = c["kbmemfree"] + c["kbbuffers"] + c["kbcached"]
    swap = next_or_zero(c["kbswptotal"] - c["kbswpfree"])
    return {
        "kbmemused": used,
        "memused_pct": memory_used_percent(c["kbmemtotal"], c["kbavail"]),
        "kbmemused_nocache": nocache,
        "memused_nocache_pct": percent(nocache, c["kbmemtotal"]),
        "kbmemfree_withcache": withcache,
        "memused_withcache_pct": percent(next_or_zero(c["kbmemtotal"] - c["kbmemfree"]), c["kbmemtotal"]),
        "commit_pct": commit_percent(c["kbcommit"], c["kbmemtotal"], c["kbswptotal"]),
        "kbswpused": swap,
        "swpused_pct": percent(swap, c["kbswptotal"]),
        "swpcad_pct": F.when(c["kbswptotal"] != 0, percent_or_zero(c["kbswpcad"], swap)),
    }


def huge_pages(total: Column, free: Column) -> tuple[Column, Column]:
    """Used huge pages and their percent, 0 where there are none."""
    used = next_or_zero(total - free)
    return used, percent_or_zero(used, total)


def inodes_used(total: Column, free: Column) -> tuple[Column, Column]:
    used = next_or_zero(total - free)
    return used, percent_or_zero(used, total)


def fan_above_least(rpm: Column, least: Column) -> Column:
    return rpm - least


#: What a rate of a column is divided by.
RATE_DIVISORS = {"read_kb_per_sec": 2, "write_kb_per_sec": 2, "discard_kb_per_sec": 2, "avg_queue_size": 1000, "util_pct": 10}
#: Gauges kept in hundredths.
HUNDREDTHS = ["ldavg_1", "ldavg_5", "ldavg_15", "mhz", "scpu_10", "scpu_60", "scpu_300", "sio_10", "sio_60", "sio_300", "fio_10", "fio_60", "fio_300", "smem_10", "smem_60", "smem_300", "fmem_10", "fmem_60", "fmem_300"]
#: Activities all of whose columns are gauges, and gauges of others.
GAUGE_ACTIVITIES = ["MEMORY", "KTABLES", "QUEUE", "NET_SOCK", "NET_SOCK6", "HUGE", "FS", "PWR_CPU", "PWR_FAN", "PWR_TEMP", "PWR_IN", "PWR_BAT"]
GAUGE_FIELDS = ["avg_request_size", "await", "ifutil_pct", "speed", "duplex", "blg_len", "weighted_mhz", "freq_khz"]
LAST_FIELDS = ["speed", "duplex", "temp_min", "temp_max", "volts_min", "volts_max", "freq_khz", "status"]
SUM_FIELDS = ["read_ticks", "write_ticks", "discard_ticks", "time_in_state"]


def is_gauge(activity: Column, field: Column) -> Column:
    return activity.isin(GAUGE_ACTIVITIES) | field.isin(GAUGE_FIELDS + HUNDREDTHS)


def clamps(activity: Column, field: Column, item: Column) -> Column:
    """Counters that count 0 when they go back: those of processors and of all devices together, interrupts in sum, and device use."""
    return activity.isin("CPU", "IO") | ((activity == "IRQ") & (item == "sum")) | ((activity == "DISK") & (field == "util_pct"))


def method(activity: Column, field: Column, derived: Column) -> Column:
    """How a column is summed up over a period."""
    return (
        F.when(derived, "derived_interval_sample_mean")
        .when(field.isin(LAST_FIELDS) | (activity == "FS"), "last_valid")
        .when(field.isin(SUM_FIELDS), "delta_sum")
        .when(is_gauge(activity, field), "sample_mean")
        .otherwise("rate_over_valid_intervals")
    )


def divisor(field: Column) -> Column:
    return F.coalesce(*(F.when(field == f, float(d)) for f, d in RATE_DIVISORS.items()), F.lit(1.0))


#: What columns of disks are called that are made of one counter.
DISK_COLUMNS = {"read_sectors": "read_kb_per_sec", "write_sectors": "write_kb_per_sec", "discard_sectors": "discard_kb_per_sec", "rq_ticks": "avg_queue_size", "tot_ticks": "util_pct"}
#: What tells devices apart, and shares of time that count in microseconds.
IDENTITIES = ["major", "minor", "wwn_high", "wwn_low", "partition_nr", "line"]
PRESSURES = ["scpu", "sio", "fio", "smem", "fmem"]


def column_value(activity: Column, field: Column, item: Column, now: Column, before: Column, bits: Column, elapsed_cs: Column, reason: Column, tick_total: Column | None = None) -> Column:
    """struct(value, reason) of one column of an interval, whatever its kind.

    A gauge is its own value, hundredths divided, whatever came before, but not of a replaced item. For a counter
    the reason why there is no interval stands first; one of those that count 0 when they go back is 0 then; else its
    classified delta a second, over the column's divisor. Where there is a ``tick_total``, processor time is divided by
    that and not by the elapsed time; of an interval without ticks there is no share. Pressures may be negative.
    """
    gauge = is_gauge(activity, field)
    direct = now.cast("double") / F.when(field.isin(HUNDREDTHS), 100.0).otherwise(1.0)
    broken = F.when(reason.isNotNull() & (reason != "ambiguous_decrease"), reason)
    clamped, under_pressure = clamps(activity, field, item) & (now < before), field.isin(PRESSURES) & activity.startswith("PSI")
    ticks = elapsed_cs if tick_total is None else F.when(activity == "CPU", tick_total.cast("double")).otherwise(elapsed_cs.cast("double"))
    found = (
        F.when(broken.isNull() & ~clamped & ~under_pressure & (now < before) & (bits == 64), "ambiguous_decrease")
        .when(broken.isNull() & ~clamped & (ticks <= 0), "non_positive_elapsed")
        .otherwise(broken)
    )
    rate = F.when(clamped, 0.0).when(under_pressure, pressure(now, before, elapsed_cs)).otherwise(per_second(wrapping_delta(now, before, bits), ticks) / divisor(field))
    value = F.when(gauge & ~F.coalesce(reason == "item_replaced", F.lit(False)), direct).when(~gauge & found.isNull(), rate)
    return F.struct(value.alias("value"), F.when(~gauge | (found == "item_replaced"), found).alias("reason"))


def other_units(kb_per_sec: Column) -> dict[str, Column]:
    """A rate in kB in the other units that reports use."""
    return {"sectors": kb_per_sec * 2, "kb": kb_per_sec, "mb": kb_per_sec / 1024}


#: Units of sizes, each 1024 of the one before.
UNITS = ["B", "k", "M", "G", "T", "P"]


def human_size(bytes_: Column) -> Column:
    """Like 1.5M: the largest unit that leaves at least 1, with one digit; an exact half goes to the even one."""
    value = bytes_.cast("double")
    power = reduce(lambda rest, k: F.when(value >= float(1024**k), k).otherwise(rest), range(1, len(UNITS)), F.lit(0))
    return F.concat(F.format_string("%.1f", F.bround(value / F.pow(F.lit(1024.0), power), 1)), F.get(F.array(*(F.lit(u) for u in UNITS)), power))


def printable(text: Column) -> Column:
    """Characters that don't print as dots."""
    return F.regexp_replace(text, "[\\x00-\\x1F\\x7F]", ".")


def counted(n: Column, one: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {one}s"))


def duration_text(seconds: Column) -> Column:
    """Like 12 seconds, 5 minutes, 2 hours or 1 hour 5 minutes: whole ones, and no minutes of full hours."""
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds / 60)
    both = F.concat_ws(" ", counted(hours, "hour"), counted(minutes % 60, "minute"))
    return F.when(seconds < 60, counted(seconds, "second")).when(seconds < 3600, counted(minutes, "minute")).when(seconds % 3600 == 0, counted(hours, "hour")).otherwise(both)


def support_text(samples: Column, seconds: Column) -> Column:
    """How long something lasted: 3 samples spanning 10 minutes."""
    return F.concat(counted(samples, "sample"), F.when(seconds == 0, " at a single point in time").otherwise(F.concat(F.lit(" spanning "), duration_text(seconds))))
