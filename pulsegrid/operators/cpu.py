"""Processor ticks: corrected intervals, states of processors, and the sum of all.

Tables are wide, a row per (host, item, sample_id) with a column for each tick counter. Item ``all`` is the
sum that the kernel gives; other items are single processors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The fields that make up a total (guest time is part of user and nice).
TICKS = ["user", "nice", "sys", "idle", "iowait", "steal", "irq", "soft"]
ALL = TICKS + ["guest", "gnice"]
OVERFLOW = (1 << 64) - (1 << 19)
SOFTNET = ["total_per_sec", "dropd_per_sec", "squeezd_per_sec", "rx_rps_per_sec", "flw_lim_per_sec", "blg_len"]
D = "decimal(38,0)"


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def with_previous(rows: DataFrame, fields: list[str] = ALL) -> DataFrame:
    """``rows`` with ``p_`` columns of the sample before, where the item has one, and ``has_previous``."""
    order = Window.partitionBy("host", "item").orderBy("sample_id")
    near = F.lag("sample_id").over(order) == F.col("sample_id") - 1
    before = {f"p_{c}": F.when(near, F.lag(F.col(c).cast(D)).over(order)) for c in fields}
    return rows.withColumns(before | {"has_previous": F.coalesce(near, F.lit(False))} | {c: F.col(c).cast(D) for c in fields})


def held_offline(rows: DataFrame, fields: list[str] = TICKS) -> DataFrame:
    """An offline processor (all of ``fields`` are 0) keeps the last counts it had, so it doesn't jump when it comes back.

    ``offline`` says where; the item ``all`` is left as it is. Before a processor was ever online it stays at 0.
    """
    order = Window.partitionBy("host", "item").orderBy("sample_id").rowsBetween(Window.unboundedPreceding, 0)
    off = (F.col("item") != "all") & (_sum([F.col(c).cast(D) for c in fields]) == 0)
    columns = [c for c in ALL + SOFTNET if c in rows.columns]
    last = F.last(F.when(~off, F.struct(*columns)), ignorenulls=True).over(order)
    marked = rows.withColumns({"offline": off, "__last": last})
    return marked.withColumns({c: F.when(F.col("offline"), F.coalesce(F.col(f"__last.{c}"), F.col(c))).otherwise(F.col(c)) for c in columns}).drop("__last")


def corrected(rows: DataFrame) -> DataFrame:
    """From ``with_previous``: ``p_iowait`` and ``p_idle`` as they are to be compared, and ``tick_total``.

    iowait that went back counts from its new value, or from 0 where idle didn't grow; idle that went back
    counts from 0; neither where the old value is about to overflow. Where user grew and user without
    guest went back, the total gains what that lost, and likewise for nice.
    """
    c, p = F.col, lambda x: F.col(f"p_{x}")
    overflow = F.lit(str(OVERFLOW)).cast(D)
    iowait = F.when((c("iowait") < p("iowait")) & (p("iowait") < overflow), F.when((c("idle") > p("idle")) | (p("idle") >= overflow), c("iowait")).otherwise(F.lit(0).cast(D))).otherwise(p("iowait"))
    idle = F.when((c("idle") < p("idle")) & (p("idle") < overflow), F.lit(0).cast(D)).otherwise(p("idle"))

    def lost(whole: str, guest: str) -> Column:
        now, before = c(whole) - c(guest), p(whole) - p(guest)
        return F.when((c(whole) >= p(whole)) & (now < before), before - now).otherwise(F.lit(0).cast(D))

    prior = {"iowait": iowait, "idle": idle}
    grown = [F.greatest(c(x) - prior.get(x, p(x)), F.lit(0).cast(D)) for x in TICKS]
    total = _sum(grown) + lost("user", "guest") + lost("nice", "gnice")
    return rows.withColumns({"tick_total": total, "__iowait": iowait, "__idle": idle}).withColumns({"p_iowait": F.col("__iowait"), "p_idle": F.col("__idle")}).drop("__iowait", "__idle")


def states(rows: DataFrame) -> DataFrame:
    """From ``corrected``: ``state`` offline (no ticks at all), tickless (a single processor without new ticks) or online.

    The total of ``all`` is 1 at least.
    """
    whole = F.col("item") == "all"
    state = F.when(_sum([F.col(x) for x in TICKS]) == 0, "offline").when((F.col("tick_total") == 0) & ~whole, "tickless").otherwise("online")
    total = F.when(whole, F.greatest("tick_total", F.lit(1).cast(D))).otherwise(F.col("tick_total"))
    return rows.withColumns({"state": state, "tick_total": total})


def shares(rows: DataFrame) -> DataFrame:
    """From ``states``: percent of the interval's ticks for each field and for system, usr and nice_excl_gnice.

    A sum that went back counts 0. A tickless processor was idle; an offline one has no values.
    """
    c, p = F.col, lambda x: F.col(f"p_{x}")
    parts = {x: (c(x), p(x)) for x in ALL}
    parts["system"] = (c("sys") + c("irq") + c("soft"), p("sys") + p("irq") + p("soft"))
    parts["usr"] = (c("user") - c("guest"), p("user") - p("guest"))
    parts["nice_excl_gnice"] = (c("nice") - c("gnice"), p("nice") - p("gnice"))

    def share(name: str, now: Column, before: Column) -> Column:
        value = F.when(now < before, F.lit(0.0)).otherwise((now - before).cast("double") / c("tick_total").cast("double") * 100)
        fixed = F.lit(100.0 if name == "idle" else 0.0)
        return F.when(~c("has_previous") | (c("state") == "offline"), F.lit(None).cast("double")).when(c("state") == "tickless", fixed).when(c("tick_total") > 0, value)

    return rows.withColumns({f"{name}_pct": share(name, *pair) for name, pair in parts.items()})


def all_of_singles(rows: DataFrame) -> DataFrame:
    """Item ``all`` of each sample, from its single processors: sums of counts and corrected counts before, ``tick_total``.

    Processors that were offline or missing in the sample before are left out; of those offline now the
    counts before stand in. Hosts with one item have no such row.
    """
    singles = with_previous(rows.where("item <> 'all'"))
    off = _sum([F.col(x) for x in TICKS]) == 0
    before = _sum([F.col(f"p_{x}") for x in TICKS])
    held = singles.withColumn("offline", off).where(F.col("has_previous") & (before != 0))
    held = held.withColumns({x: F.when(F.col("offline"), F.col(f"p_{x}")).otherwise(F.col(x)) for x in ALL})
    sums = {x: F.sum(x).cast(D) for x in [*ALL, *(f"p_{x}" for x in ALL), "tick_total"]}
    out = corrected(held).groupBy("host", "sample_id").agg(*(x.alias(n) for n, x in sums.items()), F.count_if(~F.col("offline")).alias("online"))
    return out.withColumns({"item": F.lit("all"), "has_previous": F.lit(True)})


def softnet_all(rows: DataFrame) -> DataFrame:
    """Item ``all`` of each sample of network soft interrupts: sums over processors that are not offline before or now."""
    singles = with_previous(rows.where("item <> 'all'"), SOFTNET)
    now, before = (_sum([F.col(f"{x}{c}") for c in SOFTNET]) for x in ("", "p_"))
    held = singles.where(F.col("has_previous") & (before != 0) & (now != 0))
    return held.groupBy("host", "sample_id").agg(*(F.sum(x).cast(D).alias(x) for c in SOFTNET for x in (c, f"p_{c}")))


def padded(rows: DataFrame, items: DataFrame, fields: list[str] = TICKS) -> DataFrame:
    """Rows of zeros for the items of a host (host, item) that a sample lacks."""
    wanted = rows.select("host", "sample_id").distinct().join(items, "host")
    return wanted.join(rows, ["host", "sample_id", "item"], "left").fillna(0, fields)
