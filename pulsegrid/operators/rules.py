"""Eight rules for conditions that hold for a time, with what is missing told apart from what is not met.

Points are long: host, activity, item, field, start_ust, end_ust, elapsed_cs, value, reason; counters as
rates or percent, gauges as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.series import longest_run

#: A rule's least duration in seconds.
SECONDS = {
    "cpu-saturation": 300,
    "cpu-iowait-elevated": 300,
    "cpu-steal-elevated": 300,
    "memory-available-low": 300,
    "swap-activity": 60,
    "swap-space-used-high": 300,
    "run-queue-saturation": 300,
    "blocked-processes-sustained": 300,
}
#: What the rules look at.
INPUTS = {
    "idle": ("CPU", "all"),
    "iowait": ("CPU", "all"),
    "steal": ("CPU", "all"),
    "kbavail": ("MEMORY", "-"),
    "kbmemtotal": ("MEMORY", "-"),
    "kbswpfree": ("MEMORY", "-"),
    "kbswptotal": ("MEMORY", "-"),
    "pswpin": ("SWAP", "-"),
    "pswpout": ("SWAP", "-"),
    "runq_sz": ("QUEUE", "-"),
    "blocked": ("QUEUE", "-"),
}


def values_and_hits() -> dict[str, tuple[Column, Column]]:
    """Of each rule its value, null where an input is missing, and whether the condition holds."""
    c = F.col
    values = {
        "cpu-saturation": (100 - c("idle"), lambda v: v >= 90),
        "cpu-iowait-elevated": (c("iowait"), lambda v: v >= 20),
        "cpu-steal-elevated": (c("steal"), lambda v: v >= 10),
        "memory-available-low": (F.try_divide("kbavail", "kbmemtotal") * 100, lambda v: v <= 5),
        "swap-activity": (c("pswpin") + c("pswpout"), lambda v: v >= 1),
        "swap-space-used-high": (F.try_divide(c("kbswptotal") - c("kbswpfree"), c("kbswptotal")) * 100, lambda v: v >= 50),
        "run-queue-saturation": (F.try_divide(c("runq_sz"), c("cpus")), lambda v: v >= 2),
        "blocked-processes-sustained": (c("blocked"), lambda v: v >= 1),
    }
    return {rule: (value, hit(value)) for rule, (value, hit) in values.items()}


def aligned(points: DataFrame) -> DataFrame:
    """A row per host and interval with the rules' inputs as columns: values of the same start and end."""
    wanted = F.concat_ws("/", "activity", "item", "field").isin([f"{a}/{i}/{f}" for f, (a, i) in INPUTS.items()])
    columns = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in INPUTS]
    return points.where(wanted).groupBy("host", "start_ust", "end_ust").agg(F.max("elapsed_cs").alias("elapsed_cs"), *columns)


def evaluate(points: DataFrame, processors: DataFrame) -> DataFrame:
    """A row per host of ``points`` and rule: verdict, reason, and the longest run of the condition.

    observed: it held for the rule's time. not_observed: it didn't; a shorter run is evidence.
    undetermined: no value was observed (no_valid_observation), or the number of processors (``processors``:
    host, cpus) isn't known (missing_configuration). not_applicable: swap space was never there.
    """
    wide = aligned(points).join(processors.select("host", F.col("cpus").cast("double").alias("cpus")), "host", "left")
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("item"), v.cast("double").alias("value"), h.alias("hit")) for r, (v, h) in values_and_hits().items())))
    rows = wide.select("host", "start_ust", "end_ust", "elapsed_cs", "kbswptotal", "runq_sz", "cpus", each.alias("x")).select("*", "x.*").drop("x")
    seen = rows.groupBy("host", "item").agg(
        F.count(F.when(F.col("elapsed_cs") > 0, F.col("value"))).alias("observations"),
        F.max("kbswptotal").alias("swap"),
        F.count("runq_sz").alias("queued"),
        F.max("cpus").alias("cpus"),
    )
    hosts = points.select("host").distinct().withColumn("item", F.explode(F.array(*(F.lit(r) for r in SECONDS))))
    run = longest_run(rows, F.col("hit")).withColumnRenamed("points", "intervals")
    out = hosts.join(seen, ["host", "item"], "left").join(run, ["host", "item"], "left")
    none = F.coalesce("observations", F.lit(0)) == 0
    no_swap = (F.col("item") == "swap-space-used-high") & (F.col("swap") <= 0)
    no_cpus = (F.col("item") == "run-queue-saturation") & F.col("cpus").isNull() & (F.coalesce("queued", F.lit(0)) > 0)
    least = F.coalesce(*(F.when(F.col("item") == r, s) for r, s in SECONDS.items()))
    verdict = F.when(no_swap, "not_applicable").when(none, "undetermined").when(F.col("seconds") >= least, "observed").otherwise("not_observed")
    reason = F.when(no_swap, "no_swap_space").when(no_cpus, "missing_configuration").when(none, "no_valid_observation")
    return out.select("host", F.col("item").alias("rule"), verdict.alias("verdict"), reason.alias("reason"), F.coalesce("observations", F.lit(0)).alias("observations"), "seconds", "start_ust", "end_ust", "intervals", "min_value", "max_value", "mean_value")
