"""Several files and hosts: identity, boundaries between samples and files, the common window, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.rules import INPUTS
from pulsegrid.operators.series import align

#: Fixed values.
BOOT_TOLERANCE_S = 5
LONGEST_GAP_S = 7200


def identity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How two descriptions of a host (nodename, sysname, machine, release, cpus) compare."""
    same = {c: a[c].eqNullSafe(b[c]) for c in ("nodename", "sysname", "machine", "release", "cpus")}
    return (
        F.when(~same["nodename"], "different")
        .when(~same["machine"] | ~same["sysname"], "ambiguous")
        .when(~same["release"] | ~same["cpus"], "likely_same_machine")
        .otherwise("identical")
    )


GROUP = ["nodename", "sysname", "machine"]


def boot_epoch(ust: Column, uptime_cs: Column) -> Column:
    """When the host was started, in seconds; null where uptime is not known."""
    return F.when(uptime_cs > 0, ust - F.floor(uptime_cs / 100))


def boundaries(samples: DataFrame, carry_across_files: bool = True) -> DataFrame:
    """``decision`` of each sample against the one before of its host (nodename, sysname, machine).

    Samples have file, ust, uptime_cs, layout (a name for the activities and their sizes), release and cpus, and may have
    ``number`` (of the sample in its file) and ``restarts`` (restart records of the file before it). Checks stand in
    order: the first that holds decides. ``new_segment``: a restart record, another boot, or another machine; other
    breaks cut deltas and stay in the segment. ``boot`` counts the segments.
    """
    if "restarts" not in samples.columns:
        samples = samples.withColumn("restarts", F.lit(0))
    # of a host a row for each sample
    w = Window.partitionBy(*GROUP).orderBy("ust", "file", *(["number"] if "number" in samples.columns else []))
    names = ("file", "ust", "uptime_cs", "layout", "release", "cpus", "restarts")
    rows = samples.withColumns({f"p_{c}": F.lag(c).over(w) for c in names}).withColumn("first", F.row_number().over(w) == 1)
    c, p = F.col, lambda x: F.col(f"p_{x}")
    now, before = boot_epoch(c("ust"), c("uptime_cs")), boot_epoch(p("ust"), p("uptime_cs"))
    other = ~(c("release").eqNullSafe(p("release")) & c("cpus").eqNullSafe(p("cpus")))
    decision = (
        F.when(c("first"), "first")
        .when(c("restarts") > F.when(c("file") == p("file"), p("restarts")).otherwise(0), "restart_record")
        .when(other, "identity_changed")
        .when(~c("layout").eqNullSafe(p("layout")), "layout_changed")
        .when(now.isNull() | before.isNull(), "boot_epoch_unknown")
        .when(F.abs(now - before) > BOOT_TOLERANCE_S, "boot_epoch_changed")
        .when((c("uptime_cs") < p("uptime_cs")) | (c("ust") < p("ust")), "time_backwards")
        .when(c("uptime_cs") - p("uptime_cs") > LONGEST_GAP_S * 100, "gap")
        .when((c("file") != p("file")) & F.lit(not carry_across_files), "carry_disabled")
        .otherwise("continuous")
    )
    out = rows.withColumn("decision", decision)
    out = out.withColumn("new_segment", F.col("decision").isin("restart_record", "identity_changed", "boot_epoch_changed"))
    boot = F.sum(F.col("new_segment").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("boot", boot).drop("first", *(f"p_{x}" for x in names))


#: Fixed value: what the points say of a sample whose boundary is not continuous, begins no segment and has one layout.
UNVERIFIED = "file_boundary_unverified"


def merge_files(samples: DataFrame, heads: DataFrame, carry_across_files: bool = True) -> DataFrame:
    """Samples of several files of hosts as the samples of hosts, which ``points.points`` takes: ``sample_id`` and ``segment`` count

    through a host's files in order of time, and ``cut`` says why there is no interval before a sample (null: there is):
    restart where a segment begins, layout_changed, or file_boundary_unverified.

    ``samples``: as the reader gives them; ``heads``: a row per sample (see ``sample_heads``). Decisions are made on the
    heads alone. They reach the values as one map for each file, joined by its path: a row per file, which Spark
    broadcasts where that is small, and never an exchange of values by time.
    """
    decided = boundaries(heads, carry_across_files)
    order = Window.partitionBy(*GROUP).orderBy("ust", "file", "number")
    cut = F.when(F.col("decision").isin("first", "continuous"), F.lit(None).cast("string")).when(F.col("new_segment"), "restart").otherwise(F.when(F.col("decision") == "layout_changed", "layout_changed").otherwise(UNVERIFIED))
    rows = decided.withColumns({"cut": cut, "id": (F.row_number().over(order) - 1).cast("long")})
    by_file = rows.groupBy(F.col("file").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("number", F.struct("id", "boot", "cut")))).alias("of_number"))
    out = samples.join(by_file, "path").withColumn("x", F.element_at("of_number", F.col("sample_id")))
    return out.withColumns({"sample_id": F.col("x.id"), "segment": F.col("x.boot"), "cut": F.col("x.cut")}).drop("x", "of_number")


def sample_heads(records: DataFrame, headers: DataFrame) -> DataFrame:
    """What ``boundaries`` asks for of each sample, from the reader's records and headers. A restart tells the processors from then on, as far as known."""
    files = headers.select("path", F.col("host").alias("nodename"), "sysname", "machine", "release", "cpus", F.concat_ws(" ", F.col("format").cast("string"), F.col("long_size").cast("string"), "activities").alias("layout"))
    rows = records.where(F.col("kind").isin(1, 3)).select("path", "number", F.col("segment").alias("restarts"), "ust", F.col("uptime_cs").cast("long").alias("uptime_cs"))
    return rows.join(files, "path").withColumnRenamed("path", "file")


def merged(samples: DataFrame, boundaries_of: DataFrame) -> DataFrame:
    """Values of a host's files (GROUP, file, ust, item, raw) as one table of samples with the boundaries' ``boot`` and ``decision``."""
    return samples.join(boundaries_of.select(*GROUP, "file", "ust", "boot", "decision"), [*GROUP, "file", "ust"])


def representative_segment(points: DataFrame) -> DataFrame:
    """Each host's segment with the most samples; the last on ties."""
    sizes = points.groupBy("host", "segment").agg(F.count_distinct("end_ust").alias("samples"))
    best = Window.partitionBy("host").orderBy(F.col("samples").desc(), F.col("segment").desc())
    return sizes.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def comparable(buckets: DataFrame) -> DataFrame:
    """Buckets of metrics (item) with the number of hosts that have a value, and whether that is all hosts of the table."""
    hosts = buckets.agg(F.count_distinct("host").alias("all_hosts"))
    per = buckets.groupBy("item", "bucket").agg(F.count_distinct("host").alias("hosts"))
    return per.crossJoin(F.broadcast(hosts)).select("item", "bucket", "hosts", (F.col("hosts") == F.col("all_hosts")).alias("comparable"))  # one row


def compare(buckets: DataFrame) -> DataFrame:
    """Mean over observed buckets of each metric and host, for metrics that every host has; the others are left out."""
    hosts = buckets.agg(F.count_distinct("host").alias("all_hosts"))
    means = buckets.groupBy("item", "host").agg(F.avg("value").alias("mean"), F.count("value").alias("buckets"))
    whole = means.where("buckets > 0").withColumn("hosts", F.count("*").over(Window.partitionBy("item")))
    return whole.crossJoin(F.broadcast(hosts)).where("hosts = all_hosts").select("item", "host", "mean", "buckets")  # one row


def common_window(points: DataFrame) -> DataFrame:
    """One row: the latest start and the earliest end of all hosts."""
    spans = points.groupBy("host").agg(F.min("start_ust").alias("lo"), F.max("end_ust").alias("hi"))
    return spans.agg(F.max("lo").alias("window_start"), F.min("hi").alias("window_end"))


def compare_hosts(points: DataFrame, step_s: int) -> DataFrame:
    """Hosts side by side, from their points: of each its segment with the most samples, the window that all of these share,

    a grid of ``step_s`` over it, the inputs of the rules (``rules.INPUTS``), and the mean over observed buckets of each that
    every host has. A row per metric and host: mean, buckets; ``missing`` names the hosts that lack a metric, whose rows
    have no mean. Without a common window there are no rows.
    """
    wanted = F.concat_ws("/", "activity", "item", "field").isin([f"{a}/{i}/{f}" for f, (a, i) in INPUTS.items()])
    chosen = points.join(representative_segment(points).select("host", "segment"), ["host", "segment"])
    window = common_window(chosen).where("window_start < window_end")
    rows = chosen.where(wanted).crossJoin(F.broadcast(window))  # one row
    grid = align(rows.select("host", F.col("field").alias("item"), "start_ust", "end_ust", "elapsed_cs", "value", "window_start", "window_end"), F.col("window_start"), F.col("window_end"), step_s)
    means = grid.groupBy("item", "host").agg(F.avg("value").alias("mean"), F.count("value").alias("buckets"))
    every = chosen.select("host").distinct().crossJoin(F.broadcast(means.select("item").distinct()))  # hosts by eleven rows
    table = every.join(means, ["item", "host"], "left").withColumn("buckets", F.coalesce("buckets", F.lit(0)))
    lacking = F.array_sort(F.collect_set(F.when(F.col("buckets") == 0, F.col("host"))).over(Window.partitionBy("item")))
    table = table.withColumn("missing", lacking)
    return table.withColumn("mean", F.when(F.size("missing") == 0, F.col("mean")))
