"""Writers for points and summaries. Raw counters are written as text, so 64-bit values stay exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import counters


def exact(rows: DataFrame) -> DataFrame:
    """Decimals as text."""
    return rows.withColumns({c: F.col(c).cast("string") for c, kind in rows.dtypes if kind.startswith("decimal")})


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    exact(rows).write.mode(mode).option("header", True).option("nullValue", "").csv(path)


def write_ndjson(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    exact(rows).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_xml(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    exact(rows).write.mode(mode).format("xml").option("rowTag", "row").option("rootTag", "rows").save(path)


def as_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per value: keys, name and value (double), for the columns that are numbers."""
    names = [c for c, kind in rows.dtypes if c not in keys and kind in ("int", "bigint", "double", "float")]
    cast = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in names))
    return cast.unpivot(keys, names, "name", "value")


#: The columns of the CSV table, in order.
CSV_COLUMNS = ["hostname", "source", "boot", "start_epoch", "end_epoch", "elapsed_cs", "continuous", "activity", "item", "item_index", "space", "metric", "unit", "kind", "value", "raw", "text", "cpu", "quality"]


def unit(activity: Column, field: Column) -> Column:
    """What a column counts, as its name tells; null for plain numbers."""
    return (
        F.when(field.endswith("_pct") | activity.isin("CPU", "PSI_CPU", "PSI_IO", "PSI_MEM"), "percent")
        .when(field.endswith("_bytes_per_sec"), "bytes_per_sec")
        .when(field.contains("kb_per_sec") | field.isin("pgpgin", "pgpgout"), "kilobytes_per_sec")
        .when(field.startswith("kb") | (field == "avg_request_size"), "kilobytes")
        .when(field.isin("await", "read_ticks", "write_ticks", "discard_ticks"), "milliseconds")
        .when(field.endswith("_per_sec") | activity.isin("PCSW", "SWAP", "PAGE", "IO", "IRQ") | ((activity == "DISK") & (field == "tps")), "count_per_sec")
        .when((activity == "FS") & field.startswith("fs_"), "bytes")
        .when(field.endswith("mhz"), "megahertz")
    )


def csv_rows(points: DataFrame) -> DataFrame:
    """Points (and whichever of the other columns they have) as rows of the CSV table; what is not there is null."""
    made = {
        "hostname": F.col("host"),
        "boot": F.col("segment"),
        "start_epoch": F.col("start_ust"),
        "end_epoch": F.col("end_ust"),
        "continuous": F.col("reason").isNull(),
        "metric": F.col("field") if "field" in points.columns else F.lit(None).cast("string"),
        "quality": F.coalesce("reason", F.lit("ok")),
    }
    if "field" in points.columns and "activity" in points.columns:
        made |= {"kind": F.when(counters.is_gauge(F.col("activity"), F.col("field")), "gauge").otherwise("counter"), "unit": unit(F.col("activity"), F.col("field"))}
    return points.select(*(made.get(c, F.col(c) if c in points.columns else F.lit(None).cast("string")).alias(c) for c in CSV_COLUMNS))


def event_lines(events: DataFrame) -> DataFrame:
    """Restarts and comments (host, ust, kind, cpu_count, text) as lines of JSON."""
    return events.select("host", "ust", F.to_json(F.struct(F.col("kind").alias("type"), "host", F.col("ust").alias("epoch"), F.col("cpu_count").alias("cpus"), "text")).alias("line"))


def number_text(value: Column) -> Column:
    """A double in one form: whole numbers with all their digits and .0, others as short as they can be told apart."""
    whole = (value == F.floor(value)) & (F.abs(value) < float(1 << 63))
    return F.when(whole, F.concat(value.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))


#: Stands for a number in a line of JSON until its text is put there; no name is this character alone.
NUMBER = "\x01"


def sample_lines(points: DataFrame) -> DataFrame:
    """Points as lines of JSON; values as ``number_text`` has them, raw counters as text."""
    raw = [F.col("raw").cast("string").alias("raw")] if "raw" in points.columns else []
    line = F.struct(F.lit("sample").alias("type"), "host", F.col("segment").alias("boot"), *[c for c in ("activity", "item", "field") if c in points.columns], F.col("start_ust").alias("start"), F.col("end_ust").alias("end"), F.when(F.col("value").isNotNull(), NUMBER).alias("value"), *raw, F.coalesce("reason", F.lit("ok")).alias("quality"))
    return points.select(*[c for c in ("host", "activity", "item", "field") if c in points.columns], "end_ust", F.replace(F.to_json(line), F.lit('"\\u0001"'), F.coalesce(number_text(F.col("value")), F.lit(""))).alias("line"))


def raw_pairs(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Each raw value beside the one of the sample before: ``previous``, ``current``; the first of a segment has no previous one."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys, "segment").orderBy("sample_id")
    return samples.select(*keys, "segment", "sample_id", F.lag("raw").over(order).alias("previous"), F.col("raw").alias("current"))


def horizontal(points: DataFrame, names: list[str]) -> DataFrame:
    """A row per host, item and interval with a column for each of ``names`` (fields), null where there is no value."""
    columns = [F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names]
    return points.where(F.col("field").isin(names)).groupBy("host", "activity", "item", "start_ust", "end_ust").agg(*columns)


def chart_points(points: DataFrame, windows: DataFrame) -> DataFrame:
    """The points of each merged window (host, item, start_ust, end_ust), with the window's ends: the data of its chart."""
    w = windows.select("host", "item", F.col("start_ust").alias("chart_start"), F.col("end_ust").alias("chart_end"))
    return points.join(w, ["host", "item"]).where((F.col("end_ust") > F.col("chart_start")) & (F.col("start_ust") < F.col("chart_end")))


def nested_samples(points: DataFrame) -> DataFrame:
    """A line of JSON per host and sample: its activities, each with its items' values, in order of name; values as text.

    A sample's values are those of one host at one time, so their number is bounded by the host's devices.
    """
    value = F.struct("item", "field", number_text(F.col("value")).alias("value"))
    per = points.where(F.col("value").isNotNull()).groupBy("host", "end_ust", "activity").agg(F.array_sort(F.collect_list(value)).alias("values"))
    whole = per.groupBy("host", "end_ust").agg(F.array_sort(F.collect_list(F.struct("activity", "values"))).alias("activities"))
    return whole.select("host", "end_ust", F.to_json(F.struct("host", F.col("end_ust").alias("timestamp"), "activities")).alias("line"))


def lines(rows: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    """Any rows (summaries, detections) as lines of JSON with their ``type``, beside the keys."""
    return exact(rows).select(*keys, F.to_json(F.struct(F.lit(kind).alias("type"), *rows.columns)).alias("line"))
