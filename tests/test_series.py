"""Operators on small hand-made series."""

import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import counters as fn
from pulsegrid.operators import detect, filters, series
from pulsegrid.sources import sinks
from pulsegrid.streaming.deltas import streaming_deltas

SAMPLES = "host string, item string, segment long, sample_id long, ust long, uptime_cs long, raw long, bits int"
ROWS = [
    ("h", "a", 0, 0, 60, 6000, 5, 32),
    ("h", "a", 0, 1, 120, 12000, (1 << 32) - 6, 32),
    ("h", "a", 0, 2, 180, 18000, 4, 32),
    ("h", "a", 1, 3, 240, 100, 7, 32),
    ("h", "a", 1, 5, 360, 12100, 9, 32),
    ("h", "b", 0, 0, 60, 6000, 5, 64),
    ("h", "b", 0, 1, 120, 6000, 6, 64),
    ("h", "b", 0, 2, 180, 18000, 2, 64),
]
EXPECTED = {
    ("a", 0): (None, "first_sample", 0),
    ("a", 1): ((1 << 32) - 11, None, 6000),
    ("a", 2): (10, None, 6000),
    ("a", 3): (None, "restart", 0),
    ("a", 5): (None, "item_replaced", 0),
    ("b", 0): (None, "first_sample", 0),
    ("b", 1): (None, "non_positive_elapsed", 0),
    ("b", 2): (None, "ambiguous_decrease", 12000),
}


def test_deltas(spark):
    found = series.deltas(spark.createDataFrame(ROWS, SAMPLES)).collect()
    assert {(r["item"], r["sample_id"]): (r["delta"], r["reason"], r["elapsed_cs"]) for r in found} == EXPECTED


def test_deltas_on_a_stream(spark, tmp_path):
    for k in range(2):  # the second file goes on where the first ends
        spark.createDataFrame([r for r in ROWS if (r[3] >= 2) == bool(k)], SAMPLES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SAMPLES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming_deltas(stream).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
    query.awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r["item"], r["sample_id"]): (r["delta"], r["reason"], r["elapsed_cs"]) for r in found} == EXPECTED


def test_missing_is_not_zero(spark):
    row = spark.range(1).select(
        fn.percent(F.lit(1), F.lit(0)).alias("a"),
        fn.memory_used_percent(F.lit(0), F.lit(0)).alias("b"),
        fn.mean_wait_ms(F.lit(10), F.lit(0)).alias("c"),
        fn.interface_busy_percent(F.lit(1), F.lit(1), F.lit(0), F.lit(True)).alias("d"),
        fn.interval_cs(F.lit(5), F.lit(5)).alias("e"),
        fn.native_interval_cs(F.lit(5), F.lit(5)).alias("f"),
        fn.native_interval_cs(F.lit(5), F.lit(9)).alias("g"),
    ).first()
    assert tuple(row) == (None, 0.0, 0.0, None, 1, 0, 0)


def test_no_sample_stops_the_run(spark):
    top = (1 << 64) - 1
    rows = [("h", "A", i, "x", 0, k, 60 * k, Decimal(u), Decimal(r), 64) for i, k, u, r in [("p", 0, 500, 0), ("p", 1, 400, 5), ("p", 2, top, 9), ("q", 0, 100, 0), ("q", 1, 200, top), ("q", 2, 300, 3), ("late", 2, 300, 1)]]
    found = series.rates(series.deltas(spark.createDataFrame(rows, "host string, activity string, item string, field string, segment long, sample_id long, ust long, uptime_cs decimal(20,0), raw decimal(20,0), bits int"))).collect()
    assert {(r["item"], r["sample_id"]): (None if r["delta"] is None else int(r["delta"]), r["reason"]) for r in found} == {
        ("p", 0): (None, "first_sample"),
        ("p", 1): (None, "non_positive_elapsed"),
        ("p", 2): (None, "non_positive_elapsed"),
        ("q", 0): (None, "first_sample"),
        ("q", 1): (top, None),
        ("q", 2): (None, "ambiguous_decrease"),
        ("late", 2): (None, "item_replaced"),
    }
    assert all((r["value"] is None) == (r["reason"] is not None) for r in found)


def points(spark, values, step=600):
    rows = [("h", "x", i * step, (i + 1) * step, step * 100, v, None if v is not None else "gap") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "host string, item string, start_ust long, end_ust long, elapsed_cs long, value double, reason string")


def test_a_missing_point_cuts_a_run(spark):
    found = series.hit_runs(points(spark, [9.0, 9.0, None, 9.0, 1.0]), F.col("value") > 5).orderBy("start_ust").collect()
    assert [(r["start_ust"], r["points"]) for r in found] == [(0, 2), (1800, 1)]
    assert series.longest_run(points(spark, [9.0, 1.0, 9.0]), F.col("value") > 5).first()["start_ust"] == 0


def test_flat_series_have_no_dispersion(spark):
    state = lambda values: detect.baselines(points(spark, values)).first()["state"]
    assert state([1.0] * 5) == "insufficient_samples"
    assert state([1.0] * 20) == "not_measurable"
    assert state([float(i) for i in range(20)]) == "measured"


def test_level_shift(spark):
    values = [10.0] * 12 + [50.0] * 12
    found = detect.level_shifts(points(spark, values), 20.0).collect()
    assert [(r["start_ust"], r["shift"]) for r in found] == [(12 * 600, 40.0)]
    assert detect.level_shifts(points(spark, [float(i) for i in range(24)]), 3.0).count() == 0  # a trend is no step
    fixed = detect.window_shifts(points(spark, values), 5, 20.0).collect()
    assert [r["start_ust"] for r in fixed] == [10 * 600]  # the first of equal shifts


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_level_shifts_do_not_depend_on_blocks(spark, block):
    values = [10.0 + i % 3 for i in range(30)] + [60.0 + i % 2 for i in range(25)] + [5.0] * 20
    found = detect.level_shifts(points(spark, values), 20.0, block).orderBy("start_ust").collect()
    assert [r["start_ust"] for r in found] == [30 * 600, 55 * 600]


def test_marks_end_episodes(spark):
    rows = [("h", "x", t, t + 10) for t in (0, 50, 100, 150)] + [("i", "x", 0, 5), ("i", "x", 120, 130)]
    found = spark.createDataFrame(rows, "host string, item string, start_ust long, end_ust long")
    marks = spark.createDataFrame([("h", 75), ("i", 500)], "host string, ust long")
    out = detect.episodes(found, 60, 1000, marks).orderBy("host", "start_ust").collect()
    assert [r["episode"] for r in out] == [1, 1, 2, 2, 1, 2]
    limits = detect.episode_limits(points(spark, [1.0] * 100)).first()
    assert tuple(limits) == (1200, 15000)


def test_episodes_end_at_gap_or_span(spark):
    rows = [("h", "x", t, t + 10) for t in (0, 50, 100, 150, 400)]
    found = detect.episodes(spark.createDataFrame(rows, "host string, item string, start_ust long, end_ust long"), 60, 120).orderBy("start_ust").collect()
    assert [r["episode"] for r in found] == [1, 1, 1, 2, 3]


def test_thinning_where_uptime_goes_back(spark):
    """Whole differences leave the sample out whose uptime went back; those of 32 bits take it as of a very long interval."""
    uptimes = [100000, 160000, 220000, 200000, 1 << 32, (1 << 32) + 300000, 80000, 99000]
    rows = spark.createDataFrame([("h", 0, i, cs) for i, cs in enumerate(uptimes)], "host string, segment long, sample_id long, uptime_cs long")
    own = lambda wraps: sorted(r["sample_id"] for r in filters.thinned(rows, 1200, wraps).collect())

    def reference(k):  # as the files' own tools count
        seconds = lambda cs: (cs + 50) // 100
        as_int = lambda x: (x + (1 << 31)) % (1 << 32) - (1 << 31)
        step, at = (seconds((uptimes[k] - uptimes[j]) % (1 << 32)) for j in (k - 1, 0))
        low, high = as_int(at - step // 2), as_int(at + step // 2 + step % 2)
        return any(low <= as_int(at // 1200 * 1200 + more) < high for more in (0, 1200))

    assert own(True) == [k for k in range(1, len(uptimes)) if reference(k)]
    # 7 is before the first sample and near it
    assert own(False) == [2, 4, 5, 7]
    assert 3 in own(True) and 6 in own(True)


@pytest.mark.parametrize("folded", [4, 10000])
def test_episodes_do_not_depend_on_blocks(spark, monkeypatch, folded):
    monkeypatch.setattr(detect, "FOLDED", folded)
    rng = random.Random(7)
    rows, marks = [], []
    for host in "ab":
        at = 0
        for _ in range(150):
            at += rng.choice([0, 5, 20, 50, 61, 200])
            rows.append((host, rng.choice("xyz"), at, at + rng.choice([5, 60, 400])))
            if rng.random() < 0.3:
                marks.append((host, at + rng.choice([0, 3, 20]), rng.choice([None, "x", "y"])))
    out = detect.episodes(spark.createDataFrame(rows, "host string, item string, start_ust long, end_ust long"), 60, 300, spark.createDataFrame(marks, "host string, ust long, item string"))
    expected = []
    for host in "ab":
        own, episode, last = sorted({(at, end, item) for h, item, at, end in rows if h == host}), 0, None
        for at, end, item in own:
            joins = last is not None and at - last <= 60 and at - first <= 300
            joins = joins and not any(h == host and first < ust <= max(covered, end) and (of is None or of in held | {item}) for h, ust, of in marks)
            if joins:
                covered, held = max(covered, end), held | {item}
            else:
                episode, first, covered, held = episode + 1, at, end, {item}
            last = at
            expected.append((host, item, at, end, episode))
    assert sorted(tuple(r) for r in out.select("host", "item", "start_ust", "end_ust", "episode").collect()) == sorted(expected)


def test_many_short_stretches_take_no_longer_than_one_long(spark):
    """A call for each stretch took 7 ms; 2500 of them took far longer than all in one."""

    def seconds(step):
        rows = spark.range(2500).select(F.lit("h").alias("host"), F.lit("x").alias("item"), (F.col("id") * step).alias("start_ust"), (F.col("id") * step + 5).alias("end_ust"))
        began = time.monotonic()
        assert detect.episodes(rows, 60, 10**9).agg(F.max("episode")).first()[0] == (1 if step <= 60 else 2500)
        return time.monotonic() - began

    seconds(10)
    assert seconds(100) < 3 * seconds(10) + 2


def test_percentile_is_exact_and_refuses_large_series(spark):
    rows = points(spark, [float(i) for i in range(1, 101)]).withColumn("one", F.lit(1))
    assert series.weighted_percentile(rows, 0.95, "one").first()["percentile"] == 95.0
    assert series.weighted_percentile(rows, 0.95, "one", cap=50).first()["percentile"] is None


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("h", Decimal(2**64 - 1), 1.5)], "host string, raw decimal(20,0), value double")
    sinks.write_ndjson(rows, f"{tmp_path}/n")
    assert spark.read.text(f"{tmp_path}/n").first()[0] == '{"host":"h","raw":"18446744073709551615","value":1.5}'
    sinks.write_csv(rows, f"{tmp_path}/c")
    sinks.write_xml(rows, f"{tmp_path}/x")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first()["raw"] == "18446744073709551615"
    with pytest.raises(Exception, match="already exists"):
        sinks.write_csv(rows, f"{tmp_path}/c")
    assert [tuple(r) for r in sinks.as_pairs(rows, ["host"]).collect()] == [("h", "value", 1.5)]
