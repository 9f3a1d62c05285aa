"""From files to points, and on to summaries, rules, detections and comparisons."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import catalog, detect, hosts, rules, series
from pulsegrid.operators.points import matched, items, points
from pulsegrid.sources.sa import read_sa

CPU, DISK, MEMORY, SWAP, QUEUE, NET, FAN = (1, 0x8B, (10, 0, 0), 80), (11, 0x8C, (1, 2, 6), 48), (7, 0x8B, (17, 0, 0), 136), (4, 0x8A, (0, 2, 0), 16), (9, 0x8C, (3, 0, 3), 40), (12, 0x8D, (7, 0, 1), 80), (31, 0x8A, (2, 0, 0), 40)
START = 1_700_000_000


def sa_bytes(activities, records, release=b"6.1", cpus=2):
    """A file of ``activities``; records are (kind, uptime in seconds, ust, items of each activity as (values, bytes after them))."""
    out = struct.pack("<HH4BII3I48x", 0xD596, 0x2175, 12, 6, 0, 0, 336, 0, 1, 1, 12)
    header = struct.pack("<QQIIi3I3IIII", records[0][2], 100, cpus, len(activities), 124, 0, 0, 9, 2, 0, 1, 36, 24, 0)
    header += struct.pack("BBb", 5, 6, 8) + b"".join(x.ljust(65, b"\0") for x in (b"Linux", b"host-a", release, b"x86_64")) + b"UTC".ljust(8, b"\0")
    out += header.ljust(336, b"\0") + b"".join(struct.pack("<IIiiiiIII", a, magic, 1, 1, 1, size, *types) for a, magic, types, size in activities)
    for kind, uptime, ust, content in records:
        out += struct.pack("<QQIBBBB", uptime * 100, ust, 0, kind, 1, 2, 3)
        if kind == 2:
            out += struct.pack("<I", content)
            continue
        for (_, _, types, size), own in zip(activities, content):
            out += struct.pack("<i", len(own))
            for values, after in own:
                out += (struct.pack(f"<{types[0] + types[1]}Q{types[2]}I", *values) + after).ljust(size, b"\0")
    return out


def cpu(user, idle, iowait=0):
    return [user, 0, 0, idle, iowait, 0, 0, 0, 0, 0], b""


def disk(minor, ios, sectors, ticks=0, busy=0):
    return [ios, sectors, 0, ticks, 0, busy, 0, 8, minor], b""


def memory(total, available):
    return [10, 1, 2, total, 50, 100, 0, 30, 0, 0, 0, 0, 0, 0, 0, 0, available], b""


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """Seven samples a minute apart; processor 1 is away in the third, disks change places, one is replaced, memory runs out."""
    path = tmp_path_factory.mktemp("sa") / "sa05"
    records = []
    for k in range(8):
        first, second = (100 * k + 50, 100 * k + 50), (0, 0) if k == 2 else (300 * k + 10, 100 * k + 10)
        whole = (first[0] + second[0], first[1] + second[1])
        disks = [disk(0, 60 * k, 120 * k, 30 * k, 600 * k), disk(16, 5 if k == 4 else 100 + k, 4 if k == 4 else 1000)]
        used = [memory(1000, 500 if k < 2 else 20)]
        swap, queue, fan = [([7 * k, 600 * k], b"")], [([9, 1, 100, 250, 0, 0], b"")], [(struct.unpack("<2Q", struct.pack("<2d", 1200.5 - k, 1000.0)), b"fan")]
        net = [([k, k, 1000 * k, 500 * k, 0, 0, 0, 100], b"eth0".ljust(16, b"\0") + b"\2")]
        records.append((1, 1000 + 60 * k, START + 60 * k, [[cpu(*whole), cpu(*first), cpu(*second)], disks[::-1] if k == 3 else disks, used, swap, queue, net, fan]))
    path.write_bytes(sa_bytes([CPU, DISK, MEMORY, SWAP, QUEUE, NET, FAN], records))
    return points(read_sa(spark, [str(path)])).cache()


def values(found, activity, item, field):
    rows = found.where((F.col("activity") == activity) & (F.col("item") == item) & (F.col("field") == field)).orderBy("sample_id").collect()
    return [r["value"] if r["reason"] is None else r["reason"] for r in rows]


def test_processors_are_shares_of_ticks(found):
    assert values(found, "CPU", "cpu0", "user") == ["first_sample"] + [50.0] * 7
    assert values(found, "CPU", "cpu1", "user") == ["first_sample", 75.0, "missing_in_sample", "missing_in_sample", 75.0, 75.0, 75.0, 75.0]
    # of both: 100 + 300 of 200 + 400 ticks; of the first alone where the second is away or was
    assert values(found, "CPU", "all", "user") == ["first_sample", pytest.approx(400 / 6), 50.0, 50.0, pytest.approx(400 / 6), pytest.approx(400 / 6), pytest.approx(400 / 6), pytest.approx(400 / 6)]


def test_columns_by_kind(found):
    assert values(found, "SWAP", "-", "pswpout") == ["first_sample"] + [10.0] * 7
    assert values(found, "QUEUE", "-", "ldavg_1") == [2.5] * 8 and values(found, "QUEUE", "-", "runq_sz") == [9.0] * 8
    assert values(found, "MEMORY", "-", "memused_pct") == [50.0] * 2 + [98.0] * 6 and values(found, "MEMORY", "-", "swpused_pct") == [50.0] * 8
    assert values(found, "DISK", "dev8-0", "read_kb_per_sec") == ["first_sample"] + [1.0] * 7
    assert values(found, "DISK", "dev8-0", "await") == ["first_sample"] + [0.5] * 7 and values(found, "DISK", "dev8-0", "avg_request_size") == ["first_sample"] + [1.0] * 7
    assert values(found, "DISK", "dev8-0", "util_pct") == ["first_sample"] + [1.0] * 7
    assert values(found, "NET_DEV", "eth0", "ifutil_pct") == ["first_sample"] + [pytest.approx(1000 / 60 * 800 / 1e8)] * 7
    assert values(found, "PWR_FAN", "0", "rpm") == [1200.5 - k for k in range(8)] and values(found, "PWR_FAN", "0", "rpm_delta") == [200.5 - k for k in range(8)]


def test_a_disk_that_comes_anew_is_replaced(found):
    ios = values(found, "DISK", "dev8-16", "tps")
    assert ios[:2] == ["first_sample", pytest.approx(1 / 60)] and ios[4] == "item_replaced"
    # its sectors didn't go back then: from 4 up to 1000 is growth
    assert ios[5] == pytest.approx(100 / 60) and values(found, "DISK", "dev8-16", "read_kb_per_sec")[4] == "item_replaced"


def test_rules_catalog_and_summaries_take_points(spark, found):
    processors = spark.createDataFrame([("host-a", 2)], "host string, cpus int")
    verdicts = {r["rule"]: r["verdict"] for r in rules.evaluate(found, processors).collect()}
    assert verdicts["memory-available-low"] == "observed" and verdicts["run-queue-saturation"] == "observed" and verdicts["swap-activity"] == "observed"
    assert verdicts["cpu-saturation"] == "not_observed" and verdicts["swap-space-used-high"] == "observed"
    conditions = {r["condition"] for r in catalog.fixed_conditions(found).collect()}
    assert {"memory-available-scarce", "swap-out-occurred", "swap-space-in-use"} <= conditions
    row = series.summarize(found).where("activity = 'SWAP' and field = 'pswpin'").first()
    assert (row["points"], row["observed"], row["missing"]) == (8, 7, 1) and row["max_value"] == pytest.approx(7 / 60)


def test_overflows_and_names_that_come_twice(spark):
    sample = "host string, segment long, sample_id long, ust long, uptime_cs decimal(20,0), activity string, item string, field string, raw decimal(20,0), bits int, item_index int, item_count int"
    from decimal import Decimal

    def rows(k, activity, own):
        return [("h", 0, k, 60 * k, Decimal(6000 * k), activity, item, f, Decimal(raw), 64, i, len(own)) for i, (item, fields) in enumerate(own) for f, raw in fields.items()]

    top = (1 << 64) - 1
    before = [("eth0", {"rxpck_per_sec": 5, "rx_bytes_per_sec": top - 10}), ("eth1", {"rxpck_per_sec": 5, "rx_bytes_per_sec": 900}), ("eth1", {"rxpck_per_sec": 70, "rx_bytes_per_sec": 1})]
    after = [("eth0", {"rxpck_per_sec": 9, "rx_bytes_per_sec": 5}), ("eth1", {"rxpck_per_sec": 9, "rx_bytes_per_sec": 800}), ("eth1", {"rxpck_per_sec": 6, "rx_bytes_per_sec": 901})]
    disks = [[("a", {"major": 8, "minor": m, "tps": t}) for m, t in own] for own in ([(0, 1), (1, 10), (1, 20)], [(1, 11), (1, 21), (0, 4)])]
    table = spark.createDataFrame(rows(0, "NET_DEV", before) + rows(1, "NET_DEV", after) + rows(0, "DISK", disks[0]) + rows(1, "DISK", disks[1]), sample)
    out = {(r["activity"], r["item_index"]): r for r in matched(items(table)).where("sample_id = 1").collect()}
    assert out["NET_DEV", 0]["broken"] is None  # may have overflown: its packets grew
    assert out["NET_DEV", 1]["broken"] == "item_replaced"
    assert out["NET_DEV", 2]["p"]["rxpck_per_sec"] == 5 and out["NET_DEV", 2]["broken"] is None  # a name means the first that has it
    # from its own place on, and then from the first
    assert [int(out["DISK", i]["p"]["tps"]) for i in range(3)] == [10, 10, 1]


def day_files(tmp_path):
    """Three files of a host: the second goes on, the third after a restart and has another release."""
    paths = []
    for n, (ust, up, release, again) in enumerate(((START, 1000, b"6.1", False), (START + 180, 1180, b"6.1", False), (START + 360, 5, b"6.2", True))):
        records = [(1, up + 60 * k, ust + 60 * k, [[([3 * (n * 3 + k), 0], b"")]]) for k in range(3)]
        if again:
            records.insert(0, (2, 0, ust - 30, 2))
        path = tmp_path / f"sa{n}"
        path.write_bytes(sa_bytes([SWAP], records, release))
        paths.append(str(path))
    return paths


@pytest.mark.parametrize("carry", [True, False])
def test_files_of_a_host_are_merged(spark, tmp_path, carry):
    paths = day_files(tmp_path)
    heads = hosts.sample_heads(read_sa(spark, paths, "records"), read_sa(spark, paths, "headers"))
    merged = points(hosts.merge_files(read_sa(spark, paths), heads, carry)).where("field = 'pswpin'")
    rows = merged.orderBy("sample_id").collect()
    assert [r["segment"] for r in rows] == [0] * 6 + [1] * 3
    between = None if carry else "file_boundary_unverified"
    assert [r["reason"] for r in rows] == ["first_sample", None, None, between, None, None, "restart", None, None]
    assert [r["value"] for r in rows if r["reason"] is None] == [pytest.approx(0.05)] * (7 if carry else 6)
    assert series.summarize(merged).first()["observed"] == (7 if carry else 6)


def test_baselines_are_exact(spark):
    r = np.random.default_rng(3)
    table = {"a": r.integers(0, 9, 301).astype(float), "b": r.normal(size=40), "c": np.ones(50), "d": r.normal(size=5), "e": np.append(np.zeros(95), r.normal(size=5))}
    rows = spark.createDataFrame([("h", k, float(v)) for k, own in table.items() for v in own] + [("h", "a", None)], "host string, item string, value double")
    found = detect.baselines(rows)
    assert "median(" not in found._jdf.queryExecution().toString() and "percentile" not in found._jdf.queryExecution().toString()
    found = {x["item"]: x for x in found.collect()}
    for k, own in table.items():
        middle = np.median(own)
        apart = np.abs(own - middle)
        assert (found[k]["n"], found[k]["off_centre"]) == (len(own), (apart > 0).sum())
        assert found[k]["median"] == pytest.approx(middle) and found[k]["mad"] == pytest.approx(np.median(apart))
    assert {k: x["state"] for k, x in found.items()} == {"a": "measured", "b": "measured", "c": "not_measurable", "d": "insufficient_samples", "e": "not_measurable"}


@pytest.mark.parametrize("width", [1, 2, 5, 8])
def test_sliding_medians(width):
    x = np.random.default_rng(width).integers(0, 20, 60).astype(float)
    assert detect.sliding_medians(x, width).tolist() == np.median(np.lib.stride_tricks.sliding_window_view(x, width), axis=1).tolist()


def test_every_reason_of_a_route(spark):
    from pulsegrid.plans import shifts

    rows = shifts.statuses(spark, "/root/testdata/sf0.01").collect()
    reasons = {r["reason"] for r in rows}
    assert reasons >= {"series_absent_from_source", "excluded_by_selection", "no_usable_observation", "no_fixed_condition_declared", "level_shift_not_declared", "dispersion_not_measurable", "too_few_baseline_samples", "no_window_long_enough", "window_spans_missing_samples", "no_magnitude_floor_declared"}
    assert {r["status"] for r in rows} >= {"detected", "evaluated", "evaluated_with_blind_edges", "not_evaluated"}


def test_marks_of_a_series_block_only_its_episodes(spark):
    found = spark.createDataFrame([("h", "a", 0, 50), ("h", "b", 10, 20), ("h", "c", 30, 60), ("h", "a", 500, 510)], "host string, item string, start_ust long, end_ust long")
    own = lambda marks: {(r["item"], r["start_ust"]): r["episode"] for r in detect.episodes(found, 100, 1000, spark.createDataFrame(marks, "host string, ust long, item string")).collect()}
    apart = {("a", 0): 1, ("b", 10): 1, ("c", 30): 1, ("a", 500): 2}
    assert own([("h", 25, "x"), ("g", 25, None)]) == apart
    assert own([("h", 55, "c")]) == {("a", 0): 1, ("b", 10): 1, ("c", 30): 2, ("a", 500): 3}
    assert own([("h", 15, None)]) == {("a", 0): 1, ("b", 10): 2, ("c", 30): 3, ("a", 500): 4}


def test_level_shifts_never_stand(spark):
    found = spark.createDataFrame([("h", "level_shift", 0, 100), ("h", "robust", 0, 95), ("h", "robust", 0, 50)], "host string, route string, start_ust long, end_ust long")
    assert [r["standing"] for r in detect.standing(found, F.lit(0), F.lit(100)).collect()] == [False, True, False]
