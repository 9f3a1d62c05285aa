import struct

import pytest

from pulsegrid.operators import series
from pulsegrid.sources.sa import BadFile, Decoder, daily_files, identify, read_sa


def sa_file(order="<", cut=0, long_size=8, act_extra=0):
    """Bytes of a small file, written field by field."""
    out = struct.pack(order + "HH4BII3I48x", 0xD596, 0x2175, 12, 6, 0, 0, 336, 0, 1, 1, 12)
    header = struct.pack(order + "QQIIi3I3IIII", 1_700_000_000, 100, 2, 3, 124, 0, 0, 9, 2, 0, 1, 36 + act_extra, 24, 0)
    header += struct.pack("BBb", 5, 6, long_size) + b"".join(x.ljust(65, b"\0") for x in (b"Linux", b"host-a", b"6.1", b"x86_64")) + b"UTC".ljust(8, b"\0")
    out += header.ljust(336, b"\0")
    for name, nr, has_nr, size, types in ((1, 2, 1, 80, (10, 0, 0)), (77, 1, 0, 12, (1, 0, 1)), (4, 1, 0, 16, (0, 2, 0))):
        out += struct.pack(order + "IIiiiiIII", name, 0x8A, nr, 1, has_nr, size, *types) + b"\0" * act_extra
    record = lambda kind, uptime, ust: struct.pack(order + "QQIBBBB", uptime, ust, 0, kind, 1, 2, 3)
    for k in range(3):
        out += record(1, 1000 + 6000 * k, 1_700_000_000 + 60 * k) + struct.pack(order + "I", 2)
        for cpu in range(2):
            out += struct.pack(order + "10Q", *((1 << 64) - 1 - k if f == 0 else 100 * k + 10 * cpu + f for f in range(10)))
        out += b"\7" * 12 + struct.pack(order + "QQ", 5 * k, 7 * k)
        if k == 1:
            out += record(4, 0, 1_700_000_070) + b"a note".ljust(64, b"\0") + record(2, 0, 1_700_000_080) + struct.pack(order + "I", 4)
    return out[: len(out) - cut]


@pytest.mark.parametrize("order", ["<", ">"])
def test_samples_and_events(spark, tmp_path, order):
    path = tmp_path / "sa05"
    path.write_bytes(sa_file(order, act_extra=4))
    rows = read_sa(spark, [str(path)]).collect()
    assert len(rows) == 3 * (2 * 10 + 2)
    user = sorted((r["sample_id"], r["item"], int(r["raw"])) for r in rows if r["field"] == "user")
    assert user == [(k, c, (1 << 64) - 1 - k) for k in range(3) for c in ("all", "cpu0")]
    assert {r["segment"] for r in rows if r["sample_id"] == 2} == {1} and {r["host"] for r in rows} == {"host-a"}
    assert [int(r["raw"]) for r in sorted(rows, key=lambda r: r["sample_id"]) if r["field"] == "pswpout"] == [0, 7, 14]
    events = read_sa(spark, [str(path)], "events").orderBy("ust").collect()
    assert [(r["kind"], r["cpu_count"], r["text"]) for r in events] == [("comment", None, "a note"), ("restart", 4, None)]
    found = identify(spark, str(tmp_path)).collect()
    assert [(r["order"], r["magic"]) for r in found] == [("little" if order == "<" else "big", 0x2175)]


def test_longs_of_32_bit_machines_wrap_at_32():
    rows = {x[4]: x[8] for x in Decoder(sa_file(long_size=4)).samples()}
    assert set(rows["SWAP"]) == {32} and set(rows["CPU"]) == {64}


def test_only_what_is_wanted_is_decoded(spark, tmp_path):
    path = tmp_path / "sa05"
    path.write_bytes(sa_file())
    rows = read_sa(spark, [str(path)], activities=["SWAP", "CPU"], fields=["pswpin", "idle"], first_record=1, last_record=1).collect()
    assert sorted((r["sample_id"], r["activity"], r["item"], r["field"], int(r["raw"])) for r in rows) == [(1, "CPU", "all", "idle", 103), (1, "CPU", "cpu0", "idle", 113), (1, "SWAP", "-", "pswpin", 5)]
    head = read_sa(spark, [str(path)], "headers").first()
    assert (head["host"], head["machine"], head["cpus"], head["year"], head["month"], head["day"], head["activities"]) == ("host-a", "x86_64", 2, 2024, 7, 5, "CPU 77 SWAP")
    records = read_sa(spark, [str(path)], "records").orderBy("offset").collect()
    assert [(r["kind"], r["number"], r["segment"]) for r in records] == [(1, 0, 0), (1, 1, 0), (4, 2, 0), (2, 2, 1), (1, 2, 1)]


def test_runs_of_samples_are_as_one_by_one():
    from bench import activity_file

    data = activity_file(7, 3)
    at = data.rindex(b"eth5")
    data = data[:at] + b"new5" + data[at + 4 :]  # a name changes in the last sample
    rows = lambda file, n: sorted((i, a, item, f, v[k, y, z]) for _, number, _, _, a, items, fields, v, _ in file.samples(n) for k, i in enumerate(number.tolist()) for y, item in enumerate(items) for z, f in enumerate(fields))
    together = rows(Decoder(data), None)
    assert together == sorted(x for i in range(7) for x in rows(Decoder(data), range(i, i + 1)))
    assert {item for i, a, item, *_ in together if a == "NET_DEV" and i == 6} - {item for i, a, item, *_ in together if a == "NET_DEV" and i == 5} == {"new5"}


def test_samples_feed_deltas_and_summaries(spark, tmp_path):
    path = tmp_path / "sa05"
    path.write_bytes(sa_file())
    points = series.rates(series.deltas(read_sa(spark, [str(path)])))
    counts = {r["reason"]: r["count"] for r in points.groupBy("reason").count().collect()}
    assert counts == {"first_sample": 22, None: 20, "ambiguous_decrease": 2, "restart": 22}
    row = series.summarize(points).where("activity = 'SWAP' and field = 'pswpout'").first()
    assert (row["host"], row["item"], row["points"], row["observed"]) == ("host-a", "-", 3, 1) and row["max_value"] == pytest.approx(7 / 60)


@pytest.mark.parametrize("nr", [-1, 1 << 20])
def test_counts_of_items_are_checked(spark, tmp_path, nr):
    data = bytearray(sa_file())
    at = 76 + 336 + 3 * 36 + 24
    data[at : at + 4] = struct.pack("<i", nr)
    with pytest.raises(BadFile):
        list(Decoder(bytes(data)).walk())
    (tmp_path / "a").write_bytes(bytes(data))
    (tmp_path / "b").write_bytes(sa_file()[: 76 + 336 + 50])  # cut inside the table of activities
    (tmp_path / "c").write_bytes(sa_file())
    paths = [str(tmp_path / n) for n in "abc"]
    assert {r["path"][-1] for r in read_sa(spark, paths, mode="PERMISSIVE").collect()} == {"c"}
    assert {r["path"][-1] for r in read_sa(spark, paths, "skipped").collect()} == {"a", "b"}


def test_cut_off_and_foreign_files(spark, tmp_path):
    cut = sa_file(cut=10)
    assert max(n for x in Decoder(cut).samples() for n in x[1].tolist()) == 1
    with pytest.raises(BadFile):
        list(Decoder(cut, lenient=False).walk())
    for bad in (b"", b"x" * 500, sa_file()[:200]):
        with pytest.raises(BadFile):
            Decoder(bad)
    (tmp_path / "a").write_bytes(sa_file())
    (tmp_path / "b").write_bytes(b"x" * 500)
    paths = [str(tmp_path / n) for n in "ab"]
    assert read_sa(spark, paths, mode="PERMISSIVE").select("path").distinct().count() == 1
    with pytest.raises(Exception, match="no activity file"):
        read_sa(spark, paths).count()


def test_files_of_a_day(spark, tmp_path):
    import datetime
    import os

    for name, changed in (("sa05", "2024-07-05"), ("sa20240705", "2024-08-01"), ("sa06", "2024-07-06"), ("sar05", "2024-07-05"), ("old/sa05", "2024-06-05")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(sa_file())
        at = datetime.datetime.fromisoformat(f"{changed}T23:50:00+00:00").timestamp()
        os.utime(path, (at, at))
    names = lambda folder, day: sorted(r["path"].rsplit("/", 1)[1] for r in daily_files(spark, str(folder), day).collect())
    assert names(tmp_path, "2024-07-05") == ["sa05", "sa20240705"]
    assert names(tmp_path / "old", "2024-07-05") == [] and names(tmp_path, "2024-07-07") == []


def items_file(activity, magic, types, items, size=None, nr2=1, records=2):
    """A file of one activity: ``items`` are lists of values in the order of the file, with bytes after them."""
    width = size or 8 * (types[0] + types[1]) + 4 * types[2]
    out = struct.pack("<HH4BII3I48x", 0xD596, 0x2175, 12, 6, 0, 0, 336, 0, 1, 1, 12)
    header = struct.pack("<QQIIi3I3IIII", 1_700_000_000, 100, 2, 1, 124, 0, 0, 9, 2, 0, 1, 36, 24, 0)
    header += struct.pack("BBb", 5, 6, 8) + b"".join(x.ljust(65, b"\0") for x in (b"Linux", b"host-a", b"6.1", b"x86_64")) + b"UTC".ljust(8, b"\0")
    out += header.ljust(336, b"\0") + struct.pack("<IIiiiiIII", activity, magic, len(items) // nr2, nr2, 1, width, *types)
    for k in range(records):
        out += struct.pack("<QQIBBBB", 1000 + 6000 * k, 1_700_000_000 + 60 * k, 0, 1, 1, 2, 3) + struct.pack("<i", len(items) // nr2)
        for values, after in items:
            out += (struct.pack(f"<{types[0] + types[1]}Q{types[2]}I", *values) + after).ljust(width, b"\0")
    return out


def decoded(data):
    """{item: {field: value}} of the first sample."""
    out = {}
    for _, _, _, _, _, items, fields, values, _ in Decoder(data).samples(range(1)):
        for i, item in enumerate(items):
            out.setdefault(item, {}).update(zip(fields, values[0, i].tolist()))
    return out


DISK_NEW = "tps wwn_high wwn_low read_sectors write_sectors discard_sectors read_ticks write_ticks tot_ticks rq_ticks major minor discard_ticks partition_nr".split()


@pytest.mark.parametrize(
    ("activity", "magic", "types", "size", "fields", "items"),
    [
        (11, 0x8C, (3, 3, 8), 80, DISK_NEW, ["dev11-12"]),
        (11, 0x8C, (1, 3, 7), 64, [f for f in DISK_NEW if f not in ("wwn_high", "wwn_low", "partition_nr")], ["dev9-10"]),
        (11, 0x8C, (1, 2, 6), 48, "tps read_sectors write_sectors read_ticks write_ticks tot_ticks rq_ticks major minor".split(), ["dev8-9"]),
        (3, 0x8B, (1, 0, 0), 8, ["intr"], ["sum"]),
        (5, 0x8A, (0, 8, 0), 64, "pgpgin pgpgout fault majflt pgfree pgscank pgscand pgsteal".split(), ["-"]),
        (6, 0x8B, (5, 0, 0), 40, "tps rtps wtps bread bwrtn".split(), ["-"]),
        (34, 0x8B, (2, 0, 0), 16, ["kbhugfree", "kbhugtotal"], ["-"]),
        (39, 0x8A, (0, 0, 5), 20, "total_per_sec dropd_per_sec squeezd_per_sec rx_rps_per_sec flw_lim_per_sec".split(), ["all"]),
        # a newer one of the same magic: what is known of each width, by its place
        (4, 0x8A, (0, 3, 1), 32, ["pswpin", "pswpout"], ["-"]),
    ],
)
def test_revisions_are_read_by_their_own_layout(activity, magic, types, size, fields, items):
    found = decoded(items_file(activity, magic, types, [(range(1, sum(types) + 1), b"")], size))
    assert list(found) == items and list(found[items[0]]) == fields
    if sum(types) == len(fields):
        assert list(found[items[0]].values()) == list(range(1, len(fields) + 1))


def test_names_of_interrupts_slots_and_interfaces():
    plain = decoded(items_file(3, 0x8B, (1, 0, 0), [([k], b"") for k in (9, 4, 5)]))
    assert {i: v["intr"] for i, v in plain.items()} == {"sum": 9, "0": 4, "1": 5}
    rows = [([k], n.ljust(8, b"\0")) for k, n in enumerate((b"sum", b"NMI", b"", b"", b"", b""))]
    assert list(decoded(items_file(3, 0x8C, (0, 0, 1), rows, 12, nr2=2))) == ["sum", "NMI", "sum/cpu0", "NMI/cpu0", "sum/cpu1", "NMI/cpu1"]
    assert list(decoded(items_file(35, 0x8B, (1, 1, 0), [([1, 2], b"")] * 4, nr2=2))) == ["all/0", "all/1", "cpu0/0", "cpu0/1"]
    net = decoded(items_file(12, 0x8D, (7, 0, 1), [(range(8), b"eth0".ljust(16, b"\0") + b"\2")], 80))
    assert net["eth0"]["duplex"] == 2 and net["eth0"]["speed"] == 7


def test_what_is_not_read_has_a_reason(spark, tmp_path):
    (tmp_path / "a").write_bytes(items_file(11, 0x99, (2, 1, 1), [([1, 2, 3, 4], b"")]))
    (tmp_path / "b").write_bytes(items_file(77, 0x8A, (1, 0, 0), [([1], b"")]))
    paths = [str(tmp_path / n) for n in "ab"]
    found = {r["number"]: r for r in read_sa(spark, paths, "structure").collect()}
    assert found[11]["reason"] == "unknown revision 0x99 [2, 1, 1]" and found[77]["reason"] == "unknown activity"
    assert (found[11]["activity"], found[11]["wide"], found[11]["longs"], found[11]["ints"], found[11]["item_bytes"]) == ("DISK", 2, 1, 1, 28)
    assert read_sa(spark, paths).count() == 0


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_conditions_are_pushed_down(pushing, tmp_path, capsys):
    path = tmp_path / "sa05"
    path.write_bytes(sa_file())
    every = read_sa(pushing, [str(path)], pushdown="true")
    rows = every.where("activity = 'SWAP' and field in ('pswpin', 'idle') and ust >= 1700000060 and raw > 0")
    rows.explain("formatted")
    plan = capsys.readouterr().out
    conditions = [x for x in plan.splitlines() if x.startswith("Condition")]
    assert all("SWAP" not in c and "pswpin" not in c and "1700000060" not in c for c in conditions)
    assert sorted((r["sample_id"], r["field"], int(r["raw"])) for r in rows.collect()) == [(1, "pswpin", 5), (2, "pswpin", 10)]


def test_large_files_are_split_and_small_ones_bundled(spark, tmp_path, monkeypatch):
    from bench import activity_file
    from pulsegrid.sources import sa

    monkeypatch.setattr(sa, "WINDOW", 5000)
    data = activity_file(60, 3)
    path = tmp_path / "large"
    path.write_bytes(data)
    whole = sorted(map(tuple, sa.read_sa(spark, [str(path)]).collect()))
    parts = sa.read_sa(spark, [str(path)], split_bytes=len(data) // 10)
    assert 8 <= parts.rdd.getNumPartitions() <= 10 and sorted(map(tuple, parts.collect())) == whole
    small = list(sa.Decoder(sa.Stored(str(path))).samples())  # window by window
    assert sum(x[7].size for x in small) == len(whole) and len(small) > len(list(sa.Decoder(data).samples()))
    sizes = {str(k): 600_000 for k in range(10_000)}
    held = list(sa.bundles(sizes, sa.SPLIT))
    assert sum(map(len, held)) == 10_000 and len(held) < 800


def test_segments_of_parts_count_on(spark, tmp_path):
    path = tmp_path / "sa05"
    path.write_bytes(sa_file())
    for size in (50, 150, 400):
        parts = read_sa(spark, [str(path)], split_bytes=size)
        assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, read_sa(spark, [str(path)]).collect()))
