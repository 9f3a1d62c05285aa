"""Reader of binary activity files: ``spark.read.format("sa").load(...)``, filters, small files together, large ones in parts.

The self-describing format (0x2175) is decoded: a 76-byte magic, a header, a table of activities and
records. Each statistics item is n0 64-bit, n1 long and n2 32-bit unsigned integers and then bytes;
the table says how many, so unknown activities are skipped by their size. Other registered formats
are identified (``identify``) but not decoded.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: The format's constants.
FILE_MAGIC = 0xD596
MAGIC_SIZE, ACTIVITY_SIZE, RECORD_SIZE, COMMENT_SIZE, EXTRA_SIZE = 76, 36, 24, 64, 24
STATS, RESTART, LAST_STATS, COMMENT = 1, 2, 3, 4
SELF_DESCRIBING = 0x2175
FIXED_FORMATS = {0x216F: "8.1.1..8.1.2", 0x1170: "9.0.4", 0x2170: "..9.1.5", 0x2171: "9.1.6..10.2.x", 0x2173: "10.3.1..11.6.x", 0x2175: "11.7.x..12.8.x"}
#: Fixed values, of each activity: its name, how its items are named, and its revisions, the newest first: magic and the
#: fields of an item in the order of the file, 64-bit, long and 32-bit ones.
#: Items are named by position (``cpu``: all, cpu0, ...; ``irq``: sum, 0, ...), by the text after the fields (``text``), by
#: device number (``disk``), by processor and slot (``slot``) or not (``one``).
ACTIVITIES = {
    1: ("CPU", "cpu", [(0x8B, "user nice sys idle iowait steal irq soft guest gnice", "", "")]),
    2: ("PCSW", "one", [(0x8B, "cswch", "proc", "")]),
    3: ("IRQ", "irq", [(0x8C, "", "", "intr"), (0x8B, "intr", "", "")]),
    4: ("SWAP", "one", [(0x8A, "", "pswpin pswpout", "")]),
    5: ("PAGE", "one", [(0x8A, "", "pgpgin pgpgout fault majflt pgfree pgscank pgscand pgsteal pgprom pgdem", ""), (0x8A, "", "pgpgin pgpgout fault majflt pgfree pgscank pgscand pgsteal", "")]),
    6: ("IO", "one", [(0x8B, "tps rtps wtps bread bwrtn dtps bdscd", "", ""), (0x8B, "tps rtps wtps bread bwrtn", "", "")]),
    7: (
        "MEMORY",
        "one",
        [
            (0x8B, "kbmemfree kbbuffers kbcached kbmemtotal kbswpfree kbswptotal kbswpcad kbcommit kbactive kbinact kbdirty kbanonpg kbslab kbkstack kbpgtbl kbvmused kbavail kbshmem", "", ""),
            (0x8B, "kbmemfree kbbuffers kbcached kbmemtotal kbswpfree kbswptotal kbswpcad kbcommit kbactive kbinact kbdirty kbanonpg kbslab kbkstack kbpgtbl kbvmused kbavail", "", ""),
        ],
    ),
    8: ("KTABLES", "one", [(0x8B, "file_nr inode_nr dentunusd pty_nr", "", "")]),
    9: ("QUEUE", "one", [(0x8C, "runq_sz blocked plist_sz", "", "ldavg_1 ldavg_5 ldavg_15")]),
    10: ("SERIAL", "index", [(0x8B, "", "", "rcvin xmtin framerr prtyerr brk ovrun line")]),
    11: (
        "DISK",
        "disk",
        [
            (0x8C, "tps wwn_high wwn_low", "read_sectors write_sectors discard_sectors", "read_ticks write_ticks tot_ticks rq_ticks major minor discard_ticks partition_nr"),
            (0x8C, "tps", "read_sectors write_sectors discard_sectors", "read_ticks write_ticks tot_ticks rq_ticks major minor discard_ticks"),
            (0x8C, "tps", "read_sectors write_sectors", "read_ticks write_ticks tot_ticks rq_ticks major minor"),
        ],
    ),
    12: ("NET_DEV", "text", [(0x8D, "rxpck_per_sec txpck_per_sec rx_bytes_per_sec tx_bytes_per_sec rxcmp_per_sec txcmp_per_sec rxmcst_per_sec", "", "speed")]),
    13: ("NET_EDEV", "text", [(0x8C, "coll_per_sec rxerr_per_sec txerr_per_sec rxdrop_per_sec txdrop_per_sec rxfifo_per_sec txfifo_per_sec rxfram_per_sec txcarr_per_sec", "", "")]),
    14: ("NET_NFS", "one", [(0x8A, "", "", "call_per_sec retrans_per_sec read_per_sec write_per_sec access_per_sec getatt_per_sec")]),
    16: ("NET_SOCK", "one", [(0x8A, "", "", "totsck tcpsck tcp_tw udpsck rawsck ip_frag")]),
    30: ("PWR_CPU", "cpu", [(0x8A, "", "mhz", "")]),
    31: ("PWR_FAN", "index", [(0x8A, "rpm rpm_min", "", "")]),
    32: ("PWR_TEMP", "index", [(0x8A, "temp_celsius temp_min temp_max", "", "")]),
    33: ("PWR_IN", "index", [(0x8A, "volts volts_min volts_max", "", "")]),
    34: ("HUGE", "one", [(0x8B, "kbhugfree kbhugtotal kbhugrsvd kbhugsurp", "", ""), (0x8B, "kbhugfree kbhugtotal", "", "")]),
    35: ("PWR_FREQ", "slot", [(0x8B, "time_in_state", "freq_khz", "")]),
    37: ("FS", "text", [(0x8B, "fs_total fs_free fs_available inodes_total inodes_free", "", "")]),
    39: ("NET_SOFT", "cpu", [(0x8A, "", "", "total_per_sec dropd_per_sec squeezd_per_sec rx_rps_per_sec flw_lim_per_sec blg_len"), (0x8A, "", "", "total_per_sec dropd_per_sec squeezd_per_sec rx_rps_per_sec flw_lim_per_sec")]),
    40: ("PSI_CPU", "one", [(0x8A, "scpu", "scpu_10 scpu_60 scpu_300", "")]),
    41: ("PSI_IO", "one", [(0x8A, "sio fio", "sio_10 sio_60 sio_300 fio_10 fio_60 fio_300", "")]),
    42: ("PSI_MEM", "one", [(0x8A, "smem fmem", "smem_10 smem_60 smem_300 fmem_10 fmem_60 fmem_300", "")]),
}
#: Single bytes after the text of an item.
BYTES_AFTER = {"NET_DEV": ["duplex"]}
#: Bytes of the text that names an item.
NAME_SIZES = {"IRQ": 8, "NET_DEV": 16, "NET_EDEV": 16, "FS": 128}
#: Most items, slots of an item and bytes of an item that a file may declare.
MOST_ITEMS, MOST_SLOTS, MOST_BYTES = 1 << 17, 4096, 8192
BATCH_VALUES = 100_000
#: Bytes of a file that a task holds at once, and of a partition; a file counts as so many more.
WINDOW = 8 << 20
SPLIT, OPEN_COST = 64 << 20, 4 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

SAMPLES = "path string, host string, segment long, sample_id long, ust long, uptime_cs decimal(20,0), activity string, item string, field string, raw decimal(20,0), bits int, item_index int, item_count int"
EVENTS = "path string, host string, ust long, kind string, cpu_count int, text string"
HEADERS = "path string, host string, sysname string, release string, machine string, format int, ust long, hz long, cpus long, year int, month int, day int, long_size int, activities string"
RECORDS = "path string, host string, number long, segment long, kind int, ust long, uptime_cs decimal(20,0), hour int, minute int, second int, offset long"
SKIPPED = "path string, reason string"
STRUCTURE = "path string, host string, number int, activity string, magic int, items int, slots int, has_count boolean, item_bytes int, wide int, longs int, ints int, fields string, reason string"
SPLITS = "path string, start long, end long, segment long, number long"
SCHEMAS = {"samples": SAMPLES, "events": EVENTS, "headers": HEADERS, "records": RECORDS, "skipped": SKIPPED, "structure": STRUCTURE, "splits": SPLITS}


class BadFile(ValueError):
    pass


def text_of(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("utf-8", "replace")


def stretches(chosen: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each stretch that is chosen, of 4096 at most."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], chosen, [False]]).astype(np.int8)))
    return [(k, min(k + 4096, b)) for a, b in edges.reshape(-1, 2).tolist() for k in range(a, b, 4096)]


class Whole:
    """A file that is in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def window(self, at: int, least: int) -> tuple[int, bytes]:
        return 0, self.data


class Stored:
    """A file wherever it is, of which a window is held at a time."""

    def __init__(self, path: str):
        from pyarrow import fs

        files, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.file = files.open_input_file(inner)
        self.size = self.file.size()

    def window(self, at: int, least: int) -> tuple[int, bytes]:
        """A place at or before ``at``, and the bytes from there: ``least`` of them, or up to the end."""
        return at, self.file.read_at(min(max(least, WINDOW), self.size - at), at)


class Layout:
    """How an activity's items lie in this file: ``fields`` are (name, which of the values, bits); ``reason`` why they can't be read."""

    def __init__(self, own: tuple, long_size: int):
        number, magic, _, _, _, self.size, *self.types = own
        self.activity, self.named, self.fields, self.reason = str(number), "index", [], None
        if number not in ACTIVITIES:
            self.reason = "unknown activity"
            return
        self.activity, self.named, revisions = ACTIVITIES[number]
        groups = [(m, [g.split() for g in groups]) for m, *groups in revisions]
        same = [g for _, g in groups if [len(x) for x in g] == self.types] or [g for m, g in groups if m == magic]
        if not same:
            self.reason = f"unknown revision {magic:#x} {self.types}"
            return
        # of each width as many as the file has; a width's later fields are newer
        wide, longs, ints = self.types
        first = 0
        for names, n, bits in zip(same[0], self.types, (64, 8 * long_size, 32)):
            # a long of a 32-bit machine takes 8 bytes in the file and wraps at 32 bits
            self.fields += [(name, first + k, bits) for k, name in enumerate(names[:n])]
            first += n
        self.end = 8 * (wide + longs) + 4 * ints


class Decoder:
    """One file. ``lenient``: a cut-off tail ends the file; else it is an error.

    ``activities`` and ``fields``, if given, are the names of those wanted; others are skipped by their size.
    """

    def __init__(self, data: bytes | Whole | Stored, lenient: bool = True, activities: set[str] | None = None, fields: set[str] | None = None):
        self.source = data if isinstance(data, (Whole, Stored)) else Whole(data)
        self.lenient, self.wanted, self.fields = lenient, activities, fields
        try:
            self._open(self.source.window(0, WINDOW)[1])
        except struct.error as error:
            raise BadFile("the head is cut off") from error

    def _open(self, data: bytes) -> None:
        if len(data) < MAGIC_SIZE:
            raise BadFile("shorter than its magic")
        for order in "<>":
            if struct.unpack_from(order + "H", data)[0] == FILE_MAGIC:
                break
        else:
            raise BadFile("no activity file")
        self.order = order
        self.format, = struct.unpack_from(order + "H", data, 2)
        if self.format != SELF_DESCRIBING:
            raise BadFile(f"format {self.format:#x} is not decoded")
        header_size, = struct.unpack_from(order + "I", data, 8)
        if not 336 <= header_size <= 8192 or MAGIC_SIZE + header_size > len(data):
            raise BadFile("header size")
        at = MAGIC_SIZE
        self.ust, self.hz, self.cpus, activities, self.year = struct.unpack_from(order + "QQIIi", data, at)
        activity_size, record_size, self.extra = struct.unpack_from(order + "III", data, at + 52)
        self.day, self.month, self.long_size = data[at + 64], data[at + 65], data[at + 66]
        names = [text_of(data[at + 67 + 65 * k : at + 132 + 65 * k]) for k in range(4)]
        self.sysname, self.nodename, self.release, self.machine = names
        if not ACTIVITY_SIZE <= activity_size <= 1024 or not RECORD_SIZE <= record_size <= 1024 or activities > 4096:
            raise BadFile("structure sizes")
        self.record_size, at = record_size, MAGIC_SIZE + header_size
        self.activities, self.layouts = [], []
        for _ in range(activities):
            own = struct.unpack_from(order + "IIiiiiIII", data, at)
            name, _, nr, nr2, _, size, *types = own
            if not 0 <= nr <= MOST_ITEMS or not 1 <= nr2 <= MOST_SLOTS or not 1 <= size <= MOST_BYTES or 8 * types[0] + 8 * types[1] + 4 * types[2] > size:
                raise BadFile(f"counts of activity {name}")
            self.activities.append(own)
            self.layouts.append(Layout(own, self.long_size))
            at += activity_size
        self.start = at if not self.extra else self.after_extra(data, at)

    def after_extra(self, data: bytes, at: int) -> int:
        more = True
        while more:
            number, size, more = struct.unpack_from(self.order + "III", data, at)
            at += EXTRA_SIZE + number * size
            if at > len(data):
                raise struct.error("cut off")
        return at

    def _record(self, data: bytes, at: int, base: int) -> tuple:
        """(kind, ust, uptime, clock, content, end) of the record at ``at``."""
        offset = base + at
        uptime, ust, extra, kind, *clock = struct.unpack_from(self.order + "QQIBBBB", data, at)
        if not 1 <= kind <= 15 or clock[0] > 23 or clock[1] > 59 or clock[2] > 60 or ust >> 62:
            raise BadFile(f"record at byte {offset}")
        at += self.record_size
        content: list | int | str | None = None
        if kind in (STATS, LAST_STATS):
            content = []
            for own in self.activities:
                _, _, nr, nr2, has_nr, width, *_ = own
                if has_nr:
                    nr, = struct.unpack_from(self.order + "i", data, at)
                    at += 4
                    if not 0 <= nr <= MOST_ITEMS:
                        raise BadFile(f"number of items at byte {base + at - 4}")
                content.append((at, nr, nr2))
                at += nr * nr2 * width
                if at > len(data):
                    raise struct.error("cut off")
        elif kind == RESTART:
            content, = struct.unpack_from(self.order + "I", data, at)
            at += 4
        elif kind == COMMENT:
            if at + COMMENT_SIZE > len(data):
                raise struct.error("cut off")
            content = text_of(data[at : at + COMMENT_SIZE])
            at += COMMENT_SIZE
        if extra:
            at = self.after_extra(data, at)
        if at > len(data):
            raise struct.error("cut off")
        return kind, ust, uptime, clock, content, at

    def walk(self, start: int | None = None, end: int | None = None, segment: int = 0, number: int = 0) -> Iterator[tuple]:
        """(kind, segment, number, ust, uptime, (hour, minute, second), offset, content, window) of each whole record that begins

        from ``start`` and before ``end``; the content of a sample is a list of (place in the window, items, slots) of its
        activities, of a restart the processors, of a comment its text. A restart counts to the segment that it begins.
        """
        at, size, least = self.start if start is None else start, self.source.size, WINDOW
        end = size if end is None else min(end, size)
        base, data = self.source.window(at, least) if at < end else (0, b"")
        while at < end:
            try:
                if at + self.record_size > base + len(data):
                    raise struct.error("cut off")
                kind, ust, uptime, clock, content, after = self._record(data, at - base, base)
            except struct.error as error:
                if base + len(data) < size:  # the record goes on behind the window
                    least = WINDOW if at > base else 2 * len(data)
                    base, data = self.source.window(at, least)
                    continue
                if not self.lenient:
                    raise BadFile("the last record is cut off") from error
                return
            segment += kind == RESTART
            yield kind, segment, number, ust, uptime, clock, at, content, data
            number += kind in (STATS, LAST_STATS)
            at = base + after

    def runs(self, start: int | None = None, end: int | None = None, segment: int = 0, number: int = 0) -> Iterator[tuple]:
        """(segment, first number, ust, uptime, content of the first, stride, window) of samples of one form that follow each other.

        A sample says how long one of its form is. What stands at that distance again and again is looked at in arrays:
        heads of samples, with equal counts of items. Where it is anything else, the next record is read by itself.
        """
        at, size, least = self.start if start is None else start, self.source.size, WINDOW
        end = size if end is None else min(end, size)
        base, data = self.source.window(at, least) if at < end else (0, b"")
        head = np.dtype([("uptime", self.order + "u8"), ("ust", self.order + "u8"), ("extra", self.order + "u4"), ("kind", "u1"), ("clock", "u1", 3)])
        most = np.array([23, 59, 60], np.uint8)
        while at < end:
            place = at - base
            try:
                if place + self.record_size > len(data):
                    raise struct.error("cut off")
                kind, ust, uptime, _, content, after = self._record(data, place, base)
            except struct.error as error:
                if base + len(data) < size:  # the record goes on behind the window
                    least = WINDOW if at > base else 2 * len(data)
                    base, data = self.source.window(at, least)
                    continue
                if not self.lenient:
                    raise BadFile("the last record is cut off") from error
                return
            segment += kind == RESTART
            n, stride = 1, after - place
            if kind in (STATS, LAST_STATS):
                room = min((len(data) - place) // stride, -(-(end - at) // stride))
                rows = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8)[place:], (room, stride), (stride, 1), writeable=False)
                heads = np.ascontiguousarray(rows[:, : head.itemsize]).view(head)[:, 0]
                same = (heads["kind"] == kind) & (heads["extra"] == 0) & (heads["clock"] <= most).all(axis=1) & (heads["ust"] < 1 << 62)
                if content:
                    counted = [(x[0] - 4 - place, x[1]) for x, own in zip(content, self.activities) if own[4]]
                    for where, nr in counted:
                        same &= np.ascontiguousarray(rows[:, where : where + 4]).view(self.order + "i4")[:, 0] == nr
                # one with something extra behind it stands alone: its length says nothing of others
                n = max(int(same.argmin()) if not same.all() else room, 1)
                yield segment, number, heads["ust"][:n].astype(np.uint64), heads["uptime"][:n].astype(np.uint64), content, stride, data
                number += n
            at += n * stride

    def splits(self, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, end, segment, number): parts of at least ``size`` bytes that begin at records."""
        start, before = self.start, (0, 0)
        for kind, segment, number, *_, offset, _, _ in self.walk():
            if offset - start >= size:
                yield start, offset, *before
                start, before = offset, (segment - (kind == RESTART), number)
        yield start, self.source.size, *before

    def wanted_fields(self, layout: Layout) -> list[tuple[str, int, int]]:
        if self.wanted is not None and layout.activity not in self.wanted:
            return []
        after = [(name, -1 - k, 8) for k, name in enumerate(BYTES_AFTER.get(layout.activity, []))]
        return [f for f in layout.fields + after if self.fields is None or f[0] in self.fields]

    def items(self, data: bytes, at: int, records: int, stride: int, nr: int, nr2: int, layout: Layout) -> tuple[str, list[str], list[str], np.ndarray, list[int]] | None:
        """activity, item names, fields, values (records, items, fields) and bits of each field; None if names change.

        ``records`` records of one form follow each other, ``stride`` bytes apart.
        """
        size, (wide, longs, ints), end = layout.size, layout.types, layout.end
        raw = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8)[at:], (records, nr * nr2, size), (stride, size, 1), writeable=False)
        parts = [np.ascontiguousarray(raw[:, :, a:b]).view(self.order + kind).astype(np.uint64, copy=False) for a, b, kind in ((0, 8 * (wide + longs), "u8"), (8 * (wide + longs), end, "u4")) if a < b]
        named, text = layout.named, NAME_SIZES.get(layout.activity, 0)
        texts = raw[:, :, end : end + text] if end + text <= size else raw[:, :, end:end]
        if named == "irq" and not texts.shape[2]:
            # older ones have no names; the first is the sum
            items = ["sum" if i == 0 else str(i - 1) for i in range(nr * nr2)]
        elif named in ("text", "irq"):
            if records > 1 and (texts[1:] != texts[0]).any():
                return None
            texts = [text_of(texts[0, i].tobytes()) for i in range(nr * nr2)]
            # of a matrix the first row has the names; the others are of one processor each
            items = texts if nr2 == 1 else [texts[i % nr2] + (f"/cpu{i // nr2 - 1}" if i >= nr2 else "") for i in range(nr * nr2)]
        elif named == "cpu":
            items = ["all" if i == 0 else f"cpu{i - 1}" for i in range(nr * nr2)]
        elif named == "slot":
            items = [("all" if i < nr2 else f"cpu{i // nr2 - 1}") + f"/{i % nr2}" for i in range(nr * nr2)]
        elif named == "disk":
            places = {name: k for name, k, _ in layout.fields}
            if "major" not in places or "minor" not in places:
                items = [str(i) for i in range(nr * nr2)]
            else:
                numbers = np.concatenate(parts, axis=2)[:, :, [places["major"], places["minor"]]]
                if records > 1 and (numbers[1:] != numbers[0]).any():
                    return None
                items = [f"dev{a}-{b}" for a, b in numbers[0].tolist()]
        else:
            items = ["-"] if named == "one" and nr * nr2 == 1 else [str(i) for i in range(nr * nr2)]
        chosen = self.wanted_fields(layout)
        for name, k, _ in chosen:
            if k < 0:
                place = end + text - 1 - k
                more = raw[:, :, place] if place < size else np.zeros(raw.shape[:2], np.uint8)
                parts.append(more[:, :, None].astype(np.uint64))
        values = np.concatenate(parts, axis=2) if len(parts) > 1 else parts[0]
        columns = [k if k >= 0 else wide + longs + ints - 1 - k for _, k, _ in chosen]
        return layout.activity, items, [f[0] for f in chosen], values if columns == list(range(values.shape[2])) else values[:, :, columns], [f[2] for f in chosen]

    def samples(self, records: range | None = None, times: tuple[int, int] | None = None, part: tuple[int, int, int, int] | None = None) -> Iterator[tuple]:
        """(segments, numbers, ust, uptime, *items) of each activity of runs of samples.

        ``records``: numbers of the samples wanted; ``times``: their first and last ust; ``part``: see ``splits``.
        Samples of one form that stand one after the other, at even distances, are decoded together.
        """
        wanted = [k for k, layout in enumerate(self.layouts) if self.wanted_fields(layout)]
        for segment, number, ust, uptime, content, stride, data in self.runs(*part or ()):
            numbers = np.arange(number, number + len(ust))
            chosen = np.ones(len(ust), bool)
            if records is not None:
                chosen &= (numbers >= records.start) & (numbers < records.stop)
            if times is not None:
                chosen &= (ust >= times[0]) & (ust <= times[1])
            for first, last in stretches(chosen):
                own = slice(first, last)
                heads = (np.full(last - first, segment), numbers[own], ust[own], uptime[own])
                for k in wanted:
                    at, nr, nr2 = content[k]
                    if not nr:
                        continue
                    found = self.items(data, at + first * stride, last - first, stride, nr, nr2, self.layouts[k])
                    if found is not None:
                        yield (*heads, *found)
                    else:  # names change
                        for j in range(last - first):
                            yield (*(h[j : j + 1] for h in heads), *self.items(data, at + (first + j) * stride, 1, 0, nr, nr2, self.layouts[k]))

    def events(self) -> Iterator[tuple]:
        for kind, _, _, ust, _, _, _, content, _ in self.walk():
            if kind == RESTART:
                yield ust, "restart", content, None
            elif kind == COMMENT:
                yield ust, "comment", None, content


class Files(InputPartition):
    """Files that a task reads one after the other, or a part of one: (start, end, segment, number)."""

    def __init__(self, paths: list[str], part: tuple[int, int, int, int] | None = None):
        super().__init__(paths)
        self.paths, self.part = paths, part


def sizes_of(paths: list[str]) -> dict[str, int]:
    from pyarrow import fs

    if not paths:
        return {}
    uri = lambda p: p if "://" in p or p.startswith("file:") else f"file://{p}"
    files, _ = fs.FileSystem.from_uri(uri(paths[0]))
    inner = [fs.FileSystem.from_uri(uri(p))[1] for p in paths]
    return {p: max(x.size or 0, 0) for p, x in zip(paths, files.get_file_info(inner))}


def bundles(sizes: dict[str, int], most: int) -> Iterator[list[str]]:
    """Files in order, together as far as their sizes, each with the cost of opening it, stay within ``most``."""
    held, total = [], 0
    for path, size in sizes.items():
        if held and total + size + OPEN_COST > most:
            yield held
            held, total = [], 0
        held.append(path)
        total += size + OPEN_COST
    if held:
        yield held


def sample_batches(path: str, samples: Iterator[tuple], host: str) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SAMPLES.split(", ")]
    held: list[list[pa.Array]] = []
    size = 0

    def arrays(segment, number, ust, uptime, activity, items, fields, values, bits) -> list[pa.Array]:
        n, total = len(items) * len(fields), values.size
        each = lambda x: np.repeat(x, n)
        same = lambda x: pa.DictionaryArray.from_arrays(pa.array(np.zeros(total, np.int32)), pa.array([x], pa.string())).cast(pa.string())
        named = lambda x, index: pa.array(x, pa.string()).take(pa.array(np.tile(index, len(segment))))
        raw = pa.array(values.ravel()).cast(pa.decimal128(20, 0))
        item = np.repeat(np.arange(len(items)), len(fields))
        field = np.tile(np.arange(len(fields)), len(items))
        times = [pa.array(each(x).astype(np.int64)) for x in (segment, number, ust)] + [pa.array(each(uptime)).cast(pa.decimal128(20, 0))]
        return [same(path), same(host), *times, same(activity), named(items, item), named(fields, field), raw, pa.array(np.tile(np.array(bits, np.int32)[field], len(segment))), pa.array(np.tile(item.astype(np.int32), len(segment))), pa.array(np.full(total, len(items), np.int32))]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*held)], names)

    for one in samples:
        held.append(arrays(*one))
        size += one[7].size
        if size >= BATCH_VALUES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


class SaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = sorted(p for p in options["paths"].split("\n") if p)
        self.rows = options.get("rows", "samples")
        self.skip = self.rows == "skipped" or options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.lenient = options.get("lenient", "true") == "true"
        names = lambda key: {x.strip() for x in options[key].split(",")} if options.get(key) else None
        self.activities, self.fields = names("activities"), names("fields")
        first, last = options.get("first_record"), options.get("last_record")
        self.records = range(int(first or 0), int(last) + 1 if last else 1 << 62) if first or last else None
        self.split = int(options.get("split_bytes", SPLIT))
        self.parts = json.loads(options.get("parts", "[]"))
        self.times = [0, 1 << 62]

    def partitions(self) -> list[InputPartition]:
        parts = [Files([p], tuple(part)) for p, *part in self.parts]
        whole = sizes_of([p for p in self.paths if p not in {x[0] for x in self.parts}])
        return parts + [Files(b) for b in bundles(whole, self.split)]

    def read(self, partition: Files) -> Iterator[tuple | pa.RecordBatch]:
        for path in partition.paths:
            try:
                yield from self.rows_of(path, Decoder(Stored(path), self.lenient, self.activities, self.fields), partition.part)
            except (BadFile, ValueError, IndexError, OverflowError, struct.error) as error:
                if not self.skip:
                    raise
                if self.rows == "skipped":
                    yield path, str(error)

    def rows_of(self, path: str, file: Decoder, part: tuple[int, int, int, int] | None) -> Iterator[tuple | pa.RecordBatch]:
        if self.rows == "samples":
            yield from sample_batches(path, file.samples(self.records, tuple(self.times), part), file.nodename)
        elif self.rows == "events":
            yield from ((path, file.nodename, *x) for x in file.events())
        elif self.rows == "headers":
            names = " ".join(x.activity for x in file.layouts)
            yield path, file.nodename, file.sysname, file.release, file.machine, file.format, file.ust, file.hz, file.cpus, file.year + 1900, file.month + 1, file.day, file.long_size, names
        elif self.rows == "structure":
            for own, x in zip(file.activities, file.layouts):
                number, magic, nr, nr2, has_nr, size, *types = own
                yield path, file.nodename, number, x.activity, magic, nr, nr2, bool(has_nr), size, *types, " ".join(f[0] for f in x.fields), x.reason
        elif self.rows == "splits":
            yield from ((path, *x) for x in file.splits(self.split))
        else:
            for kind, segment, number, ust, uptime, clock, offset, _, _ in file.walk():
                if self.rows == "records":
                    yield path, file.nodename, number, segment, kind, ust, Decimal(uptime), *clock, offset


class PushingReader(SaReader):
    """Spark refuses a reader that takes filters where it is not to push them down."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over what is asked of activity, field and ust."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if self.rows != "samples":
                yield f
            elif column in (("activity",), ("field",)) and isinstance(f, (EqualTo, In)):
                name = {"activity": "activities", "field": "fields"}[column[0]]
                asked = {value} if isinstance(f, EqualTo) else set(value)
                own = getattr(self, name)
                setattr(self, name, asked if own is None else own & asked)
            elif column == ("ust",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.times[0] = max(self.times[0], value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.times[1] = min(self.times[1], value - isinstance(f, LessThan))
            elif isinstance(f, IsNotNull) and column in (("activity",), ("field",), ("ust",)):
                pass  # they never are
            else:
                yield f


class SaDataSource(DataSource):
    """Options: ``rows`` (samples, events, headers, structure: the activities of a file and what is read of them, records,

    splits, or skipped: files that can't be read, and why), ``mode`` (FAILFAST or PERMISSIVE: leave out the rest of bad
    files), ``lenient`` (a cut-off tail is no error), ``activities`` and ``fields`` (names, comma-separated: others
    aren't decoded), ``first_record`` and ``last_record`` (numbers of samples), ``split_bytes`` (of a partition).

    With ``pushdown`` conditions on activity, field and ust are pushed down; Spark demands that
    ``spark.sql.python.filterPushdown.enabled`` is on then, and ``read_sa`` sets it where that is so.
    Small files share a partition; ``read_sa`` makes several of a large one. A task holds a window of a file.
    """

    @classmethod
    def name(cls) -> str:
        return "sa"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "samples")]

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else SaReader)(dict(self.options))


def read_sa(spark: SparkSession, paths: list[str], rows: str = "samples", mode: str = "FAILFAST", lenient: bool = True, **options) -> DataFrame:
    """``options``: see ``SaDataSource``; lists of names are joined.

    A file of more than ``split_bytes`` is first walked by a task, from record to record, for places to split it at.
    """
    spark.dataSource.register(SaDataSource)

    def load(paths: list[str], rows: str, **options) -> DataFrame:
        reader = spark.read.format("sa").option("paths", "\n".join(paths)).option("rows", rows).option("mode", mode).option("lenient", str(lenient).lower())
        for key, value in options.items():
            reader = reader.option(key, value if isinstance(value, str) else ",".join(value) if isinstance(value, (list, tuple, set)) else str(value))
        return reader.load()

    if spark.conf.get(PUSHDOWN, "false") == "true":
        options.setdefault("pushdown", "true")
    size = int(options.get("split_bytes", SPLIT))
    large = [p for p, n in sizes_of(list(paths)).items() if n > size] if rows == "samples" else []
    if large:
        # a row for each partition, as of any listing of files
        parts = load(large, "splits", split_bytes=size).collect()
        options["parts"] = json.dumps([list(x) for x in parts])
    return load(list(paths), rows, **options)


def identify(spark: SparkSession, path: str) -> DataFrame:
    """path, order, magic and versions of any files, from their first bytes; unknown ones have nulls."""
    head = F.hex(F.substring("content", 1, 4))
    little, big = F.lit("96D5"), F.lit("D596")
    order = F.when(F.substring(head, 1, 4) == little, "little").when(F.substring(head, 1, 4) == big, "big")
    swapped = F.concat(F.substring(head, 7, 2), F.substring(head, 5, 2))
    magic = F.conv(F.when(order == "little", swapped).when(order == "big", F.substring(head, 5, 4)), 16, 10).cast("int")
    versions = F.coalesce(*(F.when(F.col("magic") == m, v) for m, v in FIXED_FORMATS.items()))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", order.alias("order"), magic.alias("magic")).withColumn("versions", versions)


def in_order(files: DataFrame) -> DataFrame:
    """Files (year, month, day, header_ust, path) in the order in which their samples follow each other."""
    return files.orderBy("year", "month", "day", "header_ust", "path")


def daily_files(spark: SparkSession, folder: str, day: str) -> DataFrame:
    """path, modified and length of the files of a day (yyyy-mm-dd) in a folder: saYYYYMMDD, and saDD as far as it was changed since.

    A name with the day of the month alone is used again each month: it counts if it was last changed on
    that day or the one after.
    """
    long, short = f"sa{day.replace('-', '')}", f"sa{day[8:]}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "sa*").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    name = F.element_at(F.split("path", "/"), -1)
    own = F.date_diff(F.to_date("modified"), F.to_date(F.lit(day))).between(0, 1)
    return files.where((name == long) | ((name == short) & own))
