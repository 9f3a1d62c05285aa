"""Operator 6: lines that repeat earlier lines, by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity: by their count in the whole corpus (kept
in a table of fixed size, words of one cell counting together), then by hash; any such order that is
the same everywhere gives exact results, rarity makes them cheap.

* Prefix: let p be the least Jaccard similarity. A line of s words shares ceil(p s) with each similar
  one, so the rarest word that both share is among the first s - ceil(p s) + 1 of each. Each line sends
  a record for those words; words that the whole corpus has once are left out.
* Length: similar lines have sizes a <= b with a >= p b.
* Position: two lines must share ceil(p (a + b) / (1 + p)) words. Where the rarest shared word stands at
  place i of one and j of the other, they share at most 1 + min(a - i - 1, b - j - 1). The smaller line's
  place must leave enough for a partner of its own size, which halves the records that look for others.
* Pattern: each word flips one of 64 bits, so the patterns of two lines differ in no more bits than the
  lines in words. This comes last and rules out most of what the other filters leave.

Lines that stay candidates of each other through one word form a group. Equal sets are one class.
Classes are compared with the earliest line of one of their groups and with leaders found beside it; a
class found similar to an earlier one is decided. The rest are compared with every earlier class of
their groups, large groups by pairs of blocks: first by wider patterns, then, where these leave a pair
possible, by words through an inverted index in memory. So a family of similar lines makes rows in
proportion to its size, and the classes that need words are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.partenum_join import BLOCK, compare_families, dealt_in_parts, folded, is_similar, shared_counts
from pulsegrid.llm.row_keys import with_rows
from pulsegrid.llm.scratch import stored, trimmed
from pulsegrid.llm.substring_dedup import as_batch, split
from pulsegrid.llm.word_hashes import WEIGHTS, hash_words, mix, pieces

#: Cells of the count table: 2^CELL_BITS bytes are broadcast, whatever the input.
CELL_BITS = 22
RANGE_BITS = 16
BUCKET_BYTES = 24 << 20
TASK_BYTES = 8 << 20
FAMILY = 4000
#: Members of a word's group beyond which a bucket leaves its pairs to blocks of their own.
LARGE_GROUP = 4000
#: Level of a word that the corpus has once.
ONCE = 2
#: Pairs of classes, and cells of wide patterns, that are looked at in one step.
PAIRS, PARITY_CELLS = 1 << 16, 1 << 20


def count_words(texts: DataFrame) -> np.ndarray:
    """A byte for each cell: twice the base-2 logarithm of its words' count. Each task sends its non-zero cells by ranges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for k, n in pieces(batch.column(0)):
                np.add.at(total, (hash_words(batch.column(0).slice(k, n)).hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        for r in range(1 << (CELL_BITS - RANGE_BITS)):
            part = total[r << RANGE_BITS : (r + 1) << RANGE_BITS]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], ["range", "cells", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << RANGE_BITS, np.int64)
        for cells, counts in zip(table.column("cells").to_pylist(), table.column("counts").to_pylist()):
            total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.int64)
        at = np.flatnonzero(total)
        return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "cells": pa.array([at.astype(np.uint16).tobytes()], pa.binary()), "counts": pa.array([total[at].tobytes()], pa.binary())})

    kind = "range int, cells binary, counts binary"
    sent = texts.mapInArrow(count, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    # in two steps, so that no task gets all tasks' cells of a range
    once = sent.groupBy("range", "part").applyInArrow(add, kind)
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    for row in once.groupBy("range").applyInArrow(lambda t: add(t), kind).toLocalIterator():
        counts = np.frombuffer(bytes(row["counts"]), np.int64)
        at = np.frombuffer(bytes(row["cells"]), np.uint16).astype(np.int64) + (row["range"] << RANGE_BITS)
        levels[at] = np.minimum(2 * np.log2(counts + 1), 255).astype(np.uint8)
    return levels


def line_tokens(texts: pa.Array, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words of each line in rarity order, of all texts: number of the line, word; and each text's first line.

    Lines are numbered through; a text has one more than it has line breaks.
    """
    words = hash_words(texts)
    breaks = np.flatnonzero(words.data == 10)
    per_text = np.searchsorted(breaks, words.offsets)
    first = per_text + np.arange(len(words.offsets))
    line = np.searchsorted(breaks, words.starts) + words.text_of()
    level = levels[(words.hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64)
    rank = level << np.uint64(56) | words.hashes >> np.uint64(8)
    order = None
    if not len(line) or line[-1] < 1 << 17:
        # line, level and 39 bits of the hash in one key; two words of a line that differ in other bits alone are sorted again
        key = line.astype(np.uint64) << np.uint64(47) | level << np.uint64(39) | words.hashes >> np.uint64(25)
        order = np.argsort(key)
        key = key[order]
        tied = np.flatnonzero(key[1:] == key[:-1])
        if (rank[order[tied]] != rank[order[tied + 1]]).any():
            order = None
    if order is None:
        order = np.lexsort((rank, line))
    line, rank = line[order], rank[order]
    if len(line):
        fresh = np.append(True, (line[1:] != line[:-1]) | (rank[1:] != rank[:-1]))
        line, rank = line[fresh], rank[fresh]
    return line, rank, first


def lines_with_sizes(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    return line[heads], heads, np.diff(np.append(heads, len(line)))


def prefix_lengths(sizes: np.ndarray, percent: int) -> np.ndarray:
    """First places of a line among which the rarest word shared with a similar line must be."""
    return sizes - (percent * sizes + 99) // 100 + 1


def shared_at_least(sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Words that similar lines of these sizes share."""
    return -(-percent * (sizes + others) // (100 + percent))


def classes_of(rank: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not len(heads):
        return np.zeros(0, np.int64)
    # the same value as set_class of the line's words
    return mix(np.add.reduceat(mix(rank), heads) + sizes.astype(np.uint64) * WEIGHTS[2]).view(np.int64)


def parity_patterns(rank: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduceat(np.uint64(1) << (mix(rank ^ WEIGHTS[6]) >> np.uint64(58)), heads) if len(heads) else np.zeros(0, np.uint64)


def possible_pairs(group: np.ndarray, sizes: np.ndarray, places: np.ndarray, patterns: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that length, position and pattern leave possible; rows are sorted by group and size.

    All rows look at once at the row one on, two on and so forth, as long as it is of their group and not too large.
    """
    ends = np.searchsorted(group, group, "right") if len(group) else np.zeros(0, np.int64)
    at = np.flatnonzero(sizes - places >= shared_at_least(sizes, sizes, percent))
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = 1
    while len(at):
        at = at[at + step < ends[at]]
        other = at + step
        near = 100 * sizes[at] >= percent * sizes[other]
        at, other = at[near], other[near]
        most = np.minimum(sizes[at] - places[at], sizes[other] - places[other])
        near = most >= shared_at_least(sizes[at], sizes[other], percent)
        a, b = at[near], other[near]
        near = np.bitwise_count(patterns[a] ^ patterns[b]).astype(np.int64) * (100 + percent) <= (sizes[a] + sizes[b]) * (100 - percent)
        first.append(a[near])
        second.append(b[near])
        step += 1
    return np.concatenate(first), np.concatenate(second)


def candidate_groups(group: np.ndarray, classes: np.ndarray, sizes: np.ndarray, places: np.ndarray, patterns: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and classes of the groups of candidates: rows of one group joined by possible pairs, one of each set of classes."""
    order = np.lexsort((places, sizes, group))
    group, classes, sizes, places, patterns = (x[order] for x in (group, classes, sizes, places, patterns))
    a, b = possible_pairs(group, sizes, places, patterns, percent)
    label = np.arange(len(group))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    member = np.zeros(len(group), bool)
    member[a] = member[b] = True
    rows = np.flatnonzero(member)
    rows = rows[np.lexsort((classes[rows], label[rows]))]
    classes, label = classes[rows], label[rows]
    heads = np.flatnonzero(np.append(True, label[1:] != label[:-1])) if len(label) else np.zeros(0, np.int64)
    member, names, _ = different_groups(classes, heads)
    return names, classes[member]


def different_groups(classes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups that start at ``heads``, one of each set of members, of two or more: places of the members, names, counts."""
    none = np.zeros(0, np.int64)
    if not len(classes):
        return none, none, none
    counts = np.diff(np.append(heads, len(classes)))
    name = mix(np.add.reduceat(mix(classes.view(np.uint64)), heads) + counts.astype(np.uint64))
    _, first = np.unique(name, return_index=True)
    first = first[counts[first] > 1]
    n = counts[first]
    return np.repeat(heads[first] - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(name[first], n).view(np.int64), n


KINDS = {"low": np.uint32, "high": np.uint8, "classes": np.int64, "patterns": np.uint64, "sizes": np.uint32, "places": np.uint32, "docs": np.int64, "doc_rows": np.int64, "doc_lines": np.int32, "doc_classes": np.int64}
SENT = "bucket long, " + ", ".join(f"{name} binary" for name in KINDS)


def send_words(levels, percent: int, least_words: int, buckets: int):
    """Rows for SENT from (doc, row, text): the words of each line's prefix by bucket, and the lines."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = set(), 0
        held: dict[str, list[np.ndarray]] = {n: [] for n in ("words", "classes", "patterns", "sizes", "places", "docs", "doc_rows", "doc_lines", "doc_classes")}

        def out() -> pa.RecordBatch:
            joined = {n: np.concatenate(x) if x else np.zeros(0, np.uint64 if n in ("words", "patterns") else np.int64) for n, x in held.items()}
            rows = []
            for bucket, own in split((joined["words"] % np.uint64(buckets)).astype(np.int64), np.arange(len(joined["words"]))):
                code = joined["words"][own] >> np.uint64(24)  # 40 bits, beside the bucket
                row = {"low": code & np.uint64(0xFFFFFFFF), "high": code >> np.uint64(32)} | {n: joined[n][own] for n in ("classes", "patterns", "sizes", "places")}
                rows.append({"bucket": bucket} | {n: x.astype(KINDS[n]).tobytes() for n, x in row.items()})
            for bucket, own in split((mix(joined["docs"].astype(np.uint64) ^ mix(joined["doc_rows"].astype(np.uint64))) % np.uint64(buckets)).astype(np.int64), np.arange(len(joined["docs"]))):
                rows.append({"bucket": bucket} | {n: joined[n][own].astype(KINDS[n]).tobytes() for n in ("docs", "doc_rows", "doc_lines", "doc_classes")})
            return as_batch(rows, SENT)

        for batch in batches:
            for k, n in pieces(batch.column(2)):
                ids, own_rows = (np.array(batch.column(c).slice(k, n).to_pylist(), np.int64) for c in (0, 1))
                line, rank, first = line_tokens(batch.column(2).slice(k, n), levels.value)
                number, heads, sizes = lines_with_sizes(line)
                classes = classes_of(rank, heads, sizes)
                meant = sizes >= least_words
                text = np.searchsorted(first, number, "right") - 1
                held["docs"].append(ids[text[meant]])
                held["doc_rows"].append(own_rows[text[meant]])
                held["doc_lines"].append((number - first[text])[meant])
                held["doc_classes"].append(classes[meant])
                fresh = np.zeros(len(sizes), bool)
                for i, own in zip(np.flatnonzero(meant).tolist(), classes[meant].tolist()):
                    if own not in seen:
                        seen.add(own)
                        fresh[i] = True
                count = np.where(fresh, prefix_lengths(sizes, percent), 0)
                place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                owner = np.repeat(np.arange(len(sizes)), count)
                word = rank[heads[owner] + place]
                several = (word >> np.uint64(56)) > ONCE
                owner, place, word = owner[several], place[several], word[several]
                held["words"].append(mix(word))
                held["classes"].append(classes[owner])
                held["patterns"].append(parity_patterns(rank, heads)[owner])
                held["sizes"].append(sizes[owner])
                held["places"].append(place)
                size += int(first[-1]) + 6 * len(rank)
                if size >= TASK_BYTES:
                    yield out()
                    seen, size = set(), 0
                    for x in held.values():
                        x.clear()
        yield out()

    return send


MET = "doc long, row long, line long, class long, group long, size long, place long, pattern long"


def meet_words(percent: int, large: int):
    """Of one bucket: a row for each line, for each class its groups of candidates, and the rows of groups that are too large to compare here."""

    def meet(table: pa.Table) -> pa.Table:
        joined = {n: np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in KINDS.items()}
        words = joined["low"].astype(np.uint64) | joined["high"].astype(np.uint64) << np.uint64(32)
        order = np.argsort(words)
        same = words[order[1:]] == words[order[:-1]]
        shared = np.zeros(len(order), bool)
        shared[1:] |= same
        shared[:-1] |= same
        order = order[shared]
        order = order[np.lexsort((joined["classes"][order], words[order]))]
        words, classes = words[order], joined["classes"][order]
        once = np.append(True, (words[1:] != words[:-1]) | (classes[1:] != classes[:-1]))[: len(words)]
        order, words, classes = order[once], words[once], classes[once]
        sizes, places, patterns = joined["sizes"][order].astype(np.int64), joined["places"][order].astype(np.int64), joined["patterns"][order]
        heads = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, len(words)))
        group = np.repeat(np.arange(len(counts)), counts)
        here = np.repeat(counts <= large, counts)
        names, found = candidate_groups(group[here], classes[here], sizes[here], places[here], patterns[here], percent)
        left = np.flatnonzero(~here)
        bucket = table.column("bucket")[0].as_py()
        columns = {
            "doc": [joined["docs"], None, None],
            "row": [joined["doc_rows"], None, None],
            "line": [joined["doc_lines"], None, None],
            "class": [joined["doc_classes"], found, classes[left]],
            "group": [None, names, mix(words[left] ^ mix(np.uint64([bucket % (1 << 62)]))).view(np.int64)],
            "size": [None, None, sizes[left]],
            "place": [None, None, places[left]],
            "pattern": [None, None, patterns[left].view(np.int64)],
        }
        lengths = [len(joined["docs"]), len(found), len(left)]
        return pa.table({n: pa.concat_arrays([pa.nulls(k, pa.int64()) if x is None else pa.array(x.astype(np.int64)) for x, k in zip(own, lengths)]) for n, own in columns.items()})

    return meet


def parts_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (group, part), from rows sorted by both."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        group, part = batch.column("group").to_numpy(), batch.column("part").to_numpy()
        starts = np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1])) + 1
        bounds = [0, *starts.tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:]):
            own = batch.slice(a, b - a)
            if held and (held[0].column("group")[0] != own.column("group")[0] or held[0].column("part")[0] != own.column("part")[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(own)
    if held:
        yield pa.Table.from_batches(held)


def groups_of_parts(percent: int):
    """Groups of candidates (group, class) of large groups' parts, from rows sorted by group and part."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts_in_order(batches):
            classes, sizes, places, patterns = (rows.column(c).to_numpy() for c in ("class", "size", "place", "pattern"))
            names, own = candidate_groups(np.zeros(len(rows), np.int64), classes, sizes, places, patterns.view(np.uint64), percent)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(own)], ["group", "class"])

    return found


def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one or more whole parts (group, part) at once, from rows sorted by both."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        group, part = batch.column("group").to_numpy(), batch.column("part").to_numpy()
        starts = np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1])) + 1
        if held and (held[-1].column("group")[-1].as_py() != group[0] or held[-1].column("part")[-1].as_py() != part[0]):
            starts = np.append(0, starts)
        if len(starts):
            last = int(starts[-1])
            before = [*held, batch.slice(0, last)] if last else held
            yield pa.Table.from_batches(before)
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def possible_with_earlier(percent: int):
    """Of rows sorted by group, part and place: classes not done that wide patterns let be similar to an earlier one, and those earlier ones.

    Pairs of many parts are looked at together, ``PAIRS`` at a time.
    """

    def found(rows: pa.Table) -> pa.Table:
        group, part, done, sizes = (rows.column(c).to_numpy() for c in ("group", "part", "done", "size"))
        bits = rows.column("bits").to_pylist()
        width, needed = np.array([len(x) >> 3 for x in bits]), np.zeros(len(rows), bool)
        # for each width the rows of that width or a wider one, folded to it
        patterns, places = {}, {}
        for w in np.unique(width).tolist():
            patterns[w] = np.empty(((width >= w).sum(), w), np.uint64)
            places[w] = np.cumsum(width >= w) - 1
            for wider in np.unique(width[width >= w]).tolist():
                own = np.flatnonzero(width == wider)
                patterns[w][places[w][own]] = folded(np.frombuffer(b"".join([bits[i] for i in own.tolist()]), np.uint64).reshape(len(own), wider), w)
        begins = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])))
        begin = np.repeat(begins, np.diff(np.append(begins, len(rows))))
        late = np.flatnonzero(~done)
        run = np.cumsum(late - begin[late])
        cuts = np.flatnonzero(run[1:] // PAIRS != run[:-1] // PAIRS) + 1
        for own in np.split(late, cuts):
            count = own - begin[own]
            a = np.repeat(own, count)
            b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count - begin[own], count)
            both = sizes[a] + sizes[b]
            near = np.abs(sizes[a] - sizes[b]) * (100 + percent) <= both * (100 - percent)
            a, b, both = a[near], b[near], both[near]
            least = np.minimum(width[a], width[b])
            for w, of in patterns.items():
                at = np.flatnonzero(least == w)
                differ = np.bitwise_count(of[places[w][a[at]]] ^ of[places[w][b[at]]]).sum(axis=1, dtype=np.int64)
                at = at[differ * (100 + percent) <= both[at] * (100 - percent)]
                needed[a[at]] = needed[b[at]] = True
        return rows.filter(pa.array(needed)).select(["group", "part", "at", "class", "done"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_parts(batches):
            yield from found(rows).combine_chunks().to_batches()

    return possible


def compare_with_earlier(percent: int):
    """Classes that are not done and similar to an earlier one, from rows sorted by group, part and place."""

    def found(members: list[tuple[int, bool, np.ndarray]]) -> list[int]:
        if len(members) < 2 or all(done for _, done, _ in members):
            return []
        sizes = np.array([len(x) for _, _, x in members])
        counts = shared_counts([x for _, _, x in members])
        return [c for i, ((c, done, x), shared) in enumerate(zip(members, counts)) if not done and is_similar(shared[:i], len(x), sizes[:i], percent).any()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            out: list[int] = []
            for group, part, own, done, features in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "class", "done", "features"))):
                if key != (group, part):
                    out += found(members)
                    key, members = (group, part), []
                members.append((own, done, np.frombuffer(features, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["class"])
        yield pa.RecordBatch.from_arrays([pa.array(found(members), pa.int64())], ["class"])

    return compare


def repeated_lines(rows: DataFrame, percent: int, least_words: int = 1, large: int = LARGE_GROUP, block: int = BLOCK) -> DataFrame:
    """From rows (doc: long, row: long, text): doc, row and ``lines``, the numbers of its lines that repeat earlier ones.

    (doc, row) names a document: rows that share it have one text.
    """
    spark = rows.sparkSession
    levels = spark.sparkContext.broadcast(count_words(rows.select("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    met = rows.select("doc", "row", "text").mapInArrow(trimmed(send_words(levels, percent, max(1, least_words), buckets)), SENT).groupBy("bucket").applyInArrow(trimmed(meet_words(percent, large)), MET)
    met = stored(met, "met")
    lines = met.where("group is null").select("doc", "row", "line", "class")
    firsts = stored(lines.groupBy("class").agg(F.min(F.struct("doc", "row", "line")).alias("at"), F.count("*").alias("n")), "firsts")
    members = met.where("group is not null and size is null").select("group", "class")
    too_large = met.where("size is not null")
    if not too_large.isEmpty():
        parts = dealt_in_parts(too_large.select("group", "class", "size", "place", "pattern"), block).withColumn("part", F.col("part").cast("long"))
        parts = parts.select("group", "part", "class", "size", "place", "pattern").repartition("group", "part").sortWithinPartitions("group", "part")
        members = members.union(parts.mapInArrow(trimmed(groups_of_parts(percent)), "group long, class long"))
    members = stored(members.distinct().join(firsts.select("class", "at"), "class"), "members")

    # each class goes to the family of the earliest of the groups' earliest lines
    heads = members.groupBy("group").agg(F.min(F.struct("at", "class")).alias("head"), F.count("*").alias("n"))
    chosen = stored(members.join(heads, "group").groupBy("class", "at").agg(F.min("head").alias("head")), "chosen")
    families = chosen.where(F.col("head.class") != F.col("class")).groupBy(F.col("head.class").alias("hub")).agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("parts"))
    own_parts = families.select(F.col("hub").alias("class"), F.col("parts").alias("own_parts"))
    parts = chosen.withColumn("hub", F.col("head.class")).join(families, "hub", "left").join(own_parts, "class", "left")
    place = lambda family, part: F.struct(family.alias("family"), part.cast("int").alias("part"))
    as_member = F.when(F.col("hub") != F.col("class"), F.array(place(F.col("hub"), F.pmod(F.xxhash64("class"), F.col("parts")))))
    as_hub = F.when(F.col("own_parts").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("own_parts") - 1), lambda p: place(F.col("class"), p)))
    none = F.array().cast("array<struct<family:long,part:int>>")
    wanted = parts.select(F.col("at.doc").alias("doc"), F.col("at.row").alias("row"), F.struct(F.col("at.line").alias("line"), "class", F.concat(F.coalesce(as_member, none), F.coalesce(as_hub, none)).alias("places")).alias("w"))
    wanted = wanted.groupBy("doc", "row").agg(F.collect_list("w").alias("wanted"))  # of one document
    # repeated rows have one text, so one of them is enough
    sources = rows.select("doc", "row", "text").join(wanted.hint("merge"), ["doc", "row"])
    sets = sources.mapInArrow(trimmed(sets_of_lines(levels)), "class long, doc long, row long, line long, places array<struct<family:long,part:int>>, features binary, bits binary, size long")
    sets = stored(sets, "sets")
    dealt = sets.select("class", "doc", "row", "line", "features", F.explode("places").alias("p")).select("p.family", "p.part", "doc", "row", "line", "class", "features")
    dealt = dealt.repartition("family", "part").sortWithinPartitions("family", "part", "doc", "row", "line", "class")
    # repeated rows give a class several times; its link with itself says nothing
    decided = stored(dealt.mapInArrow(trimmed(compare_families(percent)), "a long, b long").where("a <> b").select(F.col("b").alias("class")).distinct(), "decided")

    # classes not decided yet against every earlier class of their groups; a group of such a class and its hub says nothing new
    undecided = chosen.select("class", F.col("head.class").alias("hub")).join(decided, "class", "left_anti")
    late = members.join(undecided, "class").join(heads, "group").where((F.col("at") > F.col("head.at")) & ((F.col("n") > 2) | (F.col("hub") != F.col("head.class"))))
    open_ = members.join(late.select("group").distinct(), "group", "left_semi").join(decided.withColumn("done", F.lit(True)), "class", "left")
    open_ = stored(open_.select("group", "class", "at", F.coalesce("done", F.lit(False)).alias("done")), "open")
    features = sets.select("class", "features").dropDuplicates(["class"])
    marks = sets.select("class", "bits", "size").dropDuplicates(["class"])
    parts = dealt_in_parts(open_, block).join(marks, "class").select("group", F.col("part").cast("long").alias("part"), "at", "class", "done", "bits", "size")
    parts = parts.repartition("group", "part").sortWithinPartitions("group", "part", "at")
    kind = "group long, part long, at struct<doc:long,row:long,line:long>, class long, done boolean"
    parts = stored(parts.mapInArrow(trimmed(possible_with_earlier(percent)), kind), "possible")
    parts = parts.join(features, "class").select("group", "part", "at", "class", "done", "features")
    more = parts.repartition("group", "part").sortWithinPartitions("group", "part", "at").mapInArrow(trimmed(compare_with_earlier(percent)), "class long")
    gone = stored(decided.union(more).distinct().withColumn("gone", F.lit(True)), "gone")

    verdicts = firsts.join(gone, "class", "left").where("n > 1 or gone").select("class", "at", F.coalesce("gone", F.lit(False)).alias("gone"))
    verdicts = stored(verdicts, "verdicts")
    repeated = lines.join(verdicts, "class").where(F.col("gone") | (F.struct("doc", "row", "line") > F.col("at")))
    return repeated.groupBy("doc", "row").agg(F.collect_list("line").alias("lines"))


def parity_bits_of(rank: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """``parity_bits`` of many lines at once."""
    out: list[bytes] = [b""] * len(heads)
    if not len(heads):
        return out
    hashes = mix(rank ^ WEIGHTS[6])
    power = np.maximum(np.frexp((4 * sizes - 1).astype(np.float64))[1], 8)
    for k in np.unique(power).tolist():
        lines, width = np.flatnonzero(power == k), 1 << k
        each = max(1, PARITY_CELLS >> k)
        for own in (lines[i : i + each] for i in range(0, len(lines), each)):
            n = sizes[own]
            owner = np.repeat(np.arange(len(own)), n)
            word = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n - heads[own], n)
            cell = owner * width + (hashes[word] & np.uint64(width - 1)).astype(np.int64)
            odd = (np.bincount(cell, minlength=len(own) * width) & 1).astype(bool)
            data, size = np.packbits(odd, bitorder="little").tobytes(), width >> 3
            for j, i in enumerate(own.tolist()):
                out[i] = data[j * size : (j + 1) * size]
    return out


def sets_of_lines(levels):
    """Words, wide pattern and size of the lines that are wanted of each text, from rows (doc, row, text, wanted)."""
    names = ["class", "doc", "row", "line", "places", "features", "bits", "size"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            places, of = wanted.flatten(), pc.list_parent_indices(wanted)
            numbers, classes, places = (places.field(c) for c in ("line", "class", "places"))
            asked, texts, lines, last = classes.to_numpy(), [], [], None
            whole = batch.column("text").to_pylist()
            for text, number in zip(of.to_pylist(), numbers.to_pylist()):
                if text != last:
                    lines, last = whole[text].split("\n"), text
                texts.append(lines[number])
            texts = pa.array(texts, pa.string())
            found, features, bits, counts = [np.zeros(0, np.int64)], [], [], [np.zeros(0, np.int64)]
            for k, n in pieces(texts):
                line, rank, _ = line_tokens(texts.slice(k, n), levels.value)
                number, heads, sizes = lines_with_sizes(line)
                meant = classes_of(rank, heads, sizes) == asked[k + number]
                number, heads, sizes = number[meant], heads[meant], sizes[meant]
                data = rank.tobytes()
                features += [data[8 * a : 8 * b] for a, b in zip(heads.tolist(), (heads + sizes).tolist())]
                bits += parity_bits_of(rank, heads, sizes)
                found.append(k + number)
                counts.append(sizes)
            at = pa.array(np.concatenate(found))
            of = of.take(at)
            columns = [classes.take(at), batch.column("doc").take(of), batch.column("row").take(of), numbers.take(at), places.take(at), pa.array(features, pa.binary()), pa.array(bits, pa.binary()), pa.array(np.concatenate(counts))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return sets


def remove_repeated_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1) -> DataFrame:
    """``docs`` without the lines that repeat an earlier line; columns and rows stay as they are.

    Lines are split at \\n and ordered by document id and place. A line of at least ``least_words``
    different words (all lines with words, unless given) goes if an earlier line of the input of which
    that is true has a Jaccard similarity of ``percent`` or more with it, as sets of words (runs of
    characters outside x20 and x09-x0D, unchanged). Other lines stay, so do the line breaks between
    those left. Null texts stay null, empty ones empty; a text may become empty. Very long texts are
    worked on whole. Rows with a null id come last in the order, each a document of its own. Rows that
    repeat an id with another text are documents of their own too, in an order that depends on their
    texts; rows that repeat id and text count as one document. An empty table gives no rows.
    """
    return with_removed(docs, percent, id_col, text_col, least_words).drop("__removed", "__doc")


def with_removed(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1, **options) -> DataFrame:
    """``docs`` with the text that is left, ``__doc`` (its place in the order of documents) and ``__removed`` (numbers of the lines that went, or null).

    Null and empty texts, and those without a word, stay as they are. Of equal rows each is judged as a document of
    its own; rows with a null id come last. Of lines that are equally alike the first stays. Very long texts
    are rows of one task. An empty table stays empty. Columns named __doc, __row and __removed are taken for this and replaced.
    """
    rows = with_rows(docs, id_col, text_col)
    found = repeated_lines(rows.select(F.col("__doc").alias("doc"), F.col("__row").alias("row"), F.col(text_col).cast("string").alias("text")), percent, least_words, **options)
    found = found.select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("lines").alias("__removed"))
    rows = rows.join(found.hint("merge"), ["__doc", "__row"], "left")
    return rows.withColumn(text_col, without_lines(F.col(text_col), F.col("__removed"))).select("__doc", *docs.columns, "__removed")


def without_lines(text: Column, removed: Column) -> Column:
    @F.arrow_udf("string")
    def cut(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = [pa.nulls(0, pa.string())]
        for k in range(0, len(texts), 256):  # few texts at once as Python strings
            own = []
            for t, gone in zip(texts.slice(k, 256).to_pylist(), numbers.slice(k, 256).to_pylist()):
                if t and gone:
                    gone = set(gone)
                    t = "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)
                own.append(t)
            out.append(pa.array(own, pa.string()))
        return pa.concat_arrays(out)

    # texts of which nothing goes are not sent to Python
    return F.when(removed.isNull(), text).otherwise(cut(F.when(removed.isNotNull(), text), removed))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed (lines) and kept_sha256 of the text left, from ``with_removed``."""
    return docs.select("doc_id", F.coalesce(F.size(F.array_distinct("__removed")), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
