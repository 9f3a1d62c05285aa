"""Operator 10: exact Jaccard join on word shingles by PartEnum signatures.

Sets are kept in size bands. Two sets of sizes a and b with a Jaccard similarity of at least g differ
in at most k = (a + b) (1 - g) / (1 + g) elements. Hashing deals the feature domain into n1 parts of
n2 smaller parts each; of n1 > k / (k2 + 1) parts at least one holds at most k2 differences, so at
least n2 - k2 of its smaller parts agree wholly. A signature is the hash of a set's features in one
choice of n2 - k2 smaller parts; so similar sets of a band share one. Sets near the edge of a band
take part in a second partition, shared by the two bands.

Choices without features would make unlike sets meet. n1 has some parts to spare, so a pair agrees in
``sure`` choices at least; a set with fewer empty choices than that leaves them out and still shares
a choice with features with each similar set.

Equal sets are one class from the start and a task sends the signatures of a class once, so groups of
copies don't multiply. Classes that share signatures are first compared with the class of smallest
hash that they meet and with the leaders found beside it. Groups of a signature that lie in one
component then need no more comparing. The classes of the other groups are compared by bit patterns a
sixteenth as large as the sets, large groups by pairs of blocks, within the task; only pairs that the
patterns can't rule out become rows, and their sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.components import connected_components
from pulsegrid.llm.row_keys import NO_ID, with_rows
from pulsegrid.llm.scratch import stored, trimmed
from pulsegrid.llm.substring_dedup import as_batch, pmod, split
from pulsegrid.llm.word_hashes import WEIGHTS, hash_words, mix, pieces, sequences

#: Signatures that a task gathers before it sends them, and bytes of text for each bucket of signatures.
TASK_SIGNATURES = 500_000
BUCKET_BYTES = 12 << 20
#: Members of a family that one task compares, and leaders that it holds.
FAMILY = 4000
LEADERS = 64
#: Classes of a signature's group in a block.
BLOCK = 1500


@dataclass(frozen=True)
class Scheme:
    """One partition of the feature domain: ``tag`` tells schemes apart."""

    tag: int
    n1: int
    n2: int
    k2: int
    sure: int


class PartEnum:
    """Schemes for each set size. ``percent``: least Jaccard similarity in percent."""

    def __init__(self, percent: int, n2: int = 2, k2: int = 1, width: int = 2):
        self.percent, self.n2, self.k2 = percent, n2, k2
        self.ratio = Fraction(100 - percent, 100 + percent)
        self.grow = Fraction(100, percent)
        self.lows = [1]
        self.width = width
        self._of: dict[int, list[Scheme]] = {}

    def _band(self, size: int) -> int:
        while self.lows[-1] <= size:
            self.lows.append(max(self.lows[-1], floor(self.lows[-1] * self.grow**self.width)) + 1)
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def _scheme(self, tag: int, differences: int) -> Scheme | None:
        """None if no two different sets are that close."""
        if not differences:
            return None
        least = differences // (self.k2 + 1)
        n1 = least + 2 + least // 20 + (1 if self.k2 else 2)
        return Scheme(tag, n1, self.n2, self.k2, n1 - least)

    def schemes(self, size: int) -> list[Scheme]:
        if size not in self._of:
            band = self._band(size)
            self._band(self.lows[band + 1])
            low, high, above = self.lows[band], self.lows[band + 1] - 1, self.lows[band + 1]
            found = [self._scheme(2 * band, floor(2 * high * self.ratio))]
            if size * 100 >= above * self.percent:
                found.append(self._scheme(2 * band + 1, floor((high + floor(high * self.grow)) * self.ratio)))
            if band and size * self.percent <= (low - 1) * 100:
                found.append(self._scheme(2 * band - 1, floor((low - 1 + floor((low - 1) * self.grow)) * self.ratio)))
            self._of[size] = [s for s in found if s]
        return self._of[size]

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """Of a set's features (sorted, unique 64-bit hashes)."""
        out = []
        sums = np.zeros(len(features) + 1, np.uint64)
        np.cumsum(mix(features ^ WEIGHTS[1]), out=sums[1:])
        for s in self.schemes(len(features)):
            parts = s.n1 * s.n2
            part = ((features >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
            total = (sums[cuts[1:]] - sums[cuts[:-1]]).reshape(s.n1, s.n2)
            count = np.diff(cuts).reshape(s.n1, s.n2)
            for c, chosen in enumerate(combinations(range(s.n2), s.n2 - s.k2)):
                value = sum(mix(total[:, j] + WEIGHTS[8 + p]) for p, j in enumerate(chosen))
                filled = count[:, list(chosen)].sum(axis=1) > 0
                where = np.arange(s.n1, dtype=np.uint64) + np.uint64((s.tag << 40) + (c << 32))
                out.append((mix(value ^ mix(where)), filled, s.sure))
        kept, at = [], 0
        for s in self.schemes(len(features)):
            own = out[at : at + len(list(combinations(range(s.n2), s.n2 - s.k2)))]
            at += len(own)
            empty = sum(int((~filled).sum()) for _, filled, _ in own)
            kept += [values if empty >= s.sure else values[filled] for values, filled, _ in own]
        return np.concatenate(kept) if kept else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, words: int, fold_case: bool = True) -> Iterator[np.ndarray]:
    """Of each text the sorted, unique hashes of its word shingles; with fewer words, of all of them as one."""
    for k, n in pieces(texts):
        found = hash_words(texts.slice(k, n), fold_case)
        grams = sequences(found.hashes, words)
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                yield mix(mix((found.hashes[a:b] * WEIGHTS[: b - a]).sum(keepdims=True)) ^ WEIGHTS[b - a])
            else:
                yield np.zeros(0, np.uint64)


def set_class(features: np.ndarray) -> int:
    """A set's hash, as a signed 64-bit integer."""
    value = mix(mix(features).sum(keepdims=True) + np.array([len(features)], np.uint64) * WEIGHTS[2])
    return int(value.view(np.int64)[0])


SENT = "bucket long, signatures binary, classes binary, docs binary, doc_rows binary, sizes binary, doc_classes binary"


def send_signatures(scheme: PartEnum, words: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signatures, classes, seen, held, docs = [], [], set(), 0, []

        def batch_of() -> pa.RecordBatch:
            rows = []
            if signatures:
                values = np.concatenate(signatures)
                owners = np.repeat(np.array(classes, np.int64), [len(x) for x in signatures])
                for bucket, own in split((mix(values) % np.uint64(buckets)).astype(np.int64), np.arange(len(values))):
                    rows.append({"bucket": bucket, "signatures": values[own].tobytes(), "classes": owners[own].tobytes()})
            if docs:
                table = np.array(docs, np.int64)
                for bucket, own in split(pmod(table[:, 0] ^ mix(table[:, 1].astype(np.uint64)).view(np.int64), buckets), np.arange(len(table))):
                    rows.append({"bucket": bucket, "docs": table[own, 0].tobytes(), "doc_rows": table[own, 1].tobytes(), "sizes": table[own, 2].tobytes(), "doc_classes": table[own, 3].tobytes()})
            return as_batch(rows, SENT)

        for batch in batches:
            for i, row, features in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), words)):
                own = set_class(features) if len(features) else 0
                docs.append((i, row, len(features), own))
                if len(features) and own not in seen:
                    seen.add(own)
                    signatures.append(scheme.signatures(features))
                    classes.append(own)
                    held += len(signatures[-1])
                if held >= TASK_SIGNATURES:
                    yield batch_of()
                    signatures, classes, seen, held, docs = [], [], set(), 0, []
        yield batch_of()

    return send


def meet(table: pa.Table) -> pa.Table:
    """Of one bucket: a row for each document, and for each class that shares a signature its groups and their least class."""
    joined = lambda name, dtype: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)
    values, classes = joined("signatures", np.uint64), joined("classes", np.int64)
    order = np.lexsort((classes, values))
    values, classes = values[order], classes[order]
    if len(values):
        once = np.append(True, (values[1:] != values[:-1]) | (classes[1:] != classes[:-1]))
        values, classes = values[once], classes[once]
        heads = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        counts = np.diff(np.append(heads, len(values)))
        group = np.add.reduceat(mix(classes.view(np.uint64)), heads)
        group = mix(group + counts.astype(np.uint64))
        _, first = np.unique(group, return_index=True)
        first = first[counts[first] > 1]
        n = counts[first]
        member = np.repeat(heads[first] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        group, hub, classes = np.repeat(group[first], n).view(np.int64), np.repeat(classes[heads[first]], n), classes[member]
    else:
        group = hub = np.zeros(0, np.int64)
    docs, rows, sizes, own = joined("docs", np.int64), joined("doc_rows", np.int64), joined("sizes", np.int64), joined("doc_classes", np.int64)
    pad = lambda values, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(values, pa.int64()), pa.nulls(after, pa.int64())])
    a, b = len(docs), len(classes)
    return pa.table({"doc": pad(docs, 0, b), "row": pad(rows, 0, b), "size": pad(sizes, 0, b), "class": pa.array(np.concatenate([own, classes]), pa.int64()), "group": pad(group, a, 0), "hub": pad(hub, a, 0)})


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def compare_families(percent: int):
    """Links (a, b) from rows with family, part, class and features, sorted by family and part, a family's hub first.

    Each row is compared with the hub and the leaders before it; one that is similar to none becomes a leader.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, leaders = None, []
        for batch in batches:
            a, b = [], []
            for name, part, own, features in zip(*(batch.column(c).to_pylist() for c in ("family", "part", "class", "features"))):
                features = np.frombuffer(features, np.uint64)
                if family != (name, part):
                    family, leaders = (name, part), []
                for leader, theirs in leaders:
                    if similar(theirs, features, percent):
                        a.append(leader)
                        b.append(own)
                        break
                else:
                    if len(leaders) < LEADERS:
                        leaders.append((own, features))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return compare


def shared_counts(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each set the number of elements that it shares with each set of the list, from an inverted index."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(element, kind="stable")
    holders = owner[order]
    begins = np.searchsorted(element[order], np.arange(element.max() + 2))
    at = 0
    for x in sets:
        own = element[at : at + len(x)]
        at += len(x)
        count = begins[own + 1] - begins[own]
        found = holders[np.repeat(begins[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        yield np.bincount(found, minlength=len(sets))


def is_similar(shared: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (size + sizes - shared)


def parity_bits(features: np.ndarray) -> bytes:
    """Four to eight bits for each element (a power of two, 256 at least): whether an odd number of elements fall on it.

    Of two sets at least as many elements differ as bits do, so bits that differ too much rule a pair
    out. A wider pattern folds to a narrower one.
    """
    width = 1 << max(8, (4 * len(features) - 1).bit_length())
    odd = np.bincount((mix(features ^ WEIGHTS[6]) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(patterns: np.ndarray, words: int) -> np.ndarray:
    while patterns.shape[-1] > words:
        half = patterns.shape[-1] // 2
        patterns = patterns[..., :half] ^ patterns[..., half:]
    return patterns


def possible_pairs(members: list[tuple[int, int, int, bytes]], percent: int, spanning: bool = False) -> list[tuple[int, int]]:
    """Pairs from different components that neither sizes nor bits rule out; members are (class, component, size, bits).

    ``spanning``: only as many as would join the components that they join together.
    """
    parent = {m[1]: m[1] for m in members}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    classes, components, sizes = (np.array([m[k] for m in members]) for k in range(3))
    words = np.array([len(m[3]) // 8 for m in members])
    stacks = {w: (np.flatnonzero(words == w), np.stack([np.frombuffer(m[3], np.uint64) for m in members if len(m[3]) // 8 == w])) for w in np.unique(words).tolist()}
    found = []
    for w, (rows, patterns) in stacks.items():
        for v, (others, theirs) in stacks.items():
            if v > w:
                continue
            own = folded(patterns, v)
            for i, pattern in zip(rows.tolist(), own):
                near = (components[others] != components[i]) & (100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))
                if v == w:
                    near &= others > i
                if near.any():
                    chosen = others[near]
                    apart = np.bitwise_count(theirs[near] ^ pattern).sum(axis=1, dtype=np.int64)
                    few = apart * (100 + percent) <= (sizes[chosen] + sizes[i]) * (100 - percent)
                    for j in chosen[few].tolist():
                        if spanning:
                            a, b = root(int(components[i])), root(int(components[j]))
                            if a == b:
                                continue
                            parent[a] = b
                        found.append((int(classes[i]), int(classes[j])))
    return found


def compare_groups(percent: int, spanning: bool):
    """Pairs (group, a, b) that may be similar, from rows (group, part, class, component, size, bits) sorted by group and part; a part is held in memory.

    With ``spanning`` only as many as join what a part's pairs may join: some pair of each part that has any.
    """

    def own(key: tuple | None, members: list) -> list[tuple[int, int, int]]:
        return [(key[0], *pair) for pair in possible_pairs(members, percent, spanning)] if len(members) > 1 else []

    def sent(links: list[tuple[int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in range(3)], ["group", "a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        for batch in batches:
            links: list[tuple[int, int, int]] = []
            for group, part, *member in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "class", "component", "size", "bits"))):
                if key != (group, part):
                    links += own(key, members)
                    key, members = (group, part), []
                members.append(tuple(member))
            yield sent(links)
        yield sent(own(key, members))

    return compare


def compare_pairs(percent: int):
    """The pairs (a, b, of_a, of_b) that are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "of_a", "of_b")))
            yield links_of([(a, b) for a, b, x, y in rows if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)])

    return compare


def links_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], ["a", "b"])


def dealt_in_parts(members: DataFrame, block: int) -> DataFrame:
    """Rows of ``members`` (group, class, ...) with ``part``: groups of more than ``block`` classes are cut into

    blocks, and each pair of blocks makes a part, so that every two members of a group meet in one.
    """
    counts = members.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = members.join(counts, "group").withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    number = lambda j: F.least(F.col("own"), j) * F.col("blocks") + F.greatest(F.col("own"), j)
    return rows.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), number))).drop("blocks", "own")


def near_duplicate_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included).

    Documents link when the Jaccard similarity of their sets of ``words``-word shingles (A-Z
    lower-cased) is at least ``percent``; none is lost and none is below. Null and empty texts have an
    empty set and link with nothing. Repeated rows each get a row; rows with a null id take part and,
    unlinked, keep a null component. Other columns are left out. An empty table gives no rows. A very long text is one row
    of one task, and its whole set is compared. A pair at ``percent`` itself links.
    """
    spark = docs.sparkSession
    scheme = PartEnum(percent)
    rows = with_rows(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")), "doc", "text")
    rows = rows.select(F.col("__doc").alias("doc"), F.col("__row").alias("row"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    met = rows.mapInArrow(trimmed(send_signatures(scheme, words, buckets)), SENT).groupBy("bucket").applyInArrow(trimmed(meet), "doc long, row long, size long, class long, group long, hub long")
    met = stored(met, "met", compression="zstd")
    of_docs = met.where("group is null").select("doc", "row", "size", "class")
    members = met.where("group is not null").select("group", "class", "hub")

    # each class goes to the family of the least class that it meets; hubs of large families go to each part
    hubs = members.groupBy("class").agg(F.min("hub").alias("hub"))
    classes = of_docs.where("size > 0").groupBy("class").agg(F.min(F.struct("doc", "row")).alias("first"), F.first("size").alias("size"))
    chosen = stored(hubs.join(classes, "class"), "chosen")
    families = chosen.where("hub <> class").groupBy("hub").agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("parts"))
    own_parts = families.select(F.col("hub").alias("class"), F.col("parts").alias("own_parts"))
    parts = chosen.join(families, "hub", "left").join(own_parts, "class", "left")
    place = lambda family, part, rank: F.struct(family.alias("family"), part.cast("int").alias("part"), F.lit(rank).alias("rank"))
    as_member = F.when(F.col("hub") != F.col("class"), F.array(place(F.col("hub"), F.pmod(F.xxhash64("class"), F.col("parts")), 1)))
    as_hub = F.when(F.col("own_parts").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("own_parts") - 1), lambda p: place(F.col("class"), p, 0)))
    none = F.array().cast("array<struct<family:long,part:int,rank:int>>")
    places = parts.select(F.col("first.doc").alias("doc"), F.col("first.row").alias("row"), "class", F.concat(F.coalesce(as_member, none), F.coalesce(as_hub, none)).alias("places"))

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            found, meant = list(shingle_sets(batch.column("text"), words)), []
            for i, own in enumerate(batch.column("class").to_pylist()):
                if own != last and set_class(found[i]) == own:  # repeated rows stand beside each other
                    meant.append(i)
                last = own
            features = pa.array([found[i].tobytes() for i in meant], pa.binary())
            bits = pa.array([parity_bits(found[i]) for i in meant], pa.binary())
            meant = pa.array(meant, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("class").take(meant), batch.column("places").take(meant), features, bits], ["class", "places", "features", "bits"])

    sets = rows.join(places.hint("merge"), ["doc", "row"]).select("class", "places", "text")
    sets = sets.mapInArrow(trimmed(features_of), "class long, places array<struct<family:long,part:int,rank:int>>, features binary, bits binary")
    sets = stored(sets, "sets", compression="zstd")
    dealt = sets.select("class", "features", F.explode("places").alias("p")).select("p.family", "p.part", "p.rank", "class", "features")
    dealt = dealt.repartition("family", "part").sortWithinPartitions("family", "part", "rank", "class")
    links = stored(dealt.mapInArrow(trimmed(compare_families(percent)), "a long, b long"), "links")

    # classes that share a signature and are not joined yet: first as few pairs as may join them, then all that are left
    groups = members.select("group", "class").distinct()
    bits = sets.select("class", (F.octet_length("features") / 8).cast("long").alias("size"), "bits").dropDuplicates(["class"])
    features = sets.select("class", "features").dropDuplicates(["class"])
    joined = connected_components(links)
    for spanning in (True, False):
        met_in = groups.join(joined.withColumnRenamed("node", "class"), "class", "left")
        met_in = stored(met_in.select("group", "class", F.coalesce("component", "class").alias("component")), "met-in", compression="zstd")
        mixed = met_in.groupBy("group").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("group")
        open_ = stored(met_in.join(mixed, "group", "left_semi"), "open", compression="zstd")
        parts = dealt_in_parts(open_, BLOCK).join(bits, "class").select("group", "part", "class", "component", "size", "bits")
        parts = parts.repartition("group", "part").sortWithinPartitions("group", "part", "class")
        of_groups = stored(parts.mapInArrow(trimmed(compare_groups(percent, spanning)), "group long, a long, b long"), "pairs")
        # a group that gives none now has none that a bit pattern doesn't rule out
        groups = groups.join(of_groups.select("group").distinct(), "group", "left_semi")
        pairs = of_groups.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(features.select(F.col("class").alias("a"), F.col("features").alias("of_a")), "a")
        pairs = pairs.join(features.select(F.col("class").alias("b"), F.col("features").alias("of_b")), "b")
        more = stored(pairs.mapInArrow(trimmed(compare_pairs(percent)), "a long, b long"), "more-links")
        if not more.isEmpty():
            links = links.union(more)
            joined = connected_components(links)

    # back to documents
    to_class = classes.join(joined.withColumnRenamed("node", "class"), "class", "left")
    to_class = to_class.select("class", "first", F.coalesce("component", "class").alias("component"))
    least = to_class.groupBy("component").agg(F.min("first.doc").alias("component_id"))
    of_class = stored(to_class.join(least, "component").select("class", "component_id"), "component-of-class")
    out = of_docs.join(of_class, "class", "left")
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return out.select(back("doc").alias("doc_id"), F.col("size").alias("n_shingles"), back("component_id").alias("found"), "size").select("doc_id", "n_shingles", F.when(F.col("size") > 0, F.col("found")).otherwise(F.col("doc_id")).alias("component_id"))
