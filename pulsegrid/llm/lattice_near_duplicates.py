"""Operator 8: near-duplicate vectors by E8 lattice hashing.

In each of several tables a vector, scaled to length 1, is projected to eight dimensions and decoded
to the nearest point of the E8 lattice; that point and the label are its cell. A vector also probes
the neighbouring cells that lie nearest to its projection. Of the pairs that meet in a cell those go on
whose sketches, the signs of 128 random projections, differ in no more bits than similar vectors may; six
standard deviations are allowed, so one similar pair in 10^8 is lost by that, and hardly an unrelated one
is left. Cosine in double precision decides. Equal vectors are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.components import connected_components
from pulsegrid.llm.scratch import stored

DIMENSIONS = 8
SKETCH_BITS = 128


def shortest_vectors() -> np.ndarray:
    """The 240 lattice points next to the origin."""
    found = []
    for i, j in combinations(range(DIMENSIONS), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(DIMENSIONS)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=DIMENSIONS) if np.prod(s) > 0]
    return np.array(found)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum."""
    near = np.rint(x)
    gap = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(gap[odd]).argmax(axis=1)
    near[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_lattice_point(x: np.ndarray) -> np.ndarray:
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def cell_name(points: np.ndarray) -> np.ndarray:
    """64 bits for a lattice point: its doubled coordinates, a byte each."""
    bytes_ = (np.rint(points * 2).astype(np.int64) & 0xFF).astype(np.uint8)
    return np.ascontiguousarray(bytes_).view(np.int64).ravel()


def cells(vectors: np.ndarray, tables: int, width: float, probes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Own cell (n, tables) and probed cells (n, tables, probes) of vectors of length 1."""
    random = np.random.default_rng([seed, vectors.shape[1]])
    near = shortest_vectors()
    own, probed = [], []
    for _ in range(tables):
        y = vectors @ random.normal(0, 1, (vectors.shape[1], DIMENSIONS)) / width + random.uniform(0, 2, DIMENSIONS)
        point = nearest_lattice_point(y)
        nearest = np.argpartition(-((y - point) @ near.T), probes - 1, axis=1)[:, :probes]
        own.append(cell_name(point))
        probed.append(cell_name((point[:, None, :] + near[nearest]).reshape(-1, DIMENSIONS)).reshape(-1, probes))
    return np.stack(own, axis=1), np.stack(probed, axis=1)


def sketches(vectors: np.ndarray, seed: int) -> np.ndarray:
    """128 bits of each vector, as two 64-bit integers: on which sides of random planes it lies."""
    planes = np.random.default_rng([seed, 1, vectors.shape[1]]).normal(0, 1, (vectors.shape[1], SKETCH_BITS))
    return np.packbits(vectors @ planes > 0, axis=1).view(np.int64)


def most_differing_bits(least: float) -> int:
    """Bits in which the sketches of vectors with a cosine of ``least`` or more may differ."""
    share = acos(min(max(least, -1.0), 1.0)) / pi
    return ceil(SKETCH_BITS * share + 6 * sqrt(SKETCH_BITS * share * (1 - share)))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.93, tables: int = 4, width: float = 1.2, probes: int = 12, seed: int = 11) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id and kept (it is the component's smallest id).

    Only vectors of equal, non-null label and equal length are compared. Null or zero vectors and those
    with null or non-finite components link with nothing. Repeated rows count as vectors of their own.
    Very long vectors are compared whole; other columns are left out. An empty table gives no rows. A row with a null
    vec_id gets one with nulls and no links. A pair at ``least`` itself links; equal vectors link each with all others and
    stand under their smallest id. Every pair that is reported has a cosine of ``least`` or more; the share of such
    pairs that is found depends on the other parameters (see the README).
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    sound = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull())
    alike = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("n"))
    # ids may repeat with other vectors: a class of equal vectors has a number of its own
    alike = stored(alike.withColumn("class", F.monotonically_increasing_id()), "classes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            for size in np.unique(sizes):
                chosen = pa.array(np.flatnonzero(sizes == size))
                part = batch.take(chosen)
                x = part.column("v").flatten().to_numpy().reshape(-1, size)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                own, probed = cells(x, tables, width, probes, seed)
                sketch = sketches(x, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("class"), part.column("label"), pa.array(np.full(len(x), size), pa.int32()), pa.array(list(own), pa.list_(pa.int64())), pa.array([list(p) for p in probed], pa.list_(pa.list_(pa.int64()))), pa.array(sketch[:, 0]), pa.array(sketch[:, 1])],
                    ["class", "label", "size", "own", "probed", "s0", "s1"],
                )

    kind = dict(alike.dtypes)["label"]
    keyed = stored(alike.select("class", "label", "v").mapInArrow(keys, f"class long, label {kind}, size int, own array<long>, probed array<array<long>>, s0 long, s1 long"), "cells")
    own = keyed.select("class", "s0", "s1", "label", "size", F.posexplode("own").alias("t", "cell"))
    of_other = [F.col("class").alias("other"), F.col("s0").alias("o0"), F.col("s1").alias("o1")]
    probing = keyed.select(*of_other, "label", "size", F.posexplode("probed").alias("t", "cells"))
    probing = probing.select("other", "o0", "o1", "label", "size", "t", F.explode("cells").alias("cell"))
    again = own.select(*of_other, "label", "size", "t", "cell")
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("o0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("o1")))
    met = own.join(again.union(probing), ["label", "size", "t", "cell"]).where((F.col("class") != F.col("other")) & (differ <= most_differing_bits(least)))
    pairs = met.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
    of = lambda n: alike.select(F.col("class").alias(n), F.col("v").alias(f"v{n}"), F.col("n").alias(f"n{n}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("va").offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x, y = (part.column(c).flatten().to_numpy().reshape(-1, size) for c in ("va", "vb"))
                x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
                cosine = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                linked = part.take(pa.array(np.flatnonzero(cosine >= least)))
                yield pa.RecordBatch.from_arrays([linked.column(c) for c in ("a", "b", "na", "nb")], ["a", "b", "na", "nb"])

    links = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "va", "vb", "na", "nb").mapInArrow(compare, "a long, b long, na long, nb long")
    links = stored(links, "links")
    both = links.select(F.col("a").alias("class"), F.col("nb").alias("n")).union(links.select(F.col("b").alias("class"), F.col("na").alias("n")))
    linked = both.groupBy("class").agg(F.sum("n").alias("others"))
    joined = connected_components(links.select("a", "b")).withColumnRenamed("node", "class")
    found = alike.join(linked, "class", "left").join(joined, "class", "left")
    found = found.withColumn("component", F.coalesce("component", "class"))
    least_of = found.groupBy("component").agg(F.min("least_id").alias("component_id"))
    found = found.join(least_of, "component").select("label", "v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = rows.where("sound").join(found, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
