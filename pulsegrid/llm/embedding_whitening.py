"""Operator 12: whitening of embeddings.

Spark SQL expressions sum the centred products of all pairs of dimensions (upper triangle) in one
aggregation, of which only the sums reach the driver. The triangle is cut into square tiles, so that the
aggregation, grouped by tile, has one short list of generated expressions, which Spark compiles, for any
number of dimensions. LAPACK decomposes the covariance that the sums make, and rows are projected on its
eigenvectors where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import stored

#: What an entry is multiplied by and added to, to become a whole number.
SCALE, SHIFT = 64, 1_000_000
#: Whole numbers beyond this stand at it, so that no sum of products loses its place.
FARTHEST = 1 << 52
#: Dimensions on a side of a tile; its square is the number of sums of the aggregation.
TILE = 8
#: Components whose variance is below this part of the largest can't be told from none, and are left out.
LEAST_VARIANCE = 1e-12
LONGEST = (1 << 63) - 1


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the entries as whole numbers, of the rows whose vector has entries and only finite ones."""
    entries = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = rows.select(F.col(id_col).cast("long").alias("vec_id"), entries.alias("c")).where("size(c) > 0")
    usable = usable.where(~F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    far = float(FARTHEST - SHIFT)
    return usable.select("vec_id", F.transform("c", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-far)), F.lit(far))).cast("long") + SHIFT).alias("x"))


def covariance(entries: Column, rows: DataFrame, size: int, n: int) -> np.ndarray:
    """Covariance (divisor ``n``) of arrays of ``size`` ``entries`` that are centred already: a sum of products for each pair of dimensions."""
    sides = -(-size // TILE)
    tiles = [(g, h) for g in range(sides) for h in range(g, sides)]
    flat = rows.select(entries.alias("c"), F.explode(F.array(*(F.struct(F.lit(g).alias("g"), F.lit(h).alias("h")) for g, h in tiles))).alias("tile"))
    left = [f"coalesce(get(c, tile.g * {TILE} + {i}), 0D) as l{i}" for i in range(TILE)]
    right = [f"coalesce(get(c, tile.h * {TILE} + {i}), 0D) as r{i}" for i in range(TILE)]
    sums = [F.expr(f"sum(l{i} * r{j})").alias(f"s{i}_{j}") for i in range(TILE) for j in range(TILE)]
    found = np.zeros((sides * TILE, sides * TILE))
    for g, h, *own in flat.selectExpr("tile.g", "tile.h", *left, *right).groupBy("g", "h").agg(*sums).collect():
        part = np.array(own).reshape(TILE, TILE) / n
        found[g * TILE : (g + 1) * TILE, h * TILE : (h + 1) * TILE] = part
        found[h * TILE : (h + 1) * TILE, g * TILE : (g + 1) * TILE] = part.T
    return found[:size, :size]


def whitened_embeddings(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """A row per vector and component (1 to ``components``): vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty or hold null or non-finite entries are left out; so are those that are not of
    the most frequent length (the larger on ties). Repeated rows and null ids count and come out like others.
    Components without variance (all vectors equal in them, as where there are fewer vectors than components) are
    left out; so an empty table, and one vector, give no rows. ``deviation``, the exact sum of (n x - S)^2, is null
    where no long holds it. Of equal eigenvalues any basis. Other columns are left out.
    """
    spark = rows.sparkSession
    whole = whole_numbers(rows, id_col, vector_col)
    lengths = whole.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if common is None:
        return spark.createDataFrame([], schema)
    size, n = common["size"], common["n"]
    whole = whole.where(F.size("x") == size)
    sums = whole.agg(F.array(*(F.sum(F.col("x")[i].cast("decimal(38,0)")) for i in range(size))).alias("s")).first()["s"]
    sums = [int(s) for s in sums]
    # x - S/n, with the whole part of S/n taken off in whole numbers
    mean = [divmod(s, n) for s in sums]
    floors, rests = (F.array(*(F.lit(v).cast(kind) for v in own)) for own, kind in (([q for q, _ in mean], "long"), ([r / n for _, r in mean], "double")))
    centred = F.transform("x", lambda v, i: (v - F.get(floors, i)).cast("double") - F.get(rests, i))
    variance, vectors = np.linalg.eigh(covariance(centred, whole, size, n))
    falling = np.argsort(variance)[::-1]
    variance, vectors = variance[falling], vectors[:, falling]
    trace = float(variance.sum())
    kept = min(components, size, int((variance > LEAST_VARIANCE * max(variance[0], 0.0)).sum()) if variance[0] > 0 else 0)
    if not kept:
        return spark.createDataFrame([], schema)
    onto = vectors[:, :kept] / np.sqrt(variance[:kept])
    below, rest = np.array([q for q, _ in mean], np.int64), np.array([r / n for _, r in mean])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, size)
            white = ((x - below).astype(float) - rest) @ onto
            most = max(map(abs, (int(x.max()), int(x.min())))) * n + max(map(abs, sums)) if len(x) else 0
            if most * most * size <= LONGEST:
                apart = (x * n - np.array(sums, np.int64)) ** 2
            else:
                apart = (x.astype(object) * n - np.array(sums, object)) ** 2
            exact = [int(a) if a <= LONGEST else None for a in apart.sum(1)]
            arrays = pa.ListArray.from_arrays(np.arange(0, white.size + 1, kept, np.int32), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.int64()), arrays], ["vec_id", "deviation", "w"])

    white = stored(whole.mapInArrow(project, "vec_id long, deviation long, w array<double>"), "whitened")
    means = white.agg(F.array(*(F.avg(F.col("w")[k]) for k in range(kept))).alias("m")).first()["m"]
    found = covariance(F.transform("w", lambda v, i: v - F.get(F.array(*map(F.lit, means)), i)), white, kept, n)
    error = float(np.abs(found - np.eye(kept)).max())
    explained = F.array(*(F.lit(float(v) / trace) for v in variance[:kept]))
    out = white.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
