"""Operator 2: quality scores by random Fourier features, ridge regression and isotonic calibration.

Statistics of a text are standardised and mapped to cosines of random projections, whose inner
products approximate a Gaussian kernel. Each partition sums its part of the normal equations; the sum
is as large as the number of features squared, whatever the input, and is solved on the driver. A
fold kept from the fit calibrates: its labels are counted by bins of the raw score, adjacent bins
are pooled until the rates rise (isotonic regression), and scores are read off between the pools.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import stored
from pulsegrid.llm.word_hashes import hash_words, pieces

STATISTICS = ["log_words", "word_bytes", "word_spread", "symbols", "digits", "upper", "marks", "lines", "distinct", "wide", "spaces", "repeats"]


def _class_of_bytes(characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters.encode())] = True
    return found


BYTES = {
    "symbols": _class_of_bytes("#*$%&|<>{}[]\\^~_=+@"),
    "digits": _class_of_bytes("0123456789"),
    "upper": _class_of_bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "marks": _class_of_bytes(".,;:!?"),
    "lines": _class_of_bytes("\n"),
    "spaces": _class_of_bytes(" \t\n\r\x0b\x0c"),
    "wide": np.arange(256) >= 128,
}


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; a null or empty one has zeros."""
    out = []
    for k, n in pieces(texts):
        words = hash_words(texts.slice(k, n))
        counts = np.diff(words.first).astype(float)
        size = np.diff(words.offsets).astype(float)
        per_word, per_byte = np.maximum(counts, 1), np.maximum(size, 1)
        owner = words.text_of()
        length = (words.ends - words.starts).astype(float)
        total = lambda values: np.bincount(owner, values, n)  # noqa: B023, E731
        mean = total(length) / per_word
        spread = np.sqrt(np.maximum(total(length**2) / per_word - mean**2, 0))
        order = np.lexsort((words.hashes, owner))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (words.hashes[order[1:]] != words.hashes[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
        distinct = np.bincount(owner[order[fresh]], minlength=n) / per_word
        again = np.zeros(len(owner), bool)
        again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
        share = {}
        for name, wanted in BYTES.items():
            sums = np.concatenate([[0], np.cumsum(wanted[words.data])])
            share[name] = (sums[words.offsets[1:]] - sums[words.offsets[:-1]]) / per_byte
        share |= {"log_words": np.log1p(counts), "word_bytes": mean, "word_spread": spread, "distinct": distinct, "repeats": total(again.astype(float)) / per_word}
        out.append(np.stack([share[s] for s in STATISTICS], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


@dataclass(frozen=True)
class Model:
    """Small whatever the input: sizes depend on STATISTICS, ``features`` and ``bins`` only."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([waves, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(values: np.ndarray, hits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent bins until the rates rise; mean raw score and rate of each pool."""
    pools: list[list[float]] = []
    for v, h, c in zip(values, hits, counts):
        pools.append([v * c, h, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([v / c for v, _, c in pools]), np.array([h / c for _, h, c in pools])


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width))


def fit(labelled: DataFrame, features: int = 256, bandwidth: float = 3.0, ridge: float = 1.0, bins: int = 1000, seed: int = 7) -> Model:
    """From rows (x: array of STATISTICS, label: double, calibrate: boolean). All rows count.

    Without rows to fit every score is 0.5; without rows to calibrate raw scores are cut to 0 to 1.
    """
    width = len(STATISTICS)
    random = np.random.default_rng(seed)
    directions, phases = random.normal(0, 1 / bandwidth, (width, features)), random.uniform(0, 2 * np.pi, features)
    fitted = labelled.where("not calibrate")
    moments = fitted.agg(F.count("*"), *(f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(width))).first()
    if not moments[0]:
        flat = np.zeros(features + 1)
        return Model(np.zeros(width), np.ones(width), directions, phases, flat, np.array([0.0]), np.array([0.5]))
    mean, spread = np.array(moments[1 : width + 1]), np.array(moments[width + 1 :])
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), directions, phases, np.zeros(features + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def part_of_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                part = batch.slice(k, 8192)
                z = model.expand(as_matrix(part.column(0), width))
                total += z.T @ np.concatenate([z, part.column(1).to_numpy()[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(features + 1), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["line", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in table.column("sums").to_pylist())
        return pa.table({"line": table.column("line").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = min(64, int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = fitted.select("x", "label").repartition(parts).mapInArrow(part_of_equations, "line int, sums binary").groupBy("line").applyInArrow(add, "line int, sums binary")
    lines = {r["line"]: np.frombuffer(bytes(r["sums"]), float) for r in sums.collect()}  # features + 1 rows of as many numbers
    equations = np.stack([lines[i] for i in range(features + 1)])
    penalty = ridge * np.eye(features + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(equations[:, :-1] + penalty, equations[:, -1])
    model = Model(model.mean, model.scale, directions, phases, weights, model.knots, model.levels)

    @F.arrow_udf("int")
    def bin_of(x: pa.Array) -> pa.Array:
        raw = np.clip(model.raw(as_matrix(x, width)), -0.5, 1.5)
        return pa.array(np.minimum((raw + 0.5) / 2 * bins, bins - 1).astype(np.int32), pa.int32())

    counted = labelled.where("calibrate").groupBy(bin_of("x").alias("bin")).agg(F.sum("label").alias("hits"), F.count("*").alias("n")).orderBy("bin").collect()  # ``bins`` rows at most
    if counted:
        centres = np.array([(r["bin"] + 0.5) / bins * 2 - 0.5 for r in counted])
        knots, levels = isotonic(centres, np.array([r["hits"] for r in counted]), np.array([float(r["n"]) for r in counted]))
        model = Model(model.mean, model.scale, directions, phases, weights, knots, levels)
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; -1 for a null id."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % 5).cast("int"), F.lit(-1))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Labels are learnt from ids whose ``fold`` is 1 to 4 (4 calibrates); those of fold 0 are held out.
    Scores depend on the text alone. Null and empty texts have statistics of zero and get a score like
    any other. Several labels of a document count as the smallest; null ids or labels as none.
    """

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.ravel()))

    rows = stored(docs.select("doc_id", measured(F.col("text").cast("string")).alias("x")), "statistics")
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    learnt = rows.join(label, "doc_id").where(fold(F.col("doc_id")) > 0)
    model = fit(learnt.select("x", "label", (fold(F.col("doc_id")) == 4).alias("calibrate")), **options)

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        return pa.array(model.score(as_matrix(x, len(STATISTICS))))

    out = rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), scored("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
