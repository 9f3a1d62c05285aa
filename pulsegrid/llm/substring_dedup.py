"""Operator 9: repeated passages by prefix-partitioned suffix trees.

A suffix starts at each word of each text. Only its first ``window`` words matter, so the suffix
tree is cut at that depth and its nodes there are the windows that occur. Suffixes are split by a
prefix of variable length: the words up to the end of the first window's anchor, the ``anchor_words``
words whose hash is the smallest within the window. Equal windows have equal prefixes, so each
subtree is whole within one group; groups are dealt by the hash of the anchor into as many buckets
as keep each in memory. Within a bucket the suffixes of an anchor are sorted, which lays out the
subtree's leaves; nodes at full depth with leaves of several documents are the repeats, and runs of
consecutive places under such nodes are the maximal repeats.

A task first merges the equal windows of the documents it holds (all but those of its smallest
document are decided at once), so a passage that stands in a third of all documents sends the suffixes
of one document for each task and not of each document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.row_keys import NO_ID, with_rows
from pulsegrid.llm.word_hashes import hash_words, mix, pieces, sequences

#: Bytes of text whose suffixes a task merges before it sends them, and bytes of text for each bucket.
TASK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20

SENT = "bucket long, anchors binary, docs binary, rows binary, places binary, counts binary, steps binary, low binary, high binary, own binary, own_rows binary, own_places binary"


def anchors_of(hashes: np.ndarray, first: np.ndarray, window: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window within one text: its start, the start of its anchor and the anchor's hash."""
    grams = sequences(hashes, anchor_words)
    span = window - anchor_words + 1
    if len(grams) < span:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
    counts = np.maximum(np.diff(first) - window + 1, 0)
    starts = np.repeat(first[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts + least[starts]
    return starts, at, grams[at]


def send_suffixes(window: int, anchor_words: int, buckets: int):
    """Rows for SENT from (doc, row, text): suffixes by bucket, and places already known to be repeats."""

    def of_chunk(held: list[tuple[int, int, np.ndarray]]) -> Iterator[dict]:
        held.sort(key=lambda x: x[:2])
        ids, own_rows = (np.array([x[j] for x in held], np.int64) for j in (0, 1))
        first = np.concatenate([[0], np.cumsum([len(h) for *_, h in held])])
        hashes = np.concatenate([h for *_, h in held]) if held else np.zeros(0, np.uint64)
        starts, at, anchors = anchors_of(hashes, first, window, anchor_words)
        if not len(starts):
            return
        whole = sequences(hashes, window)[starts]
        text = np.repeat(np.arange(len(ids)), np.maximum(np.diff(first) - window + 1, 0))
        # equal windows of this task: the first is of the smallest document, as texts are sorted by id; all
        # its places are sent, as a smaller document of another task makes each of them a repeat
        order = np.argsort(whole, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = whole[order[1:]] != whole[order[:-1]]
        leader = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        repeat = np.zeros(len(order), bool)
        repeat[order] = ids[text[order]] > ids[text[leader]]
        place = starts - first[text]
        for bucket, rows in split(bucket_of_row(ids[text], own_rows[text], buckets), np.flatnonzero(repeat)):
            yield {"bucket": bucket, "own": ids[text[rows]].tobytes(), "own_rows": own_rows[text[rows]].tobytes(), "own_places": place[rows].astype(np.int32).tobytes()}
        rows = np.flatnonzero(~repeat)
        # one record for the windows of an anchor
        new = np.ones(len(rows), bool)
        new[1:] = at[rows[1:]] != at[rows[:-1]]
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(rows)))
        bucket_of = (mix(anchors[rows[heads]]) % np.uint64(buckets)).astype(np.int64)
        for bucket, chosen in split(bucket_of, np.arange(len(heads))):
            n = counts[chosen]
            member = rows[np.repeat(heads[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            head = rows[heads[chosen]]
            code = whole[member] >> np.uint64(24)
            yield {
                "bucket": bucket,
                "anchors": anchors[head].tobytes(),
                "docs": ids[text[head]].tobytes(),
                "rows": own_rows[text[head]].tobytes(),
                "places": (at[head] - first[text[head]]).astype(np.int32).tobytes(),
                "counts": n.astype(np.uint8).tobytes(),
                "steps": (at[member] - starts[member]).astype(np.uint8).tobytes(),
                "low": code.astype(np.uint32).tobytes(),
                "high": (code >> np.uint64(32)).astype(np.uint8).tobytes(),
            }

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, own_rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for k, n in pieces(texts):
                words = hash_words(texts.slice(k, n))
                size += int(words.offsets[-1])
                held += [(i, row, words.hashes[a:b]) for i, row, a, b in zip(ids[k : k + n], own_rows[k : k + n], words.first[:-1], words.first[1:]) if b - a >= window]
                if size >= TASK_BYTES:
                    yield as_batch(of_chunk(held), SENT)
                    held, size = [], 0
        yield as_batch(of_chunk(held), SENT)

    return send


def as_batch(rows: Iterable[dict], schema: str) -> pa.RecordBatch:
    """One batch of rows of a bucket and binary columns; columns that a row leaves out are empty."""
    rows = list(rows)
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c, b"") for r in rows], pa.int64() if c == "bucket" else pa.binary()) for c in names], names)


def pmod(values: np.ndarray, n: int) -> np.ndarray:
    return (mix(values.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


def bucket_of_row(docs: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return pmod(docs ^ mix(rows.astype(np.uint64)).view(np.int64), n)


def split(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each key, in their order."""
    order = rows[np.argsort(keys[rows], kind="stable")]
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(keys[part[0]]), part


def repeats_of_bucket(table: pa.Table, buckets: int) -> pa.Table:
    """Of one bucket's subtrees: documents and starts of their windows that a smaller document has, by buckets of documents."""
    joined = lambda name, dtype: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)
    anchors, docs, rows, places, counts = joined("anchors", np.uint64), joined("docs", np.int64), joined("rows", np.int64), joined("places", np.int32), joined("counts", np.uint8).astype(np.int64)
    at = np.cumsum(counts) - counts
    order = np.argsort(anchors, kind="stable")
    same = anchors[order[1:]] == anchors[order[:-1]]
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    chosen = order[shared]
    n = counts[chosen]
    member = np.repeat(at[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    step = joined("steps", np.uint8)[member]
    code = joined("low", np.uint32)[member].astype(np.uint64) | joined("high", np.uint8)[member].astype(np.uint64) << np.uint64(32)
    leaf = mix(np.repeat(anchors[chosen], n) ^ mix(code | step.astype(np.uint64) << np.uint64(40)))
    doc, row = np.repeat(docs[chosen], n), np.repeat(rows[chosen], n)
    place = np.repeat(places[chosen], n) - step
    order = np.lexsort((doc, leaf))  # leaves of the subtrees, smallest document first
    leaf, doc, row, place = leaf[order], doc[order], row[order], place[order]
    fresh = np.ones(len(leaf), bool)
    fresh[1:] = leaf[1:] != leaf[:-1]
    least = doc[np.maximum.accumulate(np.where(fresh, np.arange(len(leaf)), 0))] if len(leaf) else doc
    repeat = doc > least
    doc = np.concatenate([doc[repeat], joined("own", np.int64)])
    row = np.concatenate([row[repeat], joined("own_rows", np.int64)])
    place = np.concatenate([place[repeat], joined("own_places", np.int32)]).astype(np.int32)
    parts = [(bucket, *(x[own].tobytes() for x in (doc, row, place))) for bucket, own in split(bucket_of_row(doc, row, buckets), np.arange(len(doc)))]
    return pa.table({"bucket": pa.array([x[0] for x in parts], pa.int64())} | {name: pa.array([x[j] for x in parts], pa.binary()) for j, name in enumerate(("docs", "rows", "places"), 1)})


def places_of_documents(table: pa.Table) -> pa.Table:
    """Of a bucket of documents: a row for each, with its places sorted."""
    doc, row, place = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("docs", np.int64), ("rows", np.int64), ("places", np.int32)))
    order = np.lexsort((place, row, doc))
    doc, row, place = doc[order], row[order], place[order]
    heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(doc))
    return pa.table({"doc": pa.array(doc[heads], pa.int64()), "row": pa.array(row[heads], pa.int64()), "places": pa.array([place[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary())})


def own_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, row (see ``with_rows``), doc_id and text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_rows(rows, "doc_id", "text").select(F.col("__doc").alias("doc"), F.col("__row").alias("row"), "doc_id", "text")


def repeated_windows(rows: DataFrame, window: int = 13, anchor_words: int = 5) -> DataFrame:
    """From ``own_rows``: doc, row and ``places`` (binary, 32-bit starts of windows, in words) of what a smaller document has too.

    A row for each such document. Documents with a null id are neither searched nor sources.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    sent = rows.where(F.col("doc") != NO_ID).select("doc", "row", "text").mapInArrow(send_suffixes(window, anchor_words, buckets), SENT)
    found = sent.groupBy("bucket").applyInArrow(lambda t: repeats_of_bucket(t, buckets), "bucket long, docs binary, rows binary, places binary")
    return found.groupBy("bucket").applyInArrow(places_of_documents, "doc long, row long, places binary")


def covered(places: bytes, n_words: int, window: int) -> np.ndarray:
    """Which of a text's words stand in one of the windows; places beyond the text are ignored."""
    starts = np.unique(np.frombuffer(places, np.int32))
    starts = starts[starts + window <= n_words]
    change = np.zeros(n_words + 1, np.int64)
    change[starts] += 1
    np.subtract.at(change, starts + window, 1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 13, anchor_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and text: the words left, joined by one space.

    A word goes if a window that covers it also starts in a document with a smaller id; windows are
    judged on the input. A null or empty text has no words and gives an empty text; a text of fewer
    words than a window stays, one with a null id too; very long texts are worked on whole. Rows that
    repeat an id are each judged by their own text; neither has the smaller id. Other columns are left
    out. An empty table gives no rows.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.encode().split() if text else []
                counts.append(len(words))
                if places and words:
                    gone = covered(places, len(words), window)
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    removed.append(0)
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    rows = own_rows(docs, id_col, text_col)
    joined = rows.join(repeated_windows(rows, window, anchor_words).hint("merge"), ["doc", "row"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(apply, "doc_id long, n_words long, n_removed long, text string")


def maximal_repeats(docs: DataFrame, window: int = 13, anchor_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop (in words, stop exclusive): the maximal runs of words under repeated windows, of each row."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, stops = [], [], []
            for i, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.unique(np.frombuffer(places, np.int32))
                cuts = np.flatnonzero(np.diff(at) > 1) + 1
                for run in np.split(at, cuts):
                    ids.append(i)
                    starts.append(int(run[0]))
                    stops.append(int(run[-1]) + window)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], ["doc_id", "start", "stop"])

    return repeated_windows(own_rows(docs, id_col, text_col), window, anchor_words).select("doc", "places").mapInArrow(spans, "doc_id long, start long, stop long")


def removal_digest(kept: DataFrame) -> DataFrame:
    """The contract's columns, from ``remove_repeats``."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
