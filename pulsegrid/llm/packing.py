"""Operator 3: vector bin packing of token sequences.

Each item asks for several resources at once (tokens, segments, loss-bearing tokens), each with a
limit for a sequence. One sequence is open at a time; of the items that still fit in every dimension
it takes the one whose demand has the greatest dot product with what is left, both as shares of the
limits. Packing happens within the rows of an input split, so nothing is shuffled.

``pack_examples`` packs whole examples, where the dimensions differ and the dot product decides. Plain
documents (``pack_documents``) bear loss on all tokens but the first of a piece, so their limits on
segments and loss seldom bind, and the dot product then takes what fills most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.word_tokens import encoder

#: Tokens that a task gathers before it packs them; bounds its memory.
CHUNK_TOKENS = 4_000_000


def best_fit(demands: np.ndarray, left: np.ndarray, limits: np.ndarray, there: np.ndarray) -> int:
    """Row of ``demands`` that is ``there``, fits in ``left`` and has the greatest dot product with it; -1: none fits.

    Ties go to the first row.
    """
    fits = there & (demands <= left).all(axis=1)
    if not fits.any():
        return -1
    scores = (demands / limits) @ (left / limits)
    return int(np.where(fits, scores, -1.0).argmax())


def pack_whole(demands: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Sequences of item numbers, no item cut. An item beyond a limit by itself gets its own sequence."""
    kinds, of = np.unique(demands, axis=0, return_inverse=True)
    items: list[list[int]] = [[] for _ in kinds]
    for i in range(len(demands) - 1, -1, -1):
        items[of[i]].append(i)
    alone = (kinds > limits).any(axis=1)
    sequences = [[i] for k in np.flatnonzero(alone) for i in reversed(items[k])]
    there = np.array([not x for x in alone], bool)
    while there.any():
        left, own = limits.copy(), []
        while (k := best_fit(kinds, left, limits, there)) >= 0:
            own.append(items[k].pop())
            left = left - kinds[k]
            there[k] = bool(items[k])
        sequences.append(own)
    return sequences


def pack_cut(lengths: list[int], size: int, segments: int, loss: int, least_cut: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length); items may be cut.

    A piece of n tokens asks for (n, 1, n - 1): its first token is predicted from nothing and bears no
    loss. A gap of ``least_cut`` tokens or more that no rest fits is filled from the longest rest. What
    is left over at the end goes to sequences of powers of two, which need no padding.
    """
    limits = np.array([size, segments, loss], float)
    top = min(size, loss + 1)
    sequences, rests = [], [[] for _ in range(top + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        full = lengths[i] // top * top
        if lengths[i] > full:
            rests[lengths[i] - full].append((i, full))
    for i, n in enumerate(lengths):
        sequences += [[(i, at, top)] for at in range(0, n // top * top, top)]
    kinds = np.array([[n, 1, max(0, n - 1)] for n in range(top + 1)], float)
    shares = kinds / limits
    there = np.array([bool(x) for x in rests])
    while there.any():
        left, own = limits.copy(), []
        while left[1] >= 1 and there.any():
            fits = there & (kinds <= left).all(axis=1)
            if fits.any():
                n = int(np.where(fits, shares @ (left / limits), -1.0).argmax())
                i, start = rests[n].pop()
                there[n] = bool(rests[n])
            else:
                n = int(min(left[0], left[2] + 1))
                if n < least_cut:
                    break
                longest = int(np.flatnonzero(there)[-1])
                i, start = rests[longest].pop()
                there[longest] = bool(rests[longest])
                rests[longest - n].append((i, start + n))
                there[longest - n] = True
            own.append((i, start, n))
            left = left - (n, 1, n - 1)
        sequences.append(own)
    if sequences and (used := sum(n for _, _, n in sequences[-1])) < size:
        sequences += powers(sequences.pop(), used)
    return sequences


def powers(pieces: list[tuple[int, int, int]], used: int) -> list[list[tuple[int, int, int]]]:
    """The pieces as sequences whose lengths are the powers of two that ``used`` is the sum of."""
    out, pieces = [], pieces[::-1]
    for bit in range(used.bit_length() - 1, -1, -1):
        room, own = used & (1 << bit), []
        while room:
            i, start, n = pieces.pop()
            if n > room:
                pieces.append((i, start + room, n - room))
                n = room
            own.append((i, start, n))
            room -= n
        if own:
            out.append(own)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, segments: int = 64, loss: int = 2048, least_cut: int = 16, id_col: str = "doc_id", text_col: str = "text", keep_words: bool = True) -> DataFrame:
    """Packs whole texts into sequences of at most ``size`` tokens; a row per piece.

    ``keep_words``: a worker keeps the ids of words for its next task; without it their memory is given back.

    Null texts are empty, an empty text is the end id. Null ids and repeated rows are packed like any
    others. A task packs ``CHUNK_TOKENS`` tokens at a time (more where one text is longer). An empty table
    gives no rows; other columns are left out. ``sequence_id`` is the input
    split's number times 2^32 plus a count, so it is unique and the same when a lost task runs again.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path)
        end = np.array([end_id], tokens.dtype).tobytes()
        base = TaskContext.get().partitionId() << 32
        names, packed, held = [], [], 0

        def sequences() -> Iterator[pa.RecordBatch]:
            nonlocal base
            ids = [np.frombuffer(x, tokens.dtype) for x in packed]
            found = pack_cut([len(x) for x in ids], size, segments, loss, least_cut)
            rows: list[tuple] = []
            for own in found:
                at = 0
                for i, start, n in own:
                    rows.append((names[i], start, n, zlib.crc32(ids[i][start : start + n].astype("<u4").tobytes()), len(ids[i]), base, at))
                    at += n
                base += 1
            for k in range(0, len(rows), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[k : k + 8192])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            for k in range(0, len(ids), 256):
                own = [x + end for x in tokens.encode(texts.slice(k, 256).to_pylist())]
                names += ids[k : k + 256]
                packed += own
                held += sum(map(len, own)) // tokens.width
                if held >= CHUNK_TOKENS:
                    yield from sequences()
                    names, packed, held = [], [], 0
        if packed:
            yield from sequences()
        if not keep_words:
            tokens.forget()
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(pack, PIECES)


def pack_examples(examples: DataFrame, id_col: str, demand_cols: list[str], limits: list[int], chunk_rows: int = 200_000) -> DataFrame:
    """Packs whole examples (instruction data) by their demands, none cut: id, sequence_id and place in the sequence.

    A task packs ``chunk_rows`` examples at a time, over the batches it gets. Null or negative demands count
    as 0. An example beyond a limit by itself gets its own sequence. Null and repeated ids are packed like
    any others; an empty table gives no rows; other columns are left out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            nonlocal base
            part = pa.Table.from_batches(held)
            demands = np.stack([np.maximum(part.column(j + 1).to_numpy(), 0) for j in range(len(demand_cols))], axis=1).astype(float)
            found = pack_whole(demands, np.array(limits, float))
            order = [i for own in found for i in own]
            sequence = pa.array([base + s for s, own in enumerate(found) for _ in own], pa.int64())
            place = pa.array([p for own in found for p in range(len(own))], pa.int32())
            base += len(found)
            return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(order)).combine_chunks(), sequence, place], [id_col, "sequence_id", "place"])

        for batch in batches:
            for k in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(k, chunk_rows)
                if rows + part.num_rows > chunk_rows:
                    yield out()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield out()

    asked = examples.select(id_col, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in demand_cols))
    return asked.mapInArrow(pack, f"{id_col} {dict(examples.dtypes)[id_col]}, sequence_id long, place int")
