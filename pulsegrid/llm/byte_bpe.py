"""Operator 13: byte-level BPE encoding and decoding.

A text is split by the vocabulary's own pattern; a split's bytes are symbols in a doubly linked
list. A priority queue holds the adjacent pairs that the vocabulary merges, by merge rank and then
place. The least is taken off; if its symbols have changed since, it is stale and skipped; else its
second symbol leaves the list and the pairs with the new neighbours enter the queue. Decoding joins
the vocabulary's strings and turns them into the bytes, and these into text, that they stand for.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.segments import SPACES, cutting_pattern, is_byte_level, is_regular
from pulsegrid.llm.word_tokens import byte_characters

#: Texts that a task works on at once.
ROWS = 256
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: White space, printable ASCII and Latin-1 letters: their classes need no table.
PLAIN = re.compile(rf"[\t-\r -~{LETTERS}]*")
#: The splitting pattern of byte-level vocabularies (a fixed value), with the classes as they are within PLAIN.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class ByteBpe:
    """A vocabulary of the ``tokenizers`` library. ``limit`` words and as many splits are remembered."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        about = json.loads(tokenizer.to_str())
        if not is_byte_level(about):
            raise ValueError(f"{path} is no byte-level BPE vocabulary of the known form")
        ids = about["model"]["vocab"]
        self.pre_tokenizer, self.limit = tokenizer.pre_tokenizer, limit
        characters = byte_characters()
        self.first = [ids[characters[b]] for b in range(256)]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in about["model"]["merges"]]
        self.pairs = [(ids[a] << 32) + ids[b] for a, b in merges]
        self.merged = [ids[a + b] for a, b in merges]
        self.rank = {pair: k for k, pair in enumerate(self.pairs)}
        self.start = [[self.rank.get((a << 32) + b, -1) for b in self.first] for a in self.first]
        self.added = {t["content"]: t["id"] for t in about["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in about["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.at_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        bytes_of = {c: bytes([b]) for b, c in characters.items()}
        strings = {i: b"".join(map(bytes_of.__getitem__, s)) for s, i in ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.code = "H" if len(self.strings) <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.joined = np.frombuffer(b"".join(self.strings), np.uint8)
        self.sizes = np.array([*map(len, self.strings), 0])
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.segments = cutting_pattern(SPACES).findall
        self.known: dict[str, bytes] = {}
        self.splits: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """The symbols that are left of ``data`` after all merges."""
        start, rank, pairs, merged, n = self.start, self.rank.get, self.pairs, self.merged, len(data)
        symbols, queue = [self.first[b] for b in data], []
        for i in range(n - 1):
            k = start[data[i]][data[i + 1]]
            if k >= 0:
                queue.append((k << 32) + i)
        heapify(queue)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        symbols.append(-1)  # stands behind the end and in no pair
        while queue:
            entry = heappop(queue)
            k, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if (symbols[i] << 32) + symbols[j] != pairs[k]:
                continue  # stale
            symbols[i] = new = merged[k]
            symbols[j] = -1
            after[i] = j = after[j]
            before[j] = i
            found = rank((new << 32) + symbols[j])
            if found is not None:
                heappush(queue, (found << 32) + i)
            i = before[i]
            if i >= 0:
                found = rank((symbols[i] << 32) + new)
                if found is not None:
                    heappush(queue, (found << 32) + i)
        return [s for s in symbols if s >= 0]

    def _split(self, split: str) -> bytes:
        found = self.splits.get(split)
        if found is None:
            found = array(self.code, self.merge(split.encode())).tobytes()
            if len(self.splits) < self.limit:
                self.splits[split] = found
        return found

    def _segment(self, segment: str) -> bytes:
        if PLAIN.fullmatch(segment):
            splits = SPLIT.findall(segment)
        else:  # the library's tables say what is a letter
            splits = [segment[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(segment)]
        return b"".join(map(self._split, splits))

    def _word(self, word: str) -> bytes:
        """What stands behind a blank, or else begins with a line end."""
        packed = self._segment(word if word.startswith("\n") else " " + word)
        if len(self.known) < self.limit:
            self.known[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if not is_regular(text) or text[0] in " \n" or text[-1] == " ":
            return b"".join(map(self._segment, self.segments(text)))
        first, *words = text.replace("\n", " \n").split(" ")
        known, new = self.known.get, self._word
        return self._segment(first) + b"".join([known(w) or new(w) for w in words])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as integers of ``dtype``; added tokens in it get their own ids."""
        if self.at_added is None or not self.at_added.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.at_added.finditer(text):
            out += [self._plain(text[at : m.start()]), array(self.code, [self.added[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts that stretches of ``ids`` stand for, up to each of ``ends``; bytes that are no UTF-8 become U+FFFD.

        The vocabulary's strings, one behind the other, are taken from one array of all of them. Unknown ids give nothing.
        """
        ids = np.where((ids >= 0) & (ids < len(self.strings)), ids, len(self.strings))
        size = self.sizes[ids]
        to = np.cumsum(size)
        whole = self.joined[np.arange(to[-1] if len(to) else 0) + np.repeat(self.firsts[ids] - (to - size), size)].tobytes()
        stops = np.append(0, to)[ends].tolist()
        return [whole[i:k].decode("utf-8", "replace") for i, k in zip([0, *stops], stops)]


_known: dict[str, ByteBpe] = {}


def vocabulary_of(path: str) -> ByteBpe:
    """The vocabulary of this Python worker; workers are reused, so later tasks find its words."""
    if path not in _known:
        _known[path] = ByteBpe(path)
    return _known[path]


def encoded(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with its texts' ids (array of int) in ``ids_col``, in place of the text and of a column of that name.

    Whole texts of any length; null and empty ones have no ids. Rows aren't looked at together: repeated rows
    and null ids stay as they are, an empty table stays empty, all other columns are kept.
    """
    rest = [c for c in docs.columns if c not in (text_col, ids_col)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_of(tokenizer_path)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                packed = [words.encode(t) if t else b"" for t in part.column(len(rest)).to_pylist()]
                ends = np.cumsum([0] + [len(p) // words.dtype.itemsize for p in packed]).astype(np.int32)
                ids = np.frombuffer(b"".join(packed), words.dtype).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.ListArray.from_arrays(ends, ids)], names)

    names = [*rest, ids_col]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.select(*rest, F.col(text_col).cast("string").alias("__text")).mapInArrow(encode, schema)


def decoded(tokens: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``tokens`` with the text of its ids in ``text_col``, in place of the ids and of a column of that name.

    Null ids give an empty text. Everything else as in ``encoded``.
    """
    rest = [c for c in tokens.columns if c not in (text_col, ids_col)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary_of(tokenizer_path)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                lists = part.column(len(rest))
                ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                texts = words.decode(lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False), ends)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(texts, pa.string())], names)

    names = [*rest, text_col]
    schema = T.StructType([tokens.schema[c] for c in rest] + [T.StructField(text_col, T.StringType())])
    return tokens.select(*rest, F.col(ids_col).cast("array<int>").alias("__ids")).mapInArrow(decode, schema)


def round_trip_digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids, comma-joined) and decoded_sha256 (of the text decoded from them)."""
    tokens = encoded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer_path)
    digests = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), "ids")
    return decoded(digests, tokenizer_path).withColumn("decoded_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
