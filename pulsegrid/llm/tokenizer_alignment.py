"""Operator 11: alignment of the tokens that two tokenizers give the same texts.

Texts are cut before runs of white space where neither vocabulary can hold a token across (``segments``;
both vocabularies are read to make sure, and where they can, texts stay whole). Documents become
numbers into the segments of their chunk of the corpus; the segments of all chunks are dealt by their
text, so that equal ones meet and are tokenized and aligned once; alignments go back to each chunk that
has the segment, and documents are composed from them. Links are counted over the corpus by chunk first,
and the counts joined back likewise.

An alignment is a path over the tokens of both sides: a step says whose token ends at the next place
where one does (0: both, so a group ends; 1: A's; 2: B's), and each step is one link.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import delete_tables, recorded, stored
from pulsegrid.llm.segments import SPACES, cutting_pattern, is_byte_level, is_regular, never_behind
from pulsegrid.llm.word_tokens import byte_characters

#: Characters of the texts of a chunk, whose documents and segments one task holds at a time.
CHUNK = 64 << 20
ROWS = 256
#: Alignments that a task holds before it sends them to their chunks.
HELD = 200_000
BLANK = "▁"


class TokenizerPair:
    """Two vocabularies: A byte-level BPE of ``tokenizers``, B pieces of ``sentencepiece`` that put a blank before a text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        about, characters = json.loads(self.a.to_str()), {c: bytes([b]) for b, c in byte_characters().items()}
        self.a_bytes = [self._a_bytes(self.a.id_to_token(i), characters) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        probe = "a  b \t\n c "
        unchanged = self.joined_b(self.b.encode(probe)) == b" " + probe.encode()
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.cuts = never_behind(plain, BLANK) if is_byte_level(about) and unchanged else set()
        self.guard = self.b.encode("x")
        self.short = max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16

    @staticmethod
    def _a_bytes(token: str | None, characters: dict[str, bytes]) -> bytes:
        return b"".join(characters.get(c) or c.encode() for c in token or "")

    def joined_b(self, ids: list[int]) -> bytes:
        return b"".join([self.b_bytes[i] for i in ids])

    def ids_of(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each segment by A and by B."""
        first = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        # B puts the blank before a text by itself; before other white space a letter stands, whose ids go again
        own = [s[1:] if len(s) > 1 and s[0] == " " else "x" + s for s in segments]
        second = self.b.encode(own, num_threads=1)
        return first, [ids if len(s) > 1 and s[0] == " " else ids[len(self.guard) :] for s, ids in zip(segments, second)]

    def steps(self, segment: str, a: list[int], b: list[int]) -> bytes | None:
        """The path over the tokens; None if either tokenizer changes the bytes."""
        whole, a_bytes, b_bytes = segment.encode(), self.a_bytes, self.b_bytes
        first, second = [a_bytes[i] for i in a], [b_bytes[i] for i in b]
        if b"".join(first) != whole or b"".join(second) != whole:
            return None
        ends = {}
        at = 0
        for x in first:
            at += len(x)
            ends[at] = 1
        at = 0
        for x in second:
            at += len(x)
            ends[at] = 0 if at in ends else 2
        return bytes([ends[k] for k in sorted(ends)])


_pairs: dict[tuple[str, str], TokenizerPair] = {}


def pair_of(a_path: str, b_path: str) -> TokenizerPair:
    """The vocabularies of this Python worker."""
    if (a_path, b_path) not in _pairs:
        _pairs[a_path, b_path] = TokenizerPair(a_path, b_path)
    return _pairs[a_path, b_path]


class Numbers(dict):
    """Numbers of words in order of their first use; ``spelled`` keeps them with ``before`` put in front."""

    def __init__(self, spelled: list[str], before: str = ""):
        super().__init__()
        self.spelled, self.before = spelled, before

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self.spelled)
        self.spelled.append(word if word.startswith("\n") else self.before + word)
        return n


def in_chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (chunk, doc_id, low, high: the lower 16 and the other bits of its words' numbers) and of chunks (chunk, words)."""
    names = ["chunk", "doc_id", "low", "high", "words"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = pair_of(a_path, b_path).cuts
        segments, quick = cutting_pattern(cuts).findall, " " in cuts and "\n" in cuts
        words: list[str] = []
        behind_blank, literal = Numbers(words, " "), Numbers(words)
        chunk, held = uuid.uuid4().int >> 65, 0

        def end_of_chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([words], pa.list_(pa.string()))], names)

        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                start = 0
                texts, found = part.column(1).to_pylist(), []
                for n, text in enumerate(texts):
                    if not text:
                        found.append(np.empty(0, np.int32))
                    elif quick and is_regular(" " + text):
                        found.append(np.fromiter(map(behind_blank.__getitem__, text.replace("\n", " \n").split(" ")), np.int32))
                    else:
                        found.append(np.fromiter(map(literal.__getitem__, segments(" " + text)), np.int32))
                    held += len(text or "")
                    if held >= CHUNK or n == len(texts) - 1:
                        low, high = ([(f >> bits).astype(kind).tobytes() for f in found] for bits, kind in ((0, "<u2"), (16, "<u2")))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk)), part.column(0).slice(start, len(found)), pa.array(low, pa.binary()), pa.array(high, pa.binary()), pa.nulls(len(found), pa.list_(pa.string()))], names)
                        start, found = n + 1, []
                    if held >= CHUNK:
                        yield end_of_chunk()
                        words.clear()
                        behind_blank.clear()
                        literal.clear()
                        chunk, held = uuid.uuid4().int >> 65, 0
        if words:
            yield end_of_chunk()

    return docs.mapInArrow(number, "chunk long, doc_id long, low binary, high binary, words array<string>")


ALIGNED = ["of", "numbers", "n_a", "n_b", "n_steps", "a", "b", "steps"]


def aligned_segments(words: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows (of, numbers, n_a, n_b, n_steps, a, b, steps) of chunks from ``words`` (of, number, word): alignments one after

    the other, numbers of tokens and steps as 32-bit integers. Where a tokenizer changes a segment's bytes n_steps is 0.
    Equal words meet in a task and follow each other there; each is tokenized and aligned once.
    """

    def send(held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda x: x[0])
        rows, at = [], 0
        while at < len(held):
            end = at
            while end < len(held) and held[end][0] == held[at][0]:
                end += 1
            _, numbers, n_a, n_b, n_steps, a, b, steps = zip(*held[at:end])
            packed = [np.array(x, "<i4").tobytes() for x in (numbers, n_a, n_b, n_steps)]
            rows.append((held[at][0], *packed, *(b"".join(x) for x in (a, b, steps))))
            at = end
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(x, pa.binary()) for x in columns[1:])], ALIGNED)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, last, code = pair_of(a_path, b_path), [], None, ()
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                of, number, word = (batch.column(c).slice(k, 4096).to_pylist() for c in range(3))
                new = list(dict.fromkeys(word))
                if new[0] == last:
                    new = new[1:]
                codes = {last: code}
                for w, a, b in zip(new, *pair.ids_of(new)) if new else ():
                    steps = pair.steps(w, a, b)
                    codes[w] = (0, 0, 0, b"", b"", b"") if steps is None else (len(a), len(b), len(steps), np.array(a, "<u2").tobytes() if pair.short else np.array(a, "<u4").tobytes(), np.array(b, "<u2").tobytes() if pair.short else np.array(b, "<u4").tobytes(), steps)
                held += [(o, n, *codes[w]) for o, n, w in zip(of, number, word)]
                last, code = word[-1], codes[word[-1]]
                if len(held) >= HELD:
                    yield send(held)
                    held = []
        if held:
            yield send(held)

    dealt = words.select("of", "number", "word").repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(align, "of long, numbers binary, n_a binary, n_b binary, n_steps binary, a binary, b binary, steps binary")


def composed(a_path: str, b_path: str, digest: bool):
    """The function that makes a chunk's documents from the alignments of its words, and a row with how many of them hold each link."""

    def compose(docs: pa.Table, words: pa.Table) -> pa.Table:
        pair = pair_of(a_path, b_path)
        size, kind = len(pair.b_bytes), "<u2" if pair.short else "<u4"
        joined = lambda c, kind: np.frombuffer(b"".join(words.column(c).to_pylist()), kind)
        numbers, n_a, n_b, n_steps = (joined(c, "<i4") for c in ALIGNED[1:5])
        a, b, steps = joined("a", kind), joined("b", kind), joined("steps", np.uint8)
        # a step's tokens: how many have ended before it, over all words
        links = a[np.cumsum(steps != 2) - (steps != 2)].astype(np.int64) * size + b[np.cumsum(steps != 1) - (steps != 1)]
        links = links.astype(np.int32 if len(pair.a_bytes) * size < 1 << 31 else np.int64)
        ends = np.cumsum(n_steps)
        n_groups = np.diff(np.append(0, np.append(0, np.cumsum(steps == 0))[ends]))
        groups, decimal = [""] * len(numbers), [str(i) for i in range(max(len(pair.a_bytes), size))]
        spelled_a, spelled_b = [decimal[i] for i in a.tolist()], [decimal[i] for i in b.tolist()]
        marks = bytes(steps)
        at_a = at_b = start = 0
        for k, end in enumerate(ends.tolist()):
            parts = []
            at = start
            while at < end:
                stop = marks.index(0, at) + 1
                own = marks[at:stop]
                to_a, to_b = at_a + (stop - at) - own.count(2), at_b + (stop - at) - own.count(1)
                parts.append(",".join(spelled_a[at_a:to_a]) + "|" + ",".join(spelled_b[at_b:to_b]))
                at, at_a, at_b = stop, to_a, to_b
            groups[k] = ";".join(parts)
            start = end
        # alignments in order of the words' numbers
        place = np.empty(len(numbers), np.int64)
        place[numbers] = np.arange(len(numbers))
        groups = [groups[k] for k in place.tolist()]
        n_a, n_b, n_groups, counts, firsts = (x[place] for x in (n_a, n_b, n_groups, n_steps, ends - n_steps))
        chunk, batches, seen = docs.column("chunk")[0].as_py(), [], []
        names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "times"]

        def out(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            *numbers, text, own, times = zip(*rows)
            offsets = np.append(0, np.cumsum([len(x) for x in own])).astype(np.int32)
            as_list = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(kind)))
            columns = [pa.array(np.full(len(rows), chunk)), ids, *(pa.array(x, pa.int64()) for x in numbers), pa.array(text, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, as_list(own, links.dtype), as_list(times, np.int32)], names)

        nothing = (0, 0, 0, 0, "", np.empty(0, links.dtype), np.empty(0, np.int64))
        for batch in docs.to_batches(max_chunksize=ROWS):
            low, high, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("low", "high", "doc_id"))
            rows = []
            for x, y in zip(low.to_pylist(), high.to_pylist()):
                own = np.frombuffer(x, "<u2").astype(np.int32) | np.frombuffer(y, "<u2").astype(np.int32) << 16
                size_of = counts[own]
                if not len(own) or not size_of.all():
                    rows.append(nothing)
                    continue
                total = int(size_of.sum())
                places = np.arange(total) + np.repeat(firsts[own] - (np.cumsum(size_of) - size_of), size_of)
                found, times = np.unique(links[places], return_counts=True)
                seen.append(found)
                text = ";".join([groups[i] for i in own.tolist()])
                rows.append((int(n_a[own].sum()), int(n_b[own].sum()), int(n_groups[own].sum()), total, hashlib.sha256(text.encode()).hexdigest() if digest else text, found, times))
            batches.append(out(ids, rows))
        if seen:
            found, documents = np.unique(np.concatenate(seen), return_counts=True)
            batches.append(out(pa.nulls(1, pa.int64()), [(-1, 0, 0, 0, None, found, documents)]))
        return pa.Table.from_batches(batches)

    return compose


def weighed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the counts of their links."""
    counts = counts.take(pa.array(np.argsort(counts.column("link").to_numpy())))
    link, documents, best = (counts.column(c).to_numpy() for c in ("link", "documents", "best"))
    lists, times = docs.column("links").combine_chunks(), docs.column("times").combine_chunks().flatten().to_numpy()
    at, of = np.searchsorted(link, lists.flatten().to_numpy()), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    n_best, count_sum = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
    np.add.at(n_best, of, times * best[at])
    np.add.at(count_sum, of, times * documents[at])
    return docs.drop_columns(["chunk", "links", "times"]).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2``: ids between places where both

    tokenizers end a token; with ``digest`` the sha256 of that), links (each once: A id times the size of B and B id),
    times (of each link) and chunk; and a row per chunk with n_a -1 and how many of its documents hold each link.

    Whole texts of any length. Null and empty texts, and those that a tokenizer doesn't give back byte for byte,
    have zeros and an empty string. Rows are documents each by itself, also where ids repeat or are null. An empty
    table gives no rows. Other columns are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    numbered = stored(in_chunks(rows, a_path, b_path), "numbered", compression="zstd")
    words = numbered.where("words is not null").select(F.col("chunk").alias("of"), F.posexplode("words").alias("number", "word"))
    own = aligned_segments(words, a_path, b_path)
    pair = pair_of(a_path, b_path)
    kind = "int" if len(pair.a_bytes) * len(pair.b_bytes) < 1 << 31 else "long"
    schema = f"chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<{kind}>, times array<int>"
    left = numbered.where("words is null").select("chunk", "doc_id", "low", "high")
    return left.groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(composed(a_path, b_path, digest), schema)


def alignment_digest(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document (see ``aligned_documents``).

    A link's count is the number of documents that hold it. n_best: links whose count is the highest of their A id;
    count_sum: of the counts of all links.
    """
    spark, before = docs.sparkSession, []
    with recorded(before):
        found = aligned_documents(docs, a_path, b_path, id_col, text_col, digest=True).withColumnRenamed("groups", "groups_sha256")
        found = stored(found, "composed", compression="zstd")
    delete_tables(spark, before[:-1])
    size = len(pair_of(a_path, b_path).b_bytes)
    by_chunk = found.where("n_a < 0").select("chunk", F.explode(F.arrays_zip("links", "times")).alias("x")).select("chunk", F.col("x.links").alias("link"), F.col("x.times").alias("n"))
    counts = by_chunk.groupBy("link").agg(F.sum("n").alias("documents"))
    # an A id has no more links than B has pieces
    best = F.max("documents").over(Window.partitionBy(F.floor(F.col("link") / size)))
    counts = counts.withColumn("best", (F.col("documents") == best).cast("int"))
    own = by_chunk.select(F.col("chunk").alias("of"), "link").join(counts, "link")
    rows = found.where("n_a >= 0")
    out = rows.groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(weighed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
