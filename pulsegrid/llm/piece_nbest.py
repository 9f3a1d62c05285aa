"""Operator 5: n-best SentencePiece segmentation, and decoding.

A text's pieces are the paths of a lattice; a path's score is the sum of its pieces' scores. Forward
Viterbi gives the best score from the start to each place. Searching backward from the end, that
score is the exact cost of what is left, so A* takes paths off its queue in order of their whole
score, and the first n that reach the start are the n best.

No piece holds a character pair that stands between two units (see ``PieceLattice.cuts``), so a
text's paths are the combinations of its units' paths. Of the n best of a text, only the n - 1 units
with the smallest loss of their second path can differ from the best one. A forward pass that keeps
two scores for each place finds best path and loss, of all new words of some texts at once in arrays;
a worker remembers them of the words that it has met, and A* runs for the words that can differ.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: A character that no piece holds costs this much more than the worst piece; its bytes are its ids.
UNKNOWN = 10.0


#: Longest word, in characters, that is worked on in arrays.
LONGEST = 48
STEP = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xD6E8FEB86659FD93)


class Beginnings:
    """What begins a piece, of one length, found by hash: the place in ``ids`` (-1: no piece itself) and ``scores``."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, scores: np.ndarray):
        self.hashes, self.ids, self.scores = hashes, ids, scores
        self.shift = np.uint64(64 - max(8, (8 * len(hashes) - 1).bit_length()))
        slots = (hashes * SPREAD) >> self.shift
        taken, first = np.unique(slots, return_index=True)
        self.at = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.at[taken] = first
        rest = np.setdiff1d(np.arange(len(hashes)), first)
        self.crowded = np.zeros(len(self.at), bool)
        self.crowded[slots[rest]] = True
        self.rest = rest[np.argsort(hashes[rest])]
        self.rest_hashes = hashes[self.rest]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        slots = (hashes * SPREAD) >> self.shift
        found = self.at[slots]
        found[self.hashes[found] != hashes] = -1
        again = np.flatnonzero((found < 0) & self.crowded[slots])
        if len(again):
            where = np.minimum(np.searchsorted(self.rest_hashes, hashes[again]), len(self.rest) - 1)
            hit = self.rest_hashes[where] == hashes[again]
            found[again[hit]] = self.rest[where[hit]]
        return found


class WordStore:
    """Best score, loss of the second path and ids of the best, of words by number. What comes after the first ``limit`` words can be dropped."""

    def __init__(self, dtype: np.dtype, limit: int):
        self.limit, self.number, self.later = limit, {}, []
        self.size, self.filled = 0, 0
        self.score, self.loss = np.zeros(1024), np.zeros(1024)
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, dtype)

    def drop_later(self) -> None:
        for word in self.later:
            del self.number[word]
        if self.later:
            self.size -= len(self.later)
            self.filled = int(self.start[self.size])
            self.later = []

    def add(self, words: list[str], score, loss, count, ids: np.ndarray) -> None:
        def grown(x: np.ndarray, used: int, more: int) -> np.ndarray:
            return np.concatenate([x, np.zeros(max(len(x) // 2, used + more - len(x)), x.dtype)]) if used + more > len(x) else x

        n, at = len(words), self.size
        self.score, self.loss, self.start, self.count = (grown(x, at, n + 1) for x in (self.score, self.loss, self.start, self.count))
        self.ids = grown(self.ids, self.filled, len(ids))
        count = np.asarray(count, np.int64)
        self.score[at : at + n], self.loss[at : at + n], self.count[at : at + n] = score, loss, count
        self.start[at : at + n + 1] = self.filled + np.append(0, np.cumsum(count))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.number.update(zip(words, range(at, at + n)))
        self.later += words[max(self.limit - at, 0) :]
        self.size, self.filled = at + n, self.filled + len(ids)


class PieceLattice:
    """Pieces of a model file and the searches over them. ``limit`` words are remembered, and a tenth as many units and alternatives."""

    def __init__(self, path: str, limit: int = 800_000):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.pieces = {m.id_to_piece(i): (i, m.get_score(i)) for i in usable}
        #: Pieces, and None for what only begins pieces.
        self.prefixes = {p[:i]: None for p in self.pieces for i in range(1, len(p))} | self.pieces
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
        self.pairs = {a + b for p in self.pieces for a, b in zip(p, p[1:])}
        self.by_words = not any(a != SPACE and b == SPACE for a, b in self.pairs)
        self.dtype = np.dtype("<u2" if m.get_piece_size() <= 1 << 16 else "<u4")
        self.limit = limit
        self.words = WordStore(self.dtype, limit)
        self.units: dict[str, tuple[float, float, bytes]] = {}
        self.alternatives: dict[tuple[str, int], list[tuple[float, bytes]]] = {}
        self.tables: list[Beginnings] = []
        for size in range(1, max(map(len, self.prefixes)) + 1):
            own = [x for x in self.prefixes if len(x) == size]
            codes = np.frombuffer("".join(own).encode("utf-32-le"), np.uint32).reshape(len(own), size).astype(np.uint64)
            hashes = np.zeros(len(own), np.uint64)
            for k in range(size):
                hashes = hashes * STEP + codes[:, k]
            found = [self.prefixes[x] or (-1, 0.0) for x in own]
            self.tables.append(Beginnings(hashes, np.array([x[0] for x in found]), np.array([x[1] for x in found])))

    def learn(self, words: set[str]) -> None:
        """Works out those of ``words`` that are not known."""
        new = [w for w in words if w not in self.words.number]
        short = [w for w in new if len(w) <= LONGEST]
        if short:
            self.words.add(short, *self.words_at_once(short))
        if long := [w for w in new if len(w) > LONGEST]:
            score, loss, packed = zip(*map(self.word, long))
            ids = [np.frombuffer(x, self.dtype) for x in packed]
            self.words.add(long, score, loss, [len(x) for x in ids], np.concatenate(ids))

    def words_at_once(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score, loss and number of ids of each, and all ids, by the same forward pass over all at once."""
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) - first[owner]
        left = sizes[owner] - place
        # pieces at each place, by growing prefixes
        at, hashes = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found = []
        for k, table in enumerate(self.tables):
            if k:
                inside = left[at] > k
                at, hashes = at[inside], hashes[inside]
            hashes = hashes * STEP + codes[at + k]
            where = table.find(hashes)
            hit = where >= 0
            if k == 0:  # a character that is no piece: its negative code stands for its ids
                none = at[~hit | (table.ids[where] < 0)]
                found.append((none, np.ones(len(none), int), -1 - codes[none].astype(np.int64), np.full(len(none), self.unknown)))
            at, hashes, where = at[hit], hashes[hit], where[hit]
            piece = table.ids[where] >= 0
            where = where[piece]
            found.append((at[piece], np.full(len(where), k + 1), table.ids[where], table.scores[where]))
            if not len(at):
                break
        start, length, ids, scores = (np.concatenate(x) for x in zip(*found))
        # nodes: a word's places and its end; pieces by the place where they end, the longest first
        tail = start + owner[start] + length
        step = place[start] + length
        order = np.argsort((step * 64 - length).astype(np.int16), kind="stable")
        start, length, ids, scores, tail, step = (x[order] for x in (start, length, ids, scores, tail, step))
        head = start + owner[start]
        nodes = len(codes) + len(words)
        best, second, via = np.full(nodes, -np.inf), np.full(nodes, -np.inf), np.full(nodes, -1)
        best[first + np.arange(len(words))] = 0.0
        cuts = np.flatnonzero((np.diff(step) != 0) | (np.diff(length) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(step)]):
            x, y = head[a:b], tail[a:b]
            value, other, now = best[x] + scores[a:b], second[x] + scores[a:b], best[y]
            better = value > now
            second[y] = np.where(better, np.maximum(now, other), np.maximum(second[y], value))
            best[y] = np.where(better, value, now)
            via[y] = np.where(better, np.arange(a, b), via[y])
        end = first + np.arange(len(words)) + sizes
        node, active, taken = end.copy(), np.arange(len(words)), []
        while len(active):
            edge = via[node[active]]
            taken.append((active, ids[edge]))
            node[active] = head[edge]
            active = active[node[active] > (first + np.arange(len(words)))[active]]
        whose = np.concatenate([x for x, _ in taken[::-1]]) if taken else np.zeros(0, int)
        path = np.concatenate([x for _, x in taken[::-1]]) if taken else np.zeros(0, int)
        order = np.argsort(whose, kind="stable")
        whose, path = whose[order], path[order]
        if len(odd := np.flatnonzero(path < 0)):
            spelled = {c: self.unknown_ids(chr(-1 - c)) for c in np.unique(path[odd]).tolist()}
            sizes = np.ones(len(path), np.int64)
            sizes[odd] = [len(spelled[c]) for c in path[odd].tolist()]
            first = np.cumsum(sizes) - sizes
            whose, whole = np.repeat(whose, sizes), np.repeat(path, sizes)
            for c, at in zip(path[odd].tolist(), first[odd].tolist()):
                whole[at : at + len(spelled[c])] = spelled[c]
            path = whole
        return best[end], best[end] - second[end], np.bincount(whose, minlength=len(words)), path.astype(self.dtype)

    def unknown_ids(self, character: str) -> tuple[int, ...]:
        if self.bytes:
            return tuple(self.bytes[b] for b in character.encode())
        return (self.model.unk_id(),)

    def edges(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place after the first: (start, score, ids) of the pieces that end there."""
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in unit]
        for start in range(len(unit)):
            if unit[start] not in self.pieces:
                into[start].append((start, self.unknown, self.unknown_ids(unit[start])))
            for end in range(start + 1, len(unit) + 1):
                piece = self.prefixes.get(unit[start:end], 0)
                if piece == 0:
                    break
                if piece is not None:
                    into[end - 1].append((start, piece[1], (piece[0],)))
        return into

    def best_and_loss(self, unit: str) -> tuple[float, float, tuple[int, ...]]:
        """Best score, loss of the second path, and ids of the best, by a forward pass that keeps two scores for each place."""
        size, get, low = len(unit), self.prefixes.get, -np.inf
        best, second = [0.0] + [low] * size, [low] * (size + 1)
        via: list = [None] * (size + 1)
        for start in range(size):
            here, next_here = best[start], second[start]
            for end in range(start + 1, size + 1):
                piece = get(unit[start:end], 0)
                if piece == 0:
                    if end > start + 1:
                        break
                    piece = None
                if piece is None:
                    if end > start + 1 or unit[start] in self.pieces:
                        continue
                    score, own = self.unknown, self.unknown_ids(unit[start])
                else:
                    score, own = piece[1], (piece[0],)
                value = here + score
                if value > best[end]:
                    second[end] = max(best[end], next_here + score)
                    best[end], via[end] = value, (start, own)
                elif value > second[end]:
                    second[end] = value
        ids, place = (), size
        while place:
            place, own = via[place]
            ids = own + ids
        return best[size], best[size] - second[size], ids

    def search(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths of a unit, best first; ties in the order of their ids from the end."""
        into = self.edges(unit)
        forward = [0.0]
        for own in into:
            forward.append(max(forward[start] + score for start, score, _ in own))
        found: list[tuple[float, tuple[int, ...]]] = []
        order = count()
        queue = [(-forward[-1], (), next(order), len(unit), 0.0, None)]
        while queue and len(found) < n:
            bound, ids, _, place, behind, path = heapq.heappop(queue)
            if place == 0:
                whole: list[int] = []
                while path is not None:
                    own, path = path
                    whole += own
                found.append((-bound, tuple(whole)))
                continue
            for start, score, own in into[place - 1]:
                heapq.heappush(queue, (-(behind + score + forward[start]), own, next(order), start, behind + score, (own, path)))
        return found

    def cuts(self, word: str) -> list[str]:
        """The word's units: cut where no piece holds the two characters beside each other."""
        units, start, pairs = [], 0, self.pairs
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                units.append(word[start:i])
                start = i
        units.append(word[start:])
        return units

    def _unit(self, unit: str) -> tuple[float, float, bytes]:
        found = self.units.get(unit)
        if found is None:
            score, loss, ids = self.best_and_loss(unit)
            found = (score, loss, np.array(ids, self.dtype).tobytes())
            if len(self.units) < self.limit // 10:
                self.units[unit] = found
        return found

    def word(self, word: str) -> tuple[float, float, bytes]:
        """Best score, loss of the second path, and ids of the best."""
        own = [self._unit(u) for u in self.cuts(word)]
        return own[0] if len(own) == 1 else (sum(x[0] for x in own), min(x[1] for x in own), b"".join(x[2] for x in own))

    def paths_of_word(self, word: str, n: int) -> list[tuple[float, bytes]]:
        best = self.alternatives.get((word, n))
        if best is None:
            best = [(0.0, b"")]
            for unit in self.cuts(word):
                own = [(s, np.array(ids, self.dtype).tobytes()) for s, ids in self.search(unit, n)]
                best = heapq.nlargest(n, ((a + s, x + y) for a, x in best for s, y in own), key=lambda p: p[0])
            if len(self.alternatives) < self.limit // 10:
                self.alternatives[word, n] = best
        return best

    def split(self, text: str) -> list[str]:
        """Words with the space before them; where pieces may run into a space, the whole text."""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_words:
            return [marked]
        own = text.split(" ")
        if "" not in own:
            return [SPACE + w for w in own]
        words, held = [], ""
        for w in own:
            held += SPACE
            if w:
                words.append(held + w)
                held = ""
        return words + [held] if held else words

    def best(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a whole text: score and ids. An empty text has one, without pieces."""
        return self.best_of([text], n)[0]

    def best_of(self, texts: list[str], n: int) -> list[list[tuple[float, bytes]]]:
        """``best`` of each text, new words of all of them worked out at once."""
        of_texts = [self.split(t) if t else [] for t in texts]
        words = [w for own in of_texts for w in own]
        store = self.words
        store.drop_later()
        self.learn(set(words))
        number = np.fromiter(map(store.number.__getitem__, words), np.int64, len(words))
        score, loss, count = store.score[number], store.loss[number], store.count[number].astype(np.int64)
        place = np.append(0, np.cumsum(count))
        ids = store.ids[np.repeat(store.start[number] - place[:-1], count) + np.arange(place[-1])].tobytes()
        width, out, at = self.dtype.itemsize, [], 0
        place = place * width
        for own in of_texts:
            if not own:
                out.append([(0.0, b"")])
                continue
            a, b = at, at + len(own)
            at = b
            whole, base = ids[place[a] : place[b]], int(place[a])
            losses = loss[a:b]
            few = np.arange(b - a)
            if n > 1 and len(few) >= n:  # of the n - 1 words of smallest loss, the first on ties
                few = np.flatnonzero(losses <= np.partition(losses, n - 2)[n - 2])
            chosen = few[np.argsort(losses[few], kind="stable")][: n - 1].tolist()
            combined: list[tuple[float, dict[int, bytes]]] = [(float(score[a:b].sum()), {})]
            for i in chosen:
                if losses[i] == np.inf:
                    break
                paths, mine = self.paths_of_word(own[i], n), whole[place[a + i] - base : place[a + i + 1] - base]
                merged = [(s + p - paths[0][0], changed if x == mine else changed | {i: x}) for s, changed in combined for p, x in paths]
                combined = heapq.nlargest(n, merged, key=lambda x: x[0])
            found = []
            for value, changed in combined:
                parts, past = [], 0
                for i in sorted(changed):
                    parts += [whole[past : place[a + i] - base], changed[i]]
                    past = place[a + i + 1] - base
                found.append((value, b"".join([*parts, whole[past:]]) if parts else whole))
            out.append(found)
        return out

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, self.dtype).tolist())


_lattices: dict[str, PieceLattice] = {}


def lattice(path: str) -> PieceLattice:
    if path not in _lattices:
        _lattices[path] = PieceLattice(path)
    return _lattices[path]


def n_best_segmentations(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, the best path's ids, little-endian, 2 bytes for up to 65,536 pieces, else 4),

    best (array of score, n_pieces and ids_crc32 of the n best, best first) and round_trip: whether
    decoding the best ids gives the text again. Null texts are empty; an empty text has one path without
    pieces. Ties of scores are all paths of equal worth: which of them come first is fixed by the order of
    the search. Rows with a null id and repeated rows each get a row; other columns are left out; an empty
    table gives no rows. A row's work stays in its task, without a shuffle; a very long text is worked on
    whole.
    """
    kind = "doc_id long, ids binary, best array<struct<score:double,n_pieces:long,ids_crc32:long>>, round_trip boolean"
    struct = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())]))

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(model_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids, best, same = [], [], []
                texts = part.column(1).to_pylist()
                for text, paths in zip(texts, pieces.best_of([t or "" for t in texts], n)):
                    ids.append(paths[0][1])
                    best.append([{"score": s, "n_pieces": len(x) // pieces.dtype.itemsize, "ids_crc32": zlib.crc32(x)} for s, x in paths])
                    same.append(pieces.decode(paths[0][1]) == (text or ""))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(best, struct), pa.array(same)], ["doc_id", "ids", "best", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(segment, kind)


def segmentation_digest(found: DataFrame) -> DataFrame:
    first = F.get("best", F.lit(0))
    of = lambda name: F.transform("best", lambda b: b[name])
    return found.select(
        "doc_id",
        first["n_pieces"].alias("n_pieces"),
        first["ids_crc32"].alias("ids_crc32"),
        F.size("best").cast("long").alias("n_paths"),
        F.array_join(F.transform(of("score"), lambda s: s.cast("string")), ",").alias("scores"),
        F.array_join(F.transform(of("ids_crc32"), lambda c: c.cast("string")), ",").alias("paths_crc32"),
        "round_trip",
    )
