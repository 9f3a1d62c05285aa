"""Token ids of whole texts by the ``tokenizers`` library, remembered per word.

A tokenizer whose pre-tokenizer never joins characters across white space gives a text the ids of
its words, one word after the other. ``TextEncoder`` reads that property from the tokenizer's own
description; if it doesn't hold, whole texts go to the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import numpy as np

#: The pipeline description for which ids of a text are the ids of its words.
WORD_LOCAL_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_LOCAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

OTHER_SPACES = "\t\n\x0b\x0c\r"
#: White space, printable ASCII and Latin-1 letters: their composed form, case and class need no library.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
#: The same splitting as WORD_LOCAL_PATTERN within PLAIN, in lower case.
UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ\t-\r ]+")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder(dict):
    """Maps a word to its ids as little-endian bytes; at most ``limit`` words and as many units are kept."""

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        about = json.loads(self.tokenizer.to_str())
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        normalizers = [n["type"] for n in (about.get("normalizer") or {}).get("normalizers", [])]
        splits = (about.get("pre_tokenizer") or {}).get("pretokenizers", [])
        added = about.get("added_tokens", [])
        self.word_local = (
            normalizers == WORD_LOCAL_NORMALIZERS
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": WORD_LOCAL_PATTERN}
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )
        self.added = [t["content"].lower() for t in added]
        self.units: dict[str, bytes] = {}
        self.model, self.characters = self.tokenizer.model, byte_characters()

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _unit(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            spelled = unit if unit.isascii() else "".join(map(self.characters.__getitem__, unit.encode()))
            found = self._packed([t.id for t in self.model.tokenize(spelled)])
            if len(self.units) < self.limit:
                self.units[unit] = found
        return found

    def __missing__(self, word: str) -> bytes:
        """``word``: of PLAIN's characters and in lower case, or else with others in it and as it stands."""
        if not word:
            return b""
        low = word.lower()
        if PLAIN.fullmatch(word) and not any(t in low for t in self.added):
            core = low.rstrip(".,")
            if core == word:  # one string and one list of ids for both tables
                packed = self._unit(word) if core.isalpha() else b"".join(map(self._unit, UNIT.findall(low)))
            elif core.isalpha():
                packed = self._unit(core)
                if len(core) < len(low):
                    packed += self._unit(low[len(core) :])
            else:
                packed = b"".join(map(self._unit, UNIT.findall(low)))
        else:  # the library does all steps
            packed = self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) < self.limit:
            self[word] = packed
        return packed

    def _text(self, text: str) -> bytes:
        low = text.lower()
        if PLAIN.fullmatch(text) and not any(t in low for t in self.added):
            text = low
        for space in OTHER_SPACES:
            text = text.replace(space, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))

    def forget(self) -> None:
        """Gives back the memory of all words and units."""
        self.clear()
        self.units.clear()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each whole text as little-endian integers of ``width`` bytes; null counts as empty."""
        if not self.word_local:
            batch = self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
            return [self._packed(e.ids) for e in batch]
        return [self._text(t) if t else b"" for t in texts]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of this Python worker; workers are reused, so later tasks find its words."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]
