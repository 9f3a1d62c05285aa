"""Cutting texts where no token can lie across.

A segment is a run of white space and what follows it up to the next such run. A byte-level
pre-tokenizer of the known pattern always begins a token at the start of a run of white space, as
only its last two alternatives hold white space after their first character, and those hold nothing
else. A vocabulary of merged pieces has no token across a cut if none of its pieces holds the
character after the cut behind another one. Both are read from the vocabulary files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: ASCII white space, before which texts may be cut.
SPACES = " \t\n\v\f\r"
#: What some table or other counts as white space: no cut stands after one of these.
WIDE = "\\s\\x1c-\\x1f\\x85\\u180e\\u200b-\\u200d\\u2060\\ufeff"


def cutting_pattern(cuts: Iterable[str]) -> re.Pattern:
    """``findall`` gives the segments of a text, one after the other; ``cuts``: white space before which is cut."""
    own = "".join(map(re.escape, sorted(cuts)))
    if not own:
        return re.compile(r"(?s:.+)")
    return re.compile(rf"(?=.)(?s:[{WIDE}]*[^{WIDE}]*(?:(?![{own}])[{WIDE}]+[^{WIDE}]*)*)", re.S)


#: White space other than blanks and line ends, in the widest sense.
ODD = re.compile(rf"(?![ \n])[{WIDE}]")
ODD_CLASS = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x110000)) if ODD.match(c)) + "]")


def is_regular(text: str) -> bool:
    """Whether each run of white space in ``text`` is one blank or one line end."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or ODD_CLASS.search(text))


def is_byte_level(about: dict) -> bool:
    """Whether a tokenizer's description is byte-level BPE that splits by the known pattern and changes no text."""
    split, model = about.get("pre_tokenizer") or {}, about["model"]
    return (
        about.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and bool(split.get("use_regex"))
        and not split.get("add_prefix_space")
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    )


def never_behind(pieces: Iterable[str], space: str = " ") -> set[str]:
    """White space that no piece holds behind another character; ``space`` stands for a blank in pieces, and may follow itself."""
    pairs = {a + b for p in pieces for a, b in zip(p, p[1:])}
    spelled = {c: space if c == " " else c for c in SPACES}
    return {c for c, s in spelled.items() if not any(p[1] == s and p[0] != s for p in pairs)}
