"""Operator 7: secrets in texts.

An Aho-Corasick automaton over all keywords finds where a secret may start; regular expressions are
tried only there, anchored at the hit. Kinds whose tokens embed a checksum are reported only if it
holds. Long hexadecimal runs have no keyword; they are found by their own run pattern.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order that breaks ties.
KINDS = ["assign", "access", "hex", "github", "npm", "card"]
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
GITHUB_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
CARD_WORDS = ["card", "visa"]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
CARD = re.compile(r"[a-z]+\x20*(?:no\.?|nr\.?|number)?\x20*[:=#]?\x20*((?:[0-9][\x20-]?){12,18}[0-9])(?![0-9])", re.IGNORECASE | re.ASCII)

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DELETES = {c: None for c in map(ord, " -")}


def base62_crc_holds(token: str) -> bool:
    """Of ``<prefix>_<30 characters><6 base-62 digits>``: the digits are the CRC-32 of the 30 characters."""
    body = token.rpartition("_")[2]
    value = zlib.crc32(body[:-6].encode())
    digits = ""
    while value:
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return body[-6:] == digits.rjust(6, "0")


def luhn_holds(number: str) -> bool:
    digits = [int(c) for c in number.translate(DELETES)]
    doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0 and len(set(digits)) > 1


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ["akia"]), ("github", GITHUB_WORDS), ("npm", ["npm_"]), ("card", CARD_WORDS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


_automata: list = []


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, order of the kind, end) of each secret, in code points, sorted."""
    if not _automata:
        _automata.append(_automaton())
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer; keywords are ASCII, so only that is lowered
        low = "".join(c.lower() if c < "\x80" else c for c in text)
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in _automata[0].iter(low):
        hits.setdefault(kind, []).append(end - n + 1)
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for order, kind, pattern, valid in (
        (0, "assign", ASSIGN, lambda m: len(m[2]) >= 6),
        (1, "access", ACCESS, lambda m: len(m[0]) >= 20),
        (3, "github", GITHUB, lambda m: base62_crc_holds(m[0])),
        (4, "npm", NPM, lambda m: base62_crc_holds(m[0])),
        (5, "card", CARD, lambda m: luhn_holds(m[1])),
    ):
        past = 0
        for start in sorted(hits.get(kind, ())):
            if start >= past and (m := pattern.match(text, start)):
                past = m.end()
                if valid(m):
                    spans.append((m.start(1) if kind == "card" else start, order, past))
    return sorted(spans)


def secret_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: an array of (start, kind, stop), code points, stop exclusive, sorted.

    A null or empty text has an empty array. All other columns stay; ``secrets`` replaces a column of
    that name. Repeated rows each get their own spans. No shuffle; a very long text is scanned whole, as one row of one
    task. An empty table stays empty. Of spans that begin together the kind that is listed first comes first.
    """
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())]))

    @F.arrow_udf("array<struct<start:int,kind:string,stop:int>>")
    def scan(texts: pa.Array) -> pa.Array:
        few = (texts.slice(k, 256).to_pylist() for k in range(0, len(texts), 256))
        found = (find_secrets(t) if t else [] for own in few for t in own)
        return pa.array([[{"start": a, "kind": KINDS[k], "stop": b} for a, k, b in spans] for spans in found], kinds)

    return docs.withColumn("secrets", scan(F.col(text_col).cast("string")))


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """Replaces each secret in the text by ``mask``; overlapping spans become one.

    Null texts stay null, empty ones empty; rows, their order and other columns stay. Very long texts are
    worked on whole.
    """

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        few = (texts.slice(k, 256).to_pylist() for k in range(0, len(texts), 256))
        return pa.concat_arrays([pa.nulls(0, pa.string()), *(pa.array([mask_text(t, mask) if t else t for t in own], pa.string()) for own in few)])

    return docs.withColumn(text_col, masked(F.col(text_col).cast("string")))


def mask_text(text: str, mask: str) -> str:
    parts, at = [], 0
    for start, _, end in find_secrets(text):
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join(parts) + text[at:]


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from ``secrets`` of ``secret_spans``."""
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    return docs.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
