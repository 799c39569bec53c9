"""Secret scans (operator 2).

1. An Aho-Corasick automaton finds the keywords of all kinds in one pass over
   the ASCII-lower-cased bytes of a text. A run of hexadecimal digits has no
   keyword of its own; there, the text's character classes are searched for a
   run of the least length.
2. A kind's regular expression is tried only at its hits, anchored there.
   Hits inside the match before are skipped, which gives the leftmost
   non-overlapping matches.
3. Tokens that carry a checksum are kept only if it is right, so text that
   merely looks like one is left alone.

All patterns are ASCII, so they run on UTF-8 bytes; offsets are then turned into
code points. Null text counts as empty. Every text is scanned whole. Repeated
rows are scanned alike; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import byte_texts, slices

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = 24
_HEX_CLASS = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))


def base62(value: int, width: int) -> str:
    out = ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(width, "0")


def checksum_is_right(token: bytes) -> bool:
    """Whether the last six characters are the CRC-32 of the body after the prefix, in base 62."""
    body = token.split(b"_", 1)[1]
    return base62(zlib.crc32(body[:-6]), 6).encode() == body[-6:]


def card_is_right(digits: bytes) -> bool:
    """The Luhn checksum of a number that may be grouped by blanks or hyphens."""
    numbers = [c - 48 for c in digits if 48 <= c <= 57]
    doubled = [n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(reversed(numbers))]
    return sum(doubled) % 10 == 0


@dataclass(frozen=True)
class Kind:
    name: str
    keywords: tuple[str, ...]  # lower case; empty for runs of hexadecimal digits
    pattern: bytes
    valid: Callable[[re.Match], bool]
    flags: int = 0


KINDS = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: len(m[2]) >= 6,
        re.IGNORECASE,
    ),
    Kind("access", ("akia",), rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    Kind("hex", (), rb"[0-9a-f]+", lambda m: len(m[0]) >= HEX_RUN),
    Kind(
        "forge",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
        lambda m: checksum_is_right(m[0]),
    ),
    Kind("package", ("npm_",), rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: checksum_is_right(m[0])),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """Finds the spans of all kinds in one text; one automaton for all keywords."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = kinds
        self.patterns = [re.compile(k.pattern, k.flags) for k in kinds]
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        for i, kind in enumerate(kinds):
            for word in kind.keywords:
                owners.setdefault(word, []).append(i)
        for word, own in owners.items():
            self.automaton.add_word(word, (len(word), own))
        self.automaton.make_automaton()
        self.runs = [i for i, k in enumerate(kinds) if not k.keywords]

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """``(start, kind, end)`` in code points, by start, then kind."""
        hits: dict[int, list[int]] = {}
        # Latin-1 gives one character per byte, so places are byte offsets.
        for end, (length, own) in self.automaton.iter(text.lower().decode("latin-1")):
            for kind in own:
                hits.setdefault(kind, []).append(end - length + 1)
        if self.runs:
            classes, at, found = text.translate(_HEX_CLASS), 0, []
            while (at := classes.find(b"h" * HEX_RUN, at)) >= 0:
                found.append(at)
                at = classes.find(b" ", at)
                if at < 0:
                    break
            for kind in self.runs:
                hits[kind] = found
        out = []
        for kind, starts in hits.items():
            match, valid, free = self.patterns[kind].match, self.kinds[kind].valid, 0
            for start in sorted(starts):
                if start >= free and (m := match(text, start)):
                    free = m.end()
                    if valid(m):
                        out.append((start, kind, free))
        out.sort()
        if out and not text.isascii():
            # Code points before a byte: bytes that do not continue a character.
            points = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
            out = [(int(points[a]), k, int(points[b])) for a, k, b in out]
        return out


def scan(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``doc_id, found array<struct<kind, start, end>>`` of every row, by start, then kind as listed."""
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    names = [k.name for k in kinds]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(kinds)
        for batch in slices(batches):
            found = [
                [{"kind": names[k], "start": a, "end": b} for a, k, b in scanner.spans(t)]
                for t in byte_texts(batch.column("text"))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(item))], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(
        find, f"doc_id {doc_kind}, found array<struct<kind: string, start: bigint, end: bigint>>"
    )
