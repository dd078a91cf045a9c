"""Secrets in texts: a keyword automaton, anchored patterns at its hits, and checksums inside the tokens.

Each text is read once by an Aho-Corasick automaton over all keywords, on a copy with A-Z lower-cased and one byte per
code point. Patterns never search: they are tried only where a keyword begins (or, for kinds without one, where a run
of their characters is long enough, which is the keyword of a copy of the text that spells classes of characters).
Kinds of tokens that carry a checksum count only if it holds.

Kinds, in the order in which spans of equal start are listed:

- ``assign``, ``access``, ``hex``: the base, given by form and length;
- ``github``, ``npm``: 30 characters and their CRC-32 in base 62;
- ``wallet``: extended private keys in base 58 with a double SHA-256;
- ``bech32``: secret keys of two kinds in Bech32.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import shared

# fixed values: alphabets and constants of the public token formats
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
MARK = "[secret]"


def base62_crc(token: str) -> bool:
    """The last 6 characters are the CRC-32 of the 30 before them, in base 62."""
    body, told = token[-36:-6], token[-6:]
    number, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        number, digit = divmod(number, 62)
        digits = BASE62[digit] + digits
    return digits == told


def base58_check(token: str) -> bool:
    """The last 4 of 82 bytes begin the double SHA-256 of the others."""
    number = 0
    for c in token:
        number = number * 58 + BASE58.index(c)
    if number >> (82 * 8):
        return False
    raw = number.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_check(token: str) -> bool:
    """The remainder of the Bech32 polynomial over prefix and data is 1."""
    prefix, data = token.lower().rsplit("1", 1)
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    left = 1
    for value in values:
        top = left >> 25
        left = (left & 0x1FFFFFF) << 5 ^ value
        for i, step in enumerate(BECH32_STEPS):
            left ^= step if top >> i & 1 else 0
    return left == 1


@dataclass(frozen=True)
class Kind:
    """Tokens that begin with one of ``keywords`` (lower case; without any: with ``run`` characters of ``classes``) and fit ``pattern`` there."""

    name: str
    pattern: str
    keywords: tuple[str, ...] = ()
    holds: Callable[[re.Match], bool] = lambda found: True
    classes: str = ""
    run: int = 0


# fixed values of the contract: the first three
KINDS = (
    Kind("assign", r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("password", "passwd", "secret", "token", "apikey", "api_key"), lambda found: len(found[1]) >= 6),
    Kind("access", r"AKIA[A-Z0-9]+", ("akia",), lambda found: len(found[0]) >= 20),
    Kind("hex", r"[0-9a-f]+", classes="0123456789abcdef", run=24),
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), lambda found: base62_crc(found[0])),
    Kind("npm", r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", ("npm_",), lambda found: base62_crc(found[0])),
    Kind("wallet", r"[tx]prv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])", ("xprv", "tprv"), lambda found: base58_check(found[0])),
    Kind("bech32", r"(?:AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}|nsec1[02-9ac-hj-np-z]{58})(?![A-Za-z0-9])", ("age-secret-key-1", "nsec1"),
         lambda found: bech32_check(found[0])),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """Finds the spans of one text after another."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = kinds
        self.patterns = [re.compile(kind.pattern) for kind in kinds]
        self.words = ahocorasick.Automaton()
        owners: dict[str, list[int]] = {}
        for i, kind in enumerate(kinds):
            for word in kind.keywords:
                owners.setdefault(word, []).append(i)
        for word, found in owners.items():
            self.words.add_word(word, (len(word), found))
        if owners:
            self.words.make_automaton()
        else:
            self.words = None
        self.lower = bytes(c + 32 if 65 <= c < 91 else c if c < 128 else 0 for c in range(256))
        self.runs = [(i, bytes(104 if chr(c) in kind.classes else 0 for c in range(256)), b"h" * kind.run)
                     for i, kind in enumerate(kinds) if kind.run]

    def starts(self, text: str):
        """(kind, code point) where a pattern has to be tried; ascending for each kind."""
        plain = text.encode("latin-1", "replace")  # one byte per code point; no keyword holds the replacement
        if self.words is not None:
            for last, (size, owners) in self.words.iter(plain.translate(self.lower).decode("latin-1")):
                for i in owners:
                    yield i, last + 1 - size
        for i, classes, run in self.runs:
            spelled = plain.translate(classes)
            at = spelled.find(run)
            while at >= 0:
                yield i, at
                end = spelled.find(0, at)
                at = spelled.find(run, end) if end >= 0 else -1

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind. Within a kind the leftmost match holds its text also if it fails the test."""
        found, done = [], [0] * len(self.kinds)
        for i, at in self.starts(text):
            if at < done[i]:
                continue
            match = self.patterns[i].match(text, at)
            if match:
                done[i] = match.end()
                if self.kinds[i].holds(match):
                    found.append((at, i, match.end()))
        return [(self.kinds[i].name, start, end) for start, i, end in sorted(found)]


def masked(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def scan(docs: DataFrame, text: str = "text", out: str = "spans", kinds: tuple[Kind, ...] = KINDS, redacted: str | None = None,
         mark: str = MARK) -> DataFrame:
    """All rows and columns of ``docs`` with ``out``: the spans (kind, start, end in code points, end exclusive) of the whole text,
    by start, then kind; with ``redacted``, also a column of that name with the text in which they are replaced by ``mark``.

    Null and empty texts have no spans (a null text stays null when redacted). Very long texts are read whole, in time
    that grows with their length. Repeated rows stay, each with its spans. Within a kind the leftmost match is taken and
    the search goes on behind it, also if the match fails its length or checksum. An empty table gives an empty table.
    Input columns named like an output are replaced; all others, also null ones, are passed on.
    """
    if redacted is not None and redacted.lower() == out.lower():
        raise ValueError("two output columns of one name")
    new = [x for x in (out, redacted) if x is not None]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {x.lower() for x in new}]
    schema = T.StructType(kept + T.StructType.fromDDL(f"`{out}` {SPANS}" + (f", `{redacted}` string" if redacted else "")).fields)
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias(shared.free_name(docs.columns, "scanned")))

    def search(batches):
        scanner = Scanner(kinds)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [scanner.spans(t) if t else [] for t in texts]
            columns = batch.columns[:-1] + [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], _SPANS)]
            if redacted is not None:
                columns.append(pa.array([masked(t, f, mark) if f else t for t, f in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(search, schema)
