"""Words of texts as arrays: boundaries and 64-bit hashes without a Python loop over words.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are single bytes in UTF-8, so boundaries are found on bytes.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tracewell.llm.shared import spans

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 18  # bytes hashed at once: each takes several 64-bit numbers on the way
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, HASH_BYTES + 1024)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
        if n > 4 * SLICE_BYTES:  # a single huge text: do not keep its tables
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


@dataclass
class Texts:
    """Concatenated UTF-8 bytes of some texts; text i is data[cuts[i]:cuts[i + 1]]."""

    data: np.ndarray
    cuts: np.ndarray

    def __len__(self) -> int:
        return len(self.cuts) - 1


@dataclass
class Words:
    """Words [starts, ends) in the bytes; those of text i are first[i]:first[i + 1]; hashes has one number each."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def buffers(column: pa.Array) -> Texts:
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    cuts = np.frombuffer(raw[1], np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return Texts(data[cuts[0]:cuts[-1]], cuts - cuts[0])


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first row, end row, Texts) of runs of rows with bounded bytes; a longer text stands alone, whole."""
    whole = buffers(column)
    for a, b in spans(np.diff(whole.cuts).tolist(), most):
        yield a, b, Texts(whole.data[whole.cuts[a]:whole.cuts[b]], whole.cuts[a:b + 1] - whole.cuts[a])


def word_bounds(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(texts.data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~IS_SPACE[texts.data]
    cut = np.zeros(n + 1, bool)
    cut[texts.cuts] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, texts.cuts)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range [start, end) of 64-bit values; equal ranges have equal hashes wherever they lie."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """``range_hashes`` of ranges of bytes that follow one another and do not overlap.

    A hash does not depend on where its range lies, so they are made for runs of some bytes; a longer range stands alone.
    """
    hashes = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, begin + HASH_BYTES, "right")))
        part = data[begin:ends[end - 1]]
        hashes[at:end] = range_hashes(BYTE_VALUE[LOWER[part] if lower else part], starts[at:end] - begin, ends[at:end] - begin)
        at = end
    return hashes


def words(texts: Texts, lower: bool) -> Words:
    starts, ends, first = word_bounds(texts)
    return Words(starts, ends, first, byte_hashes(texts.data, starts, ends, lower))


def runs(found: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of one text: their hashes, first words, and first run of each text.

    A text of fewer words has none.
    """
    counts = np.diff(found.first)
    have = np.maximum(counts - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(have)])
    begin = np.repeat(found.first[:-1] - first[:-1], have) + np.arange(first[-1])
    return range_hashes(found.hashes, begin, begin + width), begin, first
