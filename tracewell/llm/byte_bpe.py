"""Byte-level BPE encoding and decoding by a file of ranks.

Texts are cut into pre-tokens without a regular expression. Every code point becomes one of sixteen symbols (class,
what follows, first of its text). A symbol is a function on eight states; functions compose associatively, so blocks
of the text are composed side by side, a scan over the blocks gives each its entry state, and a second pass marks the
token starts. The slices between them are merged pair by pair, all new slices of a batch together, and cached.
"""
from __future__ import annotations

import base64
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import shared
from tracewell.llm.words import Texts, slices

BLOCK = 512
KEEP = 700_000
LONG = 48
HEAP = 256  # longer slices are merged one by one with a heap

# classes of code points, and the contractions: fixed values of the pre-token pattern
OTHER, LETTER, NUMBER, SPACE = range(4)
SHORT = "stmd"  # 's 't 'm 'd
PAIRS = ("re", "ve", "ll")  # 're 've 'll

# symbols: the classes, white space with more or nothing behind it, the last space or other white of a run, apostrophes
S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_JOIN, S_LAST, S_APOS1, S_APOS2 = range(8)
FIRST = 8  # added for the first code point of a text
# states: closed, inside letters / numbers / others / white space, after a joining space, letters left of a contraction
CLOSED, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, JOINED, LEFT1, LEFT2 = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and token start, both indexed by state * 16 + symbol."""
    into = {S_OTHER: IN_OTHER, S_LETTER: IN_LETTER, S_NUMBER: IN_NUMBER, S_WHITE: IN_WHITE, S_JOIN: JOINED, S_LAST: CLOSED,
            S_APOS1: LEFT1, S_APOS2: LEFT2}
    step, start = np.zeros(128, np.uint8), np.ones(128, bool)
    for state in range(8):
        for symbol, target in into.items():
            step[state * 16 + symbol] = target
            step[state * 16 + symbol + FIRST] = target
            goes_on = (
                (state == target and symbol in (S_OTHER, S_LETTER, S_NUMBER, S_WHITE))
                or (state == JOINED and symbol in (S_OTHER, S_LETTER, S_NUMBER)))
            if state in (IN_OTHER, JOINED) and symbol in (S_APOS1, S_APOS2):  # inside a run of others: no contraction
                step[state * 16 + symbol], goes_on = IN_OTHER, True
            if state in (LEFT1, LEFT2) and symbol == S_LETTER:
                step[state * 16 + symbol], goes_on = (CLOSED if state == LEFT1 else LEFT1), True
            start[state * 16 + symbol] = not goes_on
    return step, start


STEP, START = _automaton()
_made: dict[str, object] = {}


def classes() -> np.ndarray:
    """Class of every code point."""
    if "classes" not in _made:
        import tiktoken

        # asked of the library itself, so that both know the same version of Unicode: a pattern that matches one
        # class only, over a vocabulary of single bytes, leaves just the code points of that class
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, np.uint8)
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            only = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
            members = bytes(only.encode_ordinary(points)).decode("utf-8")
            table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
        _made["classes"] = table
    return _made["classes"]


def symbols(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Symbol of each code point; ``cuts`` are the texts' starts and the end."""
    n = len(points)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[cuts] = True
    white = kind == SPACE
    follows = np.zeros(n, bool)  # a non-space of the same text follows
    follows[:-1] = ~white[1:] & ~first[1:-1]
    out = kind.copy()  # OTHER, LETTER, NUMBER and S_WHITE have the numbers of the classes
    out[white & follows] = S_LAST
    out[white & follows & (points == 0x20)] = S_JOIN
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded = np.concatenate([points, [0, 0]])
        head = np.concatenate([first, [True, True]])
        one, two = padded[at + 1], padded[at + 2]
        inside1, inside2 = ~head[at + 1], ~head[at + 1] & ~head[at + 2]
        out[at[inside1 & np.isin(one, [ord(c) for c in SHORT])]] = S_APOS1
        for a, b in PAIRS:
            out[at[inside2 & (one == ord(a)) & (two == ord(b))]] = S_APOS2
    out[first[:-1]] += FIRST
    return out


def token_starts(symbol: np.ndarray) -> np.ndarray:
    """True where a pre-token begins, by composing the symbols' functions block by block."""
    n = len(symbol)
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = symbol
    columns = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))  # the function of each block
    for j in range(BLOCK):
        whole = STEP[(whole << 4) | columns[j][:, None]]
    reach = 1  # inclusive scan: compose with the blocks before, doubling the reach
    while reach < rows:
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].copy(), 1)
        reach *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = whole[:-1, CLOSED]
    marks = np.empty((BLOCK, rows), bool)
    for j in range(BLOCK):
        key = (state << 4) | columns[j]
        marks[j] = START[key]
        state = STEP[key]
    return marks.T.reshape(-1)[:n]


def pre_tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions of the pre-tokens' starts (and the end), and the first pre-token of each text."""
    if not len(texts.data):
        return np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    lead = (texts.data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = np.frombuffer(texts.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    cuts = np.searchsorted(at, texts.cuts)
    begins = at[np.flatnonzero(token_starts(symbols(points, cuts)))]
    return np.append(begins, len(texts.data)), np.searchsorted(begins, texts.cuts)


class Ranks:
    """Ranks of a vocabulary file, pair merging and its cache."""

    def __init__(self, path: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.single = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        self.token = {v: k for k, v in self.rank.items()}
        pairs = sorted(
            (self.rank[t[:i]] << 32 | self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t))
            if t[:i] in self.rank and t[i:] in self.rank)
        self.keys, self.ranks = (np.array(x, np.int64) for x in zip(*pairs))
        self.sizes = np.zeros(max(self.token) + 1, np.int64)
        for r, t in self.token.items():
            self.sizes[r] = len(t)
        self.cache: dict[bytes, bytes] = {}

    NONE = np.int64(1 << 60)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.NONE)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Merges many short slices together: each round joins the lowest, leftmost pair of every slice."""
        size = np.array([len(p) for p in pieces])
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        own = np.repeat(np.arange(len(pieces)), size)
        out: list[bytes] = [b""] * len(pieces)
        rank = np.full(len(ids), self.NONE)  # of the pair that begins here
        same = np.flatnonzero(own[1:] == own[:-1])
        rank[same] = self.pair_ranks(ids[same], ids[same + 1])
        while len(ids):
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            done = best == self.NONE
            if done.any():
                ends = np.append(begin[1:], len(ids))
                raw = ids.astype("<u4").tobytes()
                for p, a, b in zip(own[begin[done]].tolist(), begin[done].tolist(), ends[done].tolist()):
                    out[p] = raw[4 * a:4 * b]
                keep = np.repeat(~done, ends - begin)
                ids, own, rank = ids[keep], own[keep], rank[keep]
                if not len(ids):
                    break
                begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                best = best[~done]
            lengths = np.diff(np.append(begin, len(ids)))
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            at = hits[np.concatenate([[True], own[hits[1:]] != own[hits[:-1]]])]  # leftmost of each slice
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one id before each was dropped per slice
            ids, own, rank = ids[keep], own[keep], rank[keep]
            for where in (at, at[at > 0] - 1):
                within = np.zeros(len(where), bool)
                inner = where < len(ids) - 1
                within[inner] = own[where[inner]] == own[where[inner] + 1]
                rank[where[~within]] = self.NONE
                some = where[within]
                rank[some] = self.pair_ranks(ids[some], ids[some + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """One long slice: a heap of pairs by (rank, position) over a linked list."""
        n = len(piece)
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        joined = lambda i, j: self.rank.get(self.token[ids[i]] + self.token[ids[j]])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := joined(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            if not alive[i] or ids[i] != left or after[i] >= n or ids[after[i]] != right:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (x := joined(a, after[a])) is not None:
                    heapq.heappush(heap, (x, a, ids[a], ids[after[a]]))
        return np.array([x for x, live in zip(ids, alive) if live], "<u4").tobytes()

    def encode(self, texts: Texts) -> list[bytes]:
        """Ids of each text as 32-bit little-endian numbers."""
        if len(self.cache) > KEEP:
            self.cache.clear()
        begins, first = pre_tokens(texts)
        raw, at, cache = texts.data.tobytes(), begins.tolist(), self.cache
        pieces = [raw[a:b] for a, b in zip(at, at[1:])]
        missing = list(set(pieces) - cache.keys())
        short = [x for x in missing if len(x) <= HEAP]
        for i in range(0, len(short), 20_000):
            cache.update(zip(short[i:i + 20_000], self.merge_all(short[i:i + 20_000])))
        for x in missing:
            if len(x) > HEAP:
                cache[x] = self.merge_long(x)
        cut = first.tolist()
        out = [b"".join(map(cache.__getitem__, pieces[a:b])) for a, b in zip(cut, cut[1:])]
        for x in missing:
            if len(x) > LONG:
                del cache[x]
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in the decoded text."""
        sizes = self.sizes[ids]
        return np.cumsum(sizes) - sizes


def ranks(path: str) -> Ranks:
    if path not in _made:
        _made[path] = Ranks(path)
    return _made[path]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids (32-bit little-endian) and offsets (64-bit byte offsets of the tokens) of each text.

    A null or empty text has no ids. Very long texts are encoded whole. Repeated rows stay as they are, an empty table gives
    no rows; other columns are not read, so their names cannot clash.
    """
    def run(batches):
        table = ranks(vocabulary)
        for batch in batches:
            for a, b, texts in slices(shared.text_column(batch, "text")):
                ids = table.encode(texts)
                places = [table.offsets(np.frombuffer(x, "<u4")).astype("<i8").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(places, pa.binary())],
                    ["doc_id", "n_tokens", "ids", "offsets"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids binary, offsets binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids and ``decoded``, the bytes of all ids. Null ids decode to nothing, ids of any number are decoded whole,
    repeated rows stay, an empty table gives no rows; other columns are dropped, so their names cannot clash."""
    kept = encoded.select("doc_id", "n_tokens", "ids")

    def run(batches):
        token = ranks(vocabulary).token
        for batch in batches:
            decoded = [b"".join(map(token.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return kept.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def decode_range(ids: bytes, offsets: bytes, begin: int, end: int, vocabulary: str) -> bytes:
    """Bytes [begin, end) of a text from its ids, touching only the tokens that the offsets say overlap them."""
    table, at = ranks(vocabulary), np.frombuffer(offsets, "<i8")
    if not len(at) or end <= begin:
        return b""
    a, b = max(0, int(np.searchsorted(at, begin, "right")) - 1), int(np.searchsorted(at, end, "left"))
    some = b"".join(map(table.token.__getitem__, np.frombuffer(ids, "<u4")[a:b].tolist()))
    return some[begin - int(at[a]):end - int(at[a])]
