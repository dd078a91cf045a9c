"""Ranked lexical search with an index of geometric blocks.

A document's gain for a term is a saturating count; its score for an item is the sum of weight x gain over the item's
terms. A search of a bounded set of items goes

1. the gains of the items' terms are counted in all documents, and a share of the documents, drawn by hash, is scored in
   full: the k-th best score found there is an item's first threshold;
2. terms are ordered by the most they can add to an item's score; the first ones, which together stay below the threshold,
   need no posting list, as no document can reach it with them alone;
3. the index is made of shards of similar documents: documents are ordered by their heaviest terms over all partitions and
   cut into shards of bounded size. A shard holds its documents' gains and, for every other term, its part of the posting
   list, cut into blocks: documents of a list that are near each other in a random projection of their weighted gains
   share a block. A block's summary is the largest gain over its documents of each term that an item which needs this
   list asks for;
4. every shard is asked for every item. Of the lists that could hold a document above the threshold (by now the item's k-th
   best score so far), a block is skipped only if the item's score of its summary, which no document in it can exceed, is
   below the threshold. All documents of the other blocks are scored exactly.

So results are exact; the first thresholds only bound the work, and what the tasks together send on. Terms are maximal runs
of ASCII letters and digits and of all characters above ASCII, A-Z lower-cased. The index holds the terms of the items it
is built for; more items than fit in one set take one index after another.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import shared
from tracewell.llm.words import LOWER, Texts, buffers, byte_hashes, mix, slices
from tracewell.operators import scan

TOP = 20
MOST_TERMS = 100_000  # terms of the items of one set, with repeats; a longer item is a set of its own
SHARD_DOCS = 4096
SHARD_ENTRIES = 400_000  # gains of a shard; a larger document is a shard of its own
BLOCK = 64  # documents
SUMMARY_DOCS = 4  # smaller blocks are scored at once
MOST_PAIRS = 20_000_000  # of lists and terms asked for with them; beyond, summaries hold all terms
DIMENSIONS = 24
SEED_SHARE = 8  # one document in so many sets the first thresholds
SEED = 12

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

FOUND = "item bigint, doc_id bigint, score bigint"
FORWARD = "doc_id bigint, n bigint, terms binary, counts binary"
GAINS = "doc_id bigint, terms binary, gains binary, first int, second int, seed int"
SHARDS = ("doc_ids array<bigint>, doc_first binary, terms binary, gains binary, list_terms binary, list_first binary, "
          "block_first binary, postings binary, summary_first binary, summary_terms binary, summary_gains binary")


def terms_of(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(ASCII_LOWER))


def term_bounds(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all terms in the bytes, and the first term of each text."""
    n = len(texts.data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = IS_TERM[texts.data]
    cut = np.zeros(n + 1, bool)
    cut[texts.cuts] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, texts.cuts)


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions first[i] .. first[i] + sizes[i] - 1, one range after another."""
    done = np.cumsum(sizes)
    return np.repeat(first - (done - sizes), sizes) + np.arange(done[-1] if len(done) else 0)


class Vocabulary:
    """Numbers of a bounded set of terms, found in bytes by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(terms)
        whole = buffers(pa.array(self.terms, pa.string()))
        hashes = byte_hashes(whole.data, whole.cuts[:-1], whole.cuts[1:])
        order = np.argsort(hashes)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two terms of one hash")
        self.hashes, self.number, self.data, self.cuts = hashes[order], order, whole.data, whole.cuts

    def __len__(self) -> int:
        return len(self.terms)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the terms that are in the vocabulary, and their numbers."""
        if not len(self) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = byte_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        number = self.number[at[hit]]
        sizes = ends[hit] - starts[hit]
        same = sizes == self.cuts[number + 1] - self.cuts[number]
        hit, number, sizes = hit[same], number[same], sizes[same]
        differ = data[ranges(starts[hit], sizes)] != self.data[ranges(self.cuts[number], sizes)]
        if differ.any():
            same = np.add.reduceat(differ, np.cumsum(sizes) - sizes) == 0
            hit, number = hit[same], number[same]
        return hit, number


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _array(column: pa.Array, i: int, kind) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


def forward(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, number of terms, and the counts of the vocabulary's terms, of every document with at least one term."""

    def count(batches):
        for batch in batches:
            names, texts = batch.column(0), shared.text_column(batch, "text")
            for a, b, part in slices(texts):
                starts, ends, first = term_bounds(part)
                data = LOWER[part.data]
                hit, number = vocabulary.find(data, starts, ends)
                owner = np.searchsorted(first, hit, "right") - 1
                keys, counts = np.unique(owner * max(1, len(vocabulary)) + number, return_counts=True)
                bounds = np.searchsorted(keys, np.arange(b - a + 1) * max(1, len(vocabulary)))
                terms, counts = (keys % max(1, len(vocabulary))).astype("<i4"), counts.astype("<i4")
                n = np.diff(first)
                rows = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, b - a).take(pa.array(rows)), pa.array(n[rows].astype(np.int64)),
                     _binary([terms[bounds[i]:bounds[i + 1]] for i in rows]), _binary([counts[bounds[i]:bounds[i + 1]] for i in rows])],
                    ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, FORWARD)


def _statistics(table: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms, and the documents that hold each term of the vocabulary; one row per task and term before they are added up."""

    def count(batches):
        held, docs, total = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            docs += batch.num_rows
            total += int(batch.column(0).to_numpy().sum())
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4")
            held += np.bincount(flat, minlength=size)
        known = np.flatnonzero(held)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], known])), pa.array(np.concatenate([[docs, total], held[known]]))], ["term", "n"])

    rows = table.select("n", "terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()  # one per term of the vocabulary
    found = {r["term"]: r["n"] for r in rows}
    holders = np.zeros(size, np.int64)
    for term, n in found.items():
        if term >= 0:
            holders[term] = n
    return found.get(-2, 0), found.get(-1, 0), holders


def gains_of(counts: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 12 * m) with m = 75 + (25 * n * docs) div total."""
    m = 75 + 25 * n * docs // total
    return 1_000_000_000 * counts // (1000 * counts + 12 * m)


def _with_gains(table: DataFrame, weights: np.ndarray, docs: int, total: int) -> DataFrame:
    """Documents with a term of the vocabulary: their gains and the two terms that could add most to a score."""

    def turn(batches):
        for batch in batches:
            sizes = np.array([len(x) // 4 for x in batch.column(2).to_pylist()], np.int64)
            rows = np.flatnonzero(sizes)
            if not len(rows):
                continue
            terms = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4")
            counts = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4").astype(np.int64)
            sizes = sizes[rows]
            owner = np.repeat(np.arange(len(rows)), sizes)
            gains = gains_of(counts, batch.column(1).to_numpy()[rows][owner], docs, total)
            end = np.cumsum(sizes)
            order = np.lexsort((terms, -weights[terms] * gains, owner))
            best = terms[order[end - sizes]]
            second = terms[order[np.minimum(end - sizes + 1, end - 1)]]
            drawn = mix(row_sums_of(gains * (terms + 1), end)) % np.uint64(SEED_SHARE) == 0
            gains = gains.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), _binary(np.split(gains, end[:-1])),
                 pa.array(best.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(drawn.astype(np.int32))],
                ["doc_id", "terms", "gains", "first", "second", "seed"])

    return table.mapInArrow(turn, GAINS)


def row_sums_of(values: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of consecutive values; the rows end at ``end``."""
    total = np.append(0, np.cumsum(values))
    return total[end] - total[np.append(0, end[:-1])] if len(end) else total[:0]


def _largest(gains: DataFrame, size: int) -> np.ndarray:
    """The largest gain of each term of the vocabulary over all documents."""

    def most(batches):
        held = np.zeros(size, np.int64)
        for batch in batches:
            np.maximum.at(held, np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4"))
        known = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(held[known])], ["term", "most"])

    out = np.zeros(size, np.int64)
    for row in gains.select("terms", "gains").mapInArrow(most, "term bigint, most bigint").groupBy("term").agg(F.max("most").alias("most")).collect():
        out[row["term"]] = row["most"]  # one row per term of the vocabulary
    return out


@dataclass
class Lists:
    """Terms that have posting lists, and the terms that summaries of each list hold (CSR; all if ``mates`` is None)."""

    listed: np.ndarray
    first: np.ndarray
    mates: np.ndarray | None


def _clusters(doc: np.ndarray, term: np.ndarray, near: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A cluster for each posting (sorted by term): in lists longer than a block, the nearest of as many of its documents as it needs blocks."""
    out = np.zeros(len(doc), np.int64)
    for at in np.flatnonzero(sizes > BLOCK):
        rows = doc[first[at]:first[at] + sizes[at]]
        centres = rows[np.linspace(0, len(rows) - 1, -(-len(rows) // BLOCK)).astype(np.int64)]
        out[first[at]:first[at] + sizes[at]] = (near[rows] @ near[centres].T).argmax(1)
    return out


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Positions where a run of equal values begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _summaries(postings: np.ndarray, list_terms: np.ndarray, list_first: np.ndarray, block_first: np.ndarray, doc_first: np.ndarray,
               terms: np.ndarray, gains: np.ndarray, lists: Lists):
    """Largest gain of each wanted term over the documents of each block of SUMMARY_DOCS and more: offsets per block, terms, gains."""
    sizes, width, size = np.diff(block_first), np.diff(doc_first), len(lists.first) - 1
    wanted = np.zeros(size, bool)
    found_terms, found_gains, counts = [], [], np.zeros(len(sizes), np.int64)
    for place, term in enumerate(list_terms):
        blocks = np.arange(list_first[place], list_first[place + 1])
        blocks = blocks[sizes[blocks] >= SUMMARY_DOCS]
        if not len(blocks):
            continue
        mates = lists.mates[lists.first[term]:lists.first[term + 1]] if lists.mates is not None else slice(None)
        wanted[mates] = True
        docs = postings[ranges(block_first[blocks], sizes[blocks])]
        spots = ranges(doc_first[docs], width[docs])
        own = wanted[terms[spots]]
        block = np.repeat(np.repeat(np.arange(len(blocks)), sizes[blocks]), width[docs])[own]
        spots = spots[own]
        wanted[mates] = False
        key = block * size + terms[spots]
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = _heads(key)
        found_terms.append(key[head] % size)
        found_gains.append(np.maximum.reduceat(gains[spots][order], head))
        counts[blocks] = np.bincount(key[head] // size, minlength=len(blocks))
    empty = [np.zeros(0, np.int64)]
    return np.append(0, np.cumsum(counts)), np.concatenate(found_terms or empty), np.concatenate(found_gains or empty)


def _shard(doc_ids: pa.Array, sizes: np.ndarray, terms: np.ndarray, gains: np.ndarray, weights: np.ndarray, lists: Lists, directions: np.ndarray) -> dict:
    """The arrays of one shard, by column name."""
    doc_first = np.append(0, np.cumsum(sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    heavy = (weights[terms] * gains).astype(np.float32)
    near = np.zeros((len(sizes), DIMENSIONS), np.float32)
    for d in range(DIMENSIONS):
        near[:, d] = np.bincount(owner, heavy * directions[terms, d], len(sizes))
    near /= np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-9)
    spots = np.flatnonzero(lists.listed[terms])
    order = spots[np.argsort(terms[spots], kind="stable")]
    doc, term = owner[order], terms[order]
    first = _heads(term)
    cluster = _clusters(doc, term, near, first, np.diff(np.append(first, len(term))))
    order = np.lexsort((doc, cluster, term))
    doc, term, cluster = doc[order], term[order], cluster[order]
    run = _heads(term, cluster)
    inside = np.arange(len(doc)) - np.repeat(run, np.diff(np.append(run, len(doc))))
    starts = np.flatnonzero(inside % BLOCK == 0)
    block_first = np.append(starts, len(doc))
    list_first = np.append(_heads(term[starts]), len(starts))
    list_terms = term[starts][list_first[:-1]]
    summary_first, summary_terms, summary_gains = _summaries(doc, list_terms, list_first, block_first, doc_first, terms, gains, lists)
    small = {"terms": terms, "gains": gains, "list_terms": list_terms, "postings": doc, "summary_terms": summary_terms, "summary_gains": summary_gains}
    large = {"doc_first": doc_first, "list_first": list_first, "block_first": block_first, "summary_first": summary_first}
    return {"doc_ids": doc_ids, **{k: v.astype("<i4").tobytes() for k, v in small.items()}, **{k: v.astype("<i8").tobytes() for k, v in large.items()}}


@dataclass
class Counted:
    """The gains of a vocabulary's terms in all documents that hold one, written to the shared folder; the terms' weights and largest gains."""

    gains: DataFrame
    vocabulary: Vocabulary
    weights: np.ndarray
    largest: np.ndarray


def count(docs: DataFrame, vocabulary: list[str]) -> Counted:
    """Counts the terms of ``vocabulary`` (distinct, lower-case) in all documents.

    Null and empty texts and texts without terms take no part; very long texts are counted whole. Repeated rows and ids,
    and null ids, are documents of their own. An empty table or vocabulary gives no rows. Only ``doc_id`` and ``text``
    are read, so other columns cannot clash.
    """
    known = Vocabulary(vocabulary)
    table = shared.stage(forward(docs, known), "lexical-forward")
    documents, total, holders = _statistics(table, len(known))
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * holders + 1))).astype(np.int64)
    gains = shared.stage(_with_gains(table, weights, documents, max(1, total)), "lexical-gains")
    return Counted(gains, known, weights, _largest(gains, len(known)))


def build(counted: Counted, lists: Lists) -> DataFrame:
    """The index, one row per shard, written to the shared folder: all documents that hold a listed term, with the posting lists.
    No listed terms give no shards."""
    weights, listed = counted.weights, lists.listed
    order = ["first", "second", "doc_id"]
    spread = counted.gains.select("doc_id", "terms", "gains", "first", "second").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        directions = np.random.default_rng(SEED).normal(size=(len(weights), DIMENSIONS)).astype(np.float32)
        names = [x.split()[0] for x in SHARDS.split(", ")]
        ids: list[pa.Array] = []
        held_terms: list[np.ndarray] = []
        held_gains: list[np.ndarray] = []
        held_sizes: list[np.ndarray] = []

        def emit():
            found = _shard(pa.concat_arrays(ids), np.concatenate(held_sizes), np.concatenate(held_terms), np.concatenate(held_gains), weights, lists, directions)
            for held in (ids, held_terms, held_gains, held_sizes):
                held.clear()
            columns = {"doc_ids": pa.array([found.pop("doc_ids").to_pylist()], pa.list_(pa.int64())), **{k: pa.array([v], pa.binary()) for k, v in found.items()}}
            return pa.RecordBatch.from_arrays([columns[x] for x in names], names)

        docs = entries = 0
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(x) // 4 for x in raw], np.int64)
            terms = np.frombuffer(b"".join(raw), "<i4").astype(np.int64)
            gains = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").astype(np.int64)
            end = np.cumsum(sizes)
            rows = np.flatnonzero(row_sums_of(listed[terms].astype(np.int64), end))
            begin = 0
            for place, size in enumerate(sizes[rows].tolist()):
                if docs and (docs >= SHARD_DOCS or entries + size > SHARD_ENTRIES):
                    take(batch, rows[begin:place], sizes, end, terms, gains, ids, held_terms, held_gains, held_sizes)
                    yield emit()
                    begin, docs, entries = place, 0, 0
                docs, entries = docs + 1, entries + size
            take(batch, rows[begin:], sizes, end, terms, gains, ids, held_terms, held_gains, held_sizes)
        if docs:
            yield emit()

    return shared.stage(spread.mapInArrow(cut, SHARDS), "lexical-index")


def take(batch: pa.RecordBatch, rows: np.ndarray, sizes, end, terms, gains, ids: list, held_terms: list, held_gains: list, held_sizes: list) -> None:
    """Adds rows of a batch to the shard that is being filled."""
    if len(rows):
        spots = ranges(end[rows] - sizes[rows], sizes[rows])
        ids.append(batch.column(0).take(pa.array(rows)))
        held_terms.append(terms[spots])
        held_gains.append(gains[spots])
        held_sizes.append(sizes[rows])


@dataclass
class Items:
    """Numbers of some items, and for each the vocabulary's terms with weight x repeats, and whether the item needs the term's list (CSR)."""

    numbers: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    needed: np.ndarray


class Best:
    """The best documents found so far of each item."""

    def __init__(self, items: Items, k: int, thresholds: np.ndarray):
        self.numbers, self.k, self.least = items.numbers, k, np.maximum(thresholds, 1)
        self.scores = [np.zeros(0, np.int64) for _ in items.numbers]
        self.ids = [np.zeros(0, np.int64) for _ in items.numbers]
        self.blank = [np.zeros(0, bool) for _ in items.numbers]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, blank: np.ndarray) -> None:
        good = scores >= self.least[i]
        if not good.any():
            return
        scores = np.concatenate([self.scores[i], scores[good]])
        ids, blank = np.concatenate([self.ids[i], ids[good]]), np.concatenate([self.blank[i], blank[good]])
        order = np.lexsort((ids, blank, -scores))[:self.k]
        self.scores[i], self.ids[i], self.blank[i] = scores[order], ids[order], blank[order]
        if len(order) == self.k:
            self.least[i] = max(self.least[i], scores[order[-1]])

    def rows(self) -> Iterator[pa.RecordBatch]:
        number = np.repeat(self.numbers, [len(s) for s in self.scores])
        if len(number):
            ids = pa.array(np.concatenate(self.ids), mask=np.concatenate(self.blank))
            yield pa.RecordBatch.from_arrays([pa.array(number), ids, pa.array(np.concatenate(self.scores))], ["item", "doc_id", "score"])


def _search_shard(batch: pa.RecordBatch, row: int, items: Items, size: int, best: Best) -> None:
    """Adds the shard's documents that could be among an item's best."""
    at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    small = {n: _array(at[n], row, "<i4").astype(np.int64) for n in ("terms", "gains", "list_terms", "postings", "summary_terms", "summary_gains")}
    large = {n: _array(at[n], row, "<i8") for n in ("doc_first", "list_first", "block_first", "summary_first")}
    listed = at["doc_ids"].slice(row, 1).flatten()
    blank = listed.is_null().to_numpy(zero_copy_only=False)
    ids = listed.fill_null(0).to_numpy(zero_copy_only=False)
    where = np.full(size, -1, np.int64)
    where[small["list_terms"]] = np.arange(len(small["list_terms"]))
    largest = np.zeros(size, np.int64)
    np.maximum.at(largest, small["terms"], small["gains"])
    worth = np.zeros(size, np.int64)
    block_sizes, summary_sizes, widths = np.diff(large["block_first"]), np.diff(large["summary_first"]), np.diff(large["doc_first"])
    for i in range(len(items.numbers)):
        own = slice(items.first[i], items.first[i + 1])
        here = largest[items.terms[own]] > 0
        terms, value, needed = items.terms[own][here], items.weights[own][here], items.needed[own][here]
        most = value * largest[terms]
        if most.sum() < best.least[i]:
            continue
        order = np.argsort(np.where(needed, most, -1), kind="stable")  # terms whose list the item does not need first
        use = order[np.cumsum(most[order]) >= best.least[i]]  # documents with the other terms alone stay below
        lists = where[terms[use[needed[use]]]]
        blocks = ranges(large["list_first"][lists], large["list_first"][lists + 1] - large["list_first"][lists])
        worth[terms] = value
        sizes = summary_sizes[blocks]
        entry = ranges(large["summary_first"][blocks], sizes)
        total = np.append(0, np.cumsum(worth[small["summary_terms"][entry]] * small["summary_gains"][entry]))
        end = np.cumsum(sizes)
        bound = np.where(sizes > 0, total[end] - total[end - sizes], np.iinfo(np.int64).max)
        order = np.argsort(-bound, kind="stable")
        blocks, bound = blocks[order], bound[order]
        seen = np.zeros(len(ids), bool)
        begin, step = 0, 4
        while begin < len(blocks) and bound[begin] >= best.least[i]:
            turn = blocks[begin:begin + step][bound[begin:begin + step] >= best.least[i]]
            docs = small["postings"][ranges(large["block_first"][turn], block_sizes[turn])]
            docs = np.unique(docs[~seen[docs]])
            if len(docs):
                seen[docs] = True
                spots = ranges(large["doc_first"][docs], widths[docs])
                summed = np.append(0, np.cumsum(worth[small["terms"][spots]] * small["gains"][spots]))
                done = np.cumsum(widths[docs])
                best.add(i, summed[done] - summed[done - widths[docs]], ids[docs], blank[docs])
            begin, step = begin + step, step * 4
        worth[terms] = 0


def _asked(shards: DataFrame, items: Items, size: int, k: int, thresholds: np.ndarray) -> DataFrame:
    """item (its number), doc_id and score: of each task the ``k`` best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k, thresholds)
        for batch in batches:
            for row in range(batch.num_rows):
                _search_shard(batch, row, items, size, best)
        yield from best.rows()

    return shards.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _numbered(counted: Counted, asked: dict[int, Counter]) -> Items:
    place = {term: i for i, term in enumerate(counted.vocabulary.terms)}
    numbers = sorted(asked)
    rows = [sorted((place[t], n) for t, n in asked[number].items() if t in place and counted.weights[place[t]] > 0) for number in numbers]
    flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2)
    first = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
    return Items(np.array(numbers, np.int64), first, flat[:, 0], flat[:, 1] * counted.weights[flat[:, 0]], np.ones(len(flat), bool))


def _scored(gains: DataFrame, items: Items, size: int, k: int) -> DataFrame:
    """item, doc_id and score of the ``k`` best documents of each task, every document scored."""

    def run(batches):
        best = Best(items, k, np.zeros(len(items.numbers), np.int64))
        worth = np.zeros(size, np.int64)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            end = np.cumsum([len(x) // 4 for x in raw])
            terms = np.frombuffer(b"".join(raw), "<i4")
            gains = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").astype(np.int64)
            blank = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for i in range(len(items.numbers)):
                own = slice(items.first[i], items.first[i + 1])
                worth[items.terms[own]] = items.weights[own]
                best.add(i, row_sums_of(worth[terms] * gains, end), ids, blank)
                worth[items.terms[own]] = 0
        yield from best.rows()

    return gains.select("doc_id", "terms", "gains").mapInArrow(run, FOUND)


def first_thresholds(counted: Counted, items: Items, k: int) -> np.ndarray:
    """Each item's ``k``-th best score in the drawn share of the documents; 0 if it has fewer."""
    out = np.zeros(len(items.numbers), np.int64)
    spot = {number: i for i, number in enumerate(items.numbers.tolist())}
    found = _ranked(_scored(counted.gains.where("seed = 1"), items, len(counted.vocabulary), k), k)
    for row in found.where(F.col("rank") == k).select("item", "score").collect():  # one row per item
        out[spot[row["item"]]] = row["score"]
    return out


def needed_lists(items: Items, largest: np.ndarray, thresholds: np.ndarray) -> Lists:
    """The lists without which an item's other terms could reach its threshold; marks them in ``items.needed``."""
    size = len(largest)
    pairs, count = [], 0
    for i in range(len(items.numbers)):
        own = slice(items.first[i], items.first[i + 1])
        terms, most = items.terms[own], items.weights[own] * largest[items.terms[own]]
        order = np.argsort(most, kind="stable")
        items.needed[own][order] = np.cumsum(most[order]) >= max(thresholds[i], 1)
        lists = terms[items.needed[own]]
        count += len(lists) * len(terms)
        if count <= MOST_PAIRS:
            pairs.append((lists[:, None] * size + terms[None, :]).ravel())
    listed = np.zeros(size, bool)
    listed[items.terms[items.needed]] = True
    if count > MOST_PAIRS:
        return Lists(listed, np.zeros(size + 1, np.int64), None)
    keys = np.unique(np.concatenate(pairs or [np.zeros(0, np.int64)]))
    return Lists(listed, np.searchsorted(keys, np.arange(size + 1) * size), keys % max(1, size))


def query(counted: Counted, asked: dict[int, Counter], k: int = TOP) -> DataFrame:
    """item, rank, doc_id and score for the items (number: counts of their terms), exactly."""
    items = _numbered(counted, asked)
    thresholds = first_thresholds(counted, items, k)
    index = build(counted, needed_lists(items, counted.largest, thresholds))
    return _ranked(_asked(index, items, len(counted.vocabulary), k, thresholds), k)


def _sets(items: DataFrame) -> Iterator[dict[int, Counter]]:
    """The items in sets of at most MOST_TERMS terms (a longer item is a set of its own), each small enough for the driver."""
    sizes = items.select("item", F.size("terms").cast("bigint").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= MOST_TERMS:
        numbered, last = items.withColumn("set", F.lit(0)), 0
    else:
        until = scan.running_total(sizes, [F.col("item")], F.col("n"), "until")
        numbered = shared.stage(items.join(until.select("item", F.floor((F.col("until") - F.col("n")) / MOST_TERMS).cast("int").alias("set")), "item"), "lexical-sets")
        last = numbered.agg(F.max("set")).first()[0]
    for i in range(last + 1):
        found = {r["item"]: Counter(r["terms"]) for r in numbered.where(F.col("set") == i).select("item", "terms").collect()}
        if found:
            yield found


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents above 0 for every row of ``items``.

    Equal scores by ascending doc_id, null ids last. Null and empty item texts, and texts without known terms, give no rows;
    repeated items are answered each; repeated documents are ranked each. Very long texts of both tables are read whole.
    Empty tables give no rows. Only the named columns and ``doc_id`` and ``text`` of ``docs`` are read.
    """
    spark = docs.sparkSession
    named = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))

    def split(batches):
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            terms = [terms_of(t) for t in batch.column(1).to_pylist()]
            numbers = np.arange(made, made + len(terms)) + (part << 33)
            made += len(terms)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column(0), pa.array(terms, pa.list_(pa.string()))], ["item", "item_id", "terms"])

    kind = named.schema["item_id"].dataType.simpleString()
    listed = shared.stage(named.mapInArrow(split, f"item bigint, item_id {kind}, terms array<string>").where(F.size("terms") > 0), "lexical-items")
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for asked in _sets(listed):
        counted = count(docs, sorted(set().union(*asked.values())))
        found = shared.stage(query(counted, asked, k), "lexical-found")
        out = out.unionByName(found.join(listed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
    return out
