"""Removes passages that an earlier document holds: windows around seeds that two documents share.

The index of all documents holds seeds: 8-word grams that are the least by hash in some run of as many as fit into one
window, so every window of ``width`` words contains the seed it chose, and equal windows choose equal seeds. Windows stand
in for the factors of a relative Lempel-Ziv parse: no factor is parsed. It goes

1. texts equal word by word are one reference block; later ones are a single factor;
2. seeds known to two documents point at the windows around them (an inverted index, joined by seed);
3. each such window gets a fingerprint, and the least document that starts it is its source;
4. consecutive windows with one source are a span: start, words, source. Where the source changes, the next
   span starts at its own window, so spans overlap there and no window is lost at a boundary.

Words inside spans go. Windows are judged on the input alone, never on what other removals left.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import shared
from tracewell.llm.words import Words, mix, range_hashes, runs, slices, words

WIDTH = 50
SEED_WORDS = 8


def seeds(found: Words, width: int, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and the word where the seed it chose begins."""
    _, begin, _ = runs(found, width)
    if not len(begin):
        return begin, begin
    n = len(found.hashes)
    q = min(seed_words, width)
    at = np.arange(n - q + 1)
    grams = range_hashes(found.hashes, at, at + q)
    span = width - q + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(1)  # the leftmost of equals
    return begin, begin + least[begin]


def _rows(docs: DataFrame) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return base.withColumn("uid", F.xxhash64("doc_id", "text"))


def _signatures(rows: DataFrame, width: int, seed_words: int) -> DataFrame:
    """doc_id, uid, n_words, key (of the whole word sequence) and the seeds: hash, first window, windows that chose it."""
    def run(batches):
        for batch in batches:
            for a, b, texts in slices(shared.text_column(batch, "text")):
                found = words(texts, lower=False)
                begin, seed = seeds(found, width, seed_words)
                head = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])) if len(seed) else np.zeros(0, np.int64)
                size = np.diff(np.append(head, len(seed)))
                grams = range_hashes(found.hashes, seed[head], seed[head] + min(seed_words, width))
                cuts = np.searchsorted(begin[head], found.first)
                local = begin[head] - np.repeat(found.first[:-1], np.diff(cuts))
                key = range_hashes(found.hashes, found.first[:-1], found.first[1:])
                key = mix(key + np.diff(found.first).astype(np.uint64))
                offsets = pa.array(cuts.astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64))) for x in (grams, local, size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(2)[a:b], pa.array(np.diff(found.first)), pa.array(key.view(np.int64)), *lists],
                    ["doc_id", "uid", "n_words", "key", "seed", "start", "size"])

    return rows.mapInArrow(run, "doc_id bigint, uid bigint, n_words bigint, key bigint, seed array<bigint>, start array<bigint>, size array<bigint>")


def _fingerprints(marked: DataFrame, width: int) -> DataFrame:
    """(h, doc_id, uid, b) of the windows named by ``starts`` and ``sizes`` of each row."""
    def run(batches):
        for batch in batches:
            starts, sizes = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for a, b, texts in slices(shared.text_column(batch, "text")):
                found = words(texts, lower=False)
                owner, first = [], []
                for i in range(a, b):
                    at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[i], sizes[i])])
                    owner.append(np.full(len(at), i))
                    first.append(at + found.first[i - a])
                at, who = np.concatenate(first), np.concatenate(owner)
                for i in range(0, len(at), 100_000):
                    place, row = at[i:i + 100_000], who[i:i + 100_000]
                    rows = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range_hashes_at(found, place, width)), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(place - found.first[row - a])],
                        ["h", "doc_id", "uid", "b"])

    return marked.select("doc_id", "text", "uid", "starts", "sizes").mapInArrow(run, "h bigint, doc_id bigint, uid bigint, b bigint")


def range_hashes_at(found: Words, place: np.ndarray, width: int) -> np.ndarray:
    return range_hashes(found.hashes, place, place + width).view(np.int64)


def factors(docs: DataFrame, width: int = WIDTH, seed_words: int = SEED_WORDS) -> DataFrame:
    """uid, doc_id, start, words, source: runs of words whose windows all start in ``source``, a smaller doc_id.

    ``uid`` is the hash of (doc_id, text). Rows without a doc_id neither lose words nor are a source; rows of equal
    doc_id are no source for each other.
    """
    rows = _rows(docs.where("doc_id is not null"))
    signed = shared.stage(_signatures(rows, width, seed_words).where(F.col("n_words") >= width), "seeds")
    least = signed.groupBy("key").agg(F.min("doc_id").alias("source"))
    placed = signed.join(least, "key")
    copies = placed.where("doc_id > source").select("uid", "doc_id", F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("words"), "source")
    index = placed.where("doc_id = source").select("doc_id", "uid", F.explode(F.arrays_zip("seed", "start", "size")).alias("s")).select(
        "doc_id", "uid", F.col("s.seed").alias("seed"), F.col("s.start").alias("start"), F.col("s.size").alias("size"))
    index = shared.stage(index, "seed-index")
    known = index.groupBy("seed").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi")).where("_lo <> _hi").select("seed")
    known = shared.stage(known, "known-seeds")  # as a table of its own, the join may split a frequent seed
    spots = index.join(known, "seed", "left_semi").groupBy("uid").agg(
        F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spots")).select(  # of one document
        "uid", F.col("spots.start").alias("starts"), F.col("spots.size").alias("sizes"))
    spots = shared.stage(spots, "seed-spots")
    # texts are merged with what is known about them at every size, so the plan does not change with the input
    windows = shared.stage(_fingerprints(rows.join(spots.hint("merge"), "uid"), width), "windows")
    first = windows.groupBy("h").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("_hi")).where("source <> _hi").select("h", "source")
    first = shared.stage(first, "sources")
    later = windows.join(first, "h").where("doc_id > source").select("uid", "doc_id", "b", "source")
    in_text = Window.partitionBy("uid", "source").orderBy("b")  # windows of one document
    greedy = later.withColumn("_run", F.col("b") - F.dense_rank().over(in_text)).groupBy("uid", "doc_id", "source", "_run").agg(
        F.min("b").alias("start"), (F.max("b") - F.min("b") + width).alias("words")).select("uid", "doc_id", "start", "words", "source")
    return copies.distinct().unionByName(greedy)  # rows that come twice have equal factors


def remove(docs: DataFrame, width: int = WIDTH, seed_words: int = SEED_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_removed and kept: the words outside factors joined by one space.

    A null or wordless text keeps the empty text. Very long texts are cut whole. Repeated rows stay and lose the same words; an
    empty table gives an empty table. Columns named like the three results are replaced, all others are kept.
    """
    uid, begins, sizes_ = (shared.free_name(docs.columns, n) for n in ("_uid", "_starts", "_words"))
    spans = factors(docs, width, seed_words).groupBy("uid").agg(F.collect_list(F.struct("start", "words")).alias("_spans")).select(
        F.col("uid").alias(uid), F.col("_spans.start").alias(begins), F.col("_spans.words").alias(sizes_))
    spans = shared.stage(spans, "removals")
    base = docs.drop("n_words", "n_removed", "kept")
    keyed = base.withColumn(uid, F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text")))
    joined = keyed.join(spans.hint("merge"), uid, "left").drop(uid)
    names = base.columns
    at, s, w = names.index("text"), len(names), len(names) + 1

    def run(batches):
        for batch in batches:
            starts, sizes = batch.column(s), batch.column(w)
            column = batch.column(at).fill_null("") if batch.column(at).null_count else batch.column(at)
            for a, b, texts in slices(column):
                found = words(texts, lower=False)
                raw = texts.data.tobytes()
                kept, removed = [], []
                for i in range(a, b):
                    x, y = int(found.first[i - a]), int(found.first[i - a + 1])
                    keep = np.ones(y - x, bool)
                    if starts[i].is_valid:
                        for f, n in zip(starts[i].as_py(), sizes[i].as_py()):
                            keep[f:f + n] = False
                    chosen = np.flatnonzero(keep) + x
                    kept.append(b" ".join([raw[p:q] for p, q in zip(found.starts[chosen].tolist(), found.ends[chosen].tolist())]).decode("utf-8"))
                    removed.append(int((~keep).sum()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[a:b] for c in range(s)), pa.array(np.diff(found.first)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    [*names, "n_words", "n_removed", "kept"])

    from pyspark.sql.types import LongType, StringType, StructType
    schema = StructType(base.schema.fields[:]).add("n_words", LongType()).add("n_removed", LongType()).add("kept", StringType())
    return joined.select(*[f"`{c}`" for c in names], begins, sizes_).mapInArrow(run, schema)
