"""Quality rules: counts per text with fixed limits, then a hashed n-gram classifier.

The classifier is a logistic regression on hashed words, word pairs and byte 4-grams, trained on a bounded sample of
labelled rows and calibrated on a fold it has not seen. Its probability is held against a fixed threshold. Texts are
scored in Arrow batches; every feature is a gather from one table of weights, so a text of any length is scored whole.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import shared, training
from tracewell.llm.words import Texts, Words, buffers, byte_hashes, mix, runs, slices, words

SAMPLE_ROWS = 3000  # labelled documents to learn from, at most
SAMPLE_BYTES = 32 << 20  # and their bytes, at most, for the one task that fits the model
TEXT_BYTES = 4 << 20  # a labelled document with more is not learned from; it is scored like any other
BITS = 16  # buckets of each of the three families
FAMILIES = 3
SCALE = 20.0
THRESHOLD = 0.3  # probability of good quality below which a text goes
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True  # fixed values
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCORED = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, probability double"


def _sum_at(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[cuts])


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs again, and whether an earlier one is equal."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order[1:]] == keys[order[:-1]]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] |= equal
    again[order[:-1]] |= equal
    later[order[1:]] = equal
    return again, later


def lines(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines, and the first line of each text."""
    breaks = np.flatnonzero(texts.data == 10)
    first = np.concatenate([[0], np.cumsum(np.diff(np.searchsorted(breaks, texts.cuts)) + 1)])
    head, tail = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    head[first[:-1]] = True
    tail[first[1:] - 1] = True
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    starts[head], starts[~head] = texts.cuts[:-1], breaks + 1
    ends[tail], ends[~tail] = texts.cuts[1:], breaks
    return starts, ends, first


def counts(texts: Texts, found: Words) -> np.ndarray:
    """One row per text with COUNTS."""
    n = len(texts)
    n_words = np.diff(found.first)
    inside = np.zeros(len(texts.data) + 1, np.int8)
    inside[found.starts] += 1  # starts differ from one another, and so do ends
    inside[found.ends] -= 1
    in_word = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    chars = _sum_at(in_word & ((texts.data & 0xC0) != 0x80), texts.cuts)
    symbols = _sum_at(SYMBOL[texts.data], texts.cuts)
    starts, ends, first_line = lines(texts)
    owner = np.repeat(np.arange(n), np.diff(first_line))
    has_word = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    line_hash = byte_hashes(texts.data, starts[has_word], ends[has_word])
    own = owner[has_word]
    _, later = _repeats(mix(line_hash + mix(own.astype(np.uint64))))
    dup_lines = np.bincount(own[later], minlength=n)
    triple, begin, first_run = runs(found, 3)
    holder = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first_run))
    again, _ = _repeats(mix(triple + mix(holder)))
    cover = np.zeros(len(found.starts) + 1, np.int64)
    cover[begin[again]] += 1
    cover[begin[again] + 3] -= 1
    repeated = _sum_at(np.cumsum(cover[:-1]) > 0, found.first)
    return np.stack([n_words, chars, symbols, dup_lines, repeated], 1)


def families(texts: Texts, found: Words):
    """Per family: bucket of each feature and the first feature of each text."""
    mask = np.uint64((1 << BITS) - 1)
    yield (found.hashes & mask).astype(np.int64), found.first
    pair, _, first = runs(found, 2)
    yield (pair & mask).astype(np.int64) + (1 << BITS), first
    have = np.maximum(np.diff(texts.cuts) - 3, 0)
    first = np.concatenate([[0], np.cumsum(have)])
    at = np.repeat(texts.cuts[:-1] - first[:-1], have) + np.arange(first[-1])
    d = texts.data.astype(np.uint32)
    quad = (d[at] << 24 | d[at + 1] << 16 | d[at + 2] << 8 | d[at + 3]) if len(at) else np.zeros(0, np.uint32)
    yield ((quad * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64) + (2 << BITS), first


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, texts: Texts, found: Words) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for bucket, first in families(texts, found):
            size = np.maximum(np.diff(first), 1)
            total += SCALE * training.row_sums(self.weights[bucket], first) / size
        return total

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return training.sigmoid(self.slope * margins + self.shift)


def _sparse(batches):
    """Training rows: distinct buckets of each text with their values, at most FAMILIES << BITS of them."""
    for batch in batches:
        column = shared.text_column(batch, "text")
        for a, b, texts in slices(column):
            found = words(texts, lower=False)
            buckets, values = [[] for _ in range(b - a)], [[] for _ in range(b - a)]
            for bucket, first in families(texts, found):
                for i in range(b - a):
                    used, n = np.unique(bucket[first[i]:first[i + 1]], return_counts=True)
                    buckets[i].append(used.astype("<i4"))
                    values[i].append((SCALE * n / max(1, n.sum())).astype("<f4"))
            join = lambda parts: pa.array([np.concatenate(x).tobytes() for x in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], join(buckets), join(values)], ["doc_id", "label", "buckets", "values"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on four fifths of a bounded sample (``training.labelled``) and calibrates on the rest, in one task.

    Without labelled rows every text gets one half; if all labelled texts are longer than TEXT_BYTES, that is an error.
    """
    sample = training.labelled(docs, labels, sample_rows, TEXT_BYTES, SAMPLE_BYTES)
    rows = sample.select("doc_id", "text", "label").mapInArrow(_sparse, "doc_id bigint, label int, buckets binary, values binary")
    found = training.in_one_task(rows, _fit)
    return Model(found["weights"], *found["rest"].tolist())


def _fit(rows: pa.Table) -> dict[str, np.ndarray]:
    rows = rows.sort_by("doc_id")
    fold = np.array([x % 5 for x in rows.column("doc_id").to_pylist()], int)
    label = np.array(rows.column("label").to_pylist(), float)
    index, first = _flat(rows.column("buckets"), "<i4")
    value, _ = _flat(rows.column("values"), "<f4")
    del rows
    weights, bias = training.fit_logistic(index, value, first, label, FAMILIES << BITS, (fold != 4).astype(float))
    held = fold == 4
    margin = training.row_sums(weights[index] * value, first) + bias
    return {"weights": weights.astype(np.float32), "rest": np.array([bias, *training.fit_platt(margin[held], label[held])])}


def _flat(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows in one array (a view where possible), and where each row begins."""
    column = column.combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    found = buffers(column)
    return found.data.view(kind) if len(found.data) else np.zeros(0, kind), found.cuts // 4


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, COUNTS, base_failed, probability and kept for every row of ``docs``.

    A null text has no words and fails the base rules. Very long texts are counted whole. Repeated rows are judged alike,
    an empty table gives no rows. Columns other than doc_id and text are not read, so their names cannot clash.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: FAMILIES << BITS weights

    def run(batches):
        own = shipped.value
        for batch in batches:
            for a, b, texts in slices(shared.text_column(batch, "text")):
                found = words(texts, lower=False)
                table = counts(texts, found)
                chance = own.probability(own.margins(texts, found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], *(pa.array(np.ascontiguousarray(table[:, i])) for i in range(len(COUNTS))), pa.array(chance)],
                    ["doc_id", *COUNTS, "probability"])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCORED).withColumn(
        "base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) that pass the rules. Rows are judged in place, so equal ids need no care."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shipped.value
        for batch in batches:
            for a, b, texts in slices(shared.text_column(batch, "text")):
                found = words(texts, lower=False)
                table = counts(texts, found)
                good = own.probability(own.margins(texts, found)) >= threshold
                good &= (table[:, 0] >= MIN_WORDS) & (100 * table[:, 4] <= MAX_REPEAT_PERCENT * table[:, 0])
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
