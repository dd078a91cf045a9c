"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's score comes from its own features, those of the lines before and after it, and hashed byte 3-grams; a 2 x 2
table scores neighbouring labels. Lines inherit their document's label for training. Forward and backward passes give
each line its probability of being good; their mean, weighted by length, is the document's quality, calibrated on a
fold that was not fitted.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import shared, training
from tracewell.llm.quality import lines
from tracewell.llm.words import Texts, buffers, byte_hashes, mix, slices, words

SAMPLE_ROWS = 3000  # labelled documents to learn from, at most
SAMPLE_BYTES = 16 << 20  # and their bytes, at most, for the one task that fits the model
TEXT_BYTES = 1 << 20  # a labelled document with more is not learned from; it is scored like any other
THRESHOLD = 0.3
GRAMS = 1 << 13
STEPS = 60
GRAM_RATE = 10.0  # steps of the 3-gram weights, whose features are small

_CLASSES = [np.zeros(256, np.float32) for _ in range(7)]
_CLASSES[0][65:91] = 1  # upper case
_CLASSES[1][97:123] = 1  # lower case
_CLASSES[2][48:58] = 1  # digits
_CLASSES[3][[ord(c) for c in "#*$%&|<>"]] = 1  # symbols
_CLASSES[4][[ord(c) for c in "!?"]] = 1
_CLASSES[5][[ord(c) for c in ".,;:'\"()-"]] = 1
_CLASSES[6][0x80:] = 1  # beyond ASCII
DENSE = len(_CLASSES) + 7
UNARY = 3 * DENSE + 1


def dense(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with those of its neighbours, the lines' bounds, first line of each text, and lengths."""
    starts, ends, first = lines(texts)
    size = ends - starts
    own = np.zeros((len(starts), DENSE), np.float32)
    for k, table in enumerate(_CLASSES):
        total = np.concatenate([[0], np.cumsum(table[texts.data], dtype=np.float64)])
        own[:, k] = (total[ends] - total[starts]) / np.maximum(size, 1)
    found = words(texts, lower=True)
    head, tail = np.searchsorted(found.starts, starts), np.searchsorted(found.starts, ends)
    n_words = tail - head
    echo = np.zeros(len(found.hashes) + 1, np.int64)  # words equal to the one before them
    np.cumsum(np.concatenate([[False], found.hashes[1:] == found.hashes[:-1]])[:len(found.hashes)], out=echo[1:])
    holder = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(first))
    keys = mix(byte_hashes(texts.data, starts, ends) + mix(holder))
    order = np.argsort(keys, kind="stable")
    twin = np.zeros(len(keys), bool)
    same = keys[order[1:]] == keys[order[:-1]]
    twin[order[1:]] |= same
    twin[order[:-1]] |= same
    k = len(_CLASSES)
    own[:, k] = np.log1p(size) / 8
    own[:, k + 1] = np.log1p(n_words) / 6
    own[:, k + 2] = np.minimum(size / np.maximum(n_words, 1), 30) / 15
    own[:, k + 3] = twin & (size > 0)
    last = texts.data[np.maximum(ends - 1, 0)] if len(texts.data) else np.zeros(len(ends), np.uint8)
    own[:, k + 4] = np.isin(last, [ord("."), ord("!"), ord("?")]) & (size > 0)
    own[:, k + 5] = size == 0
    own[:, k + 6] = (echo[tail] - echo[np.minimum(head + 1, tail)]) / np.maximum(n_words, 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]], after[first[1:] - 1] = 0, 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), np.float32)], 1), starts, ends, first, size


def grams(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 3-grams of the lines and the first of each line."""
    have = np.maximum(ends - starts - 2, 0)
    first = np.concatenate([[0], np.cumsum(have)])
    at = np.repeat(starts - first[:-1], have) + np.arange(first[-1])
    d = texts.data.astype(np.uint32)
    triple = (d[at] << 16 | d[at + 1] << 8 | d[at + 2]) if len(at) else np.zeros(0, np.uint32)
    return ((triple * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int64), first


def passes(unary: np.ndarray, first: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line scores, forward and backward log messages (each line's greater one is zero) for labels 0 and 1.

    ``unary`` is the score of good against bad, ``pair[a, b]`` that of label b after a. All texts advance together,
    one line a step; a step works on the texts that are long enough.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, length = first[:-1][order], size[order]
    longest = int(length[0]) if len(length) else 0
    score = np.stack([np.zeros(len(unary)), unary], 1)
    ahead, back = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    active = np.searchsorted(-length, -np.arange(longest), side="left")  # texts with more than t lines
    table = np.exp(pair)
    for t in range(longest):
        rows = begin[:active[t]] + t
        value = score[rows] + (np.log(np.exp(ahead[rows - 1]) @ table) if t else 0.0)
        ahead[rows] = value - value.max(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        rows = begin[:active[t + 1]] + t
        value = score[rows + 1] + back[rows + 1]
        value = np.log(np.exp(value - value.max(1, keepdims=True)) @ table.T)
        back[rows] = value - value.max(1, keepdims=True)
    return score, ahead, back


def marginals(ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """P(good) of each line."""
    total = ahead + back
    return training.sigmoid(total[:, 1] - total[:, 0])


def pair_marginals(score: np.ndarray, ahead: np.ndarray, back: np.ndarray, pair: np.ndarray, at: np.ndarray) -> np.ndarray:
    """P(label a on the line before, label b here) for the lines ``at``: one 2 x 2 table each."""
    joint = ahead[at - 1][:, :, None] + pair[None] + (score[at] + back[at])[:, None, :]
    joint = np.exp(joint - joint.max((1, 2), keepdims=True))
    return joint / joint.sum((1, 2), keepdims=True)


@dataclass
class Model:
    unary: np.ndarray
    grams: np.ndarray
    pair: np.ndarray
    slope: float
    shift: float

    def lines(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, the first line of each text, and the lines' bytes."""
        features, starts, ends, first, size = dense(texts)
        bucket, gram_first = grams(texts, starts, ends)
        lexical = training.row_sums(self.grams[bucket], gram_first) / np.maximum(np.diff(gram_first), 1)
        _, ahead, back = passes(features @ self.unary + lexical, first, self.pair)
        return marginals(ahead, back), first, size

    def raw(self, texts: Texts) -> np.ndarray:
        good, first, size = self.lines(texts)
        weight = size + 1.0  # an empty text is one empty line
        return training.row_sums(good * weight, first) / training.row_sums(weight, first)

    def scores(self, texts: Texts) -> np.ndarray:
        return training.sigmoid(self.slope * training.logit(np.clip(self.raw(texts), 1e-4, 1 - 1e-4)) + self.shift)


def _counted(bucket: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of each line, with their counts, line by line."""
    lines_, buckets_, counts_ = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a in range(0, len(first) - 1, 4096):
        b = min(len(first) - 1, a + 4096)
        owner = np.repeat(np.arange(a, b), np.diff(first[a:b + 1]))
        key, n = np.unique(owner * GRAMS + bucket[first[a]:first[b]], return_counts=True)
        lines_.append((key // GRAMS).astype(np.int32))
        buckets_.append((key % GRAMS).astype(np.int32))
        counts_.append(n.astype(np.int32))
    return np.concatenate(lines_), np.concatenate(buckets_), np.concatenate(counts_)


def fit(texts: Texts, label: np.ndarray, steps: int = STEPS) -> Model:
    """Maximises the likelihood of the labels' paths, which give every line its document's label, by gradient steps."""
    features, starts, ends, first, _ = dense(texts)
    bucket, gram_first = grams(texts, starts, ends)
    size = np.maximum(np.diff(gram_first), 1)
    count = np.diff(first)
    want = np.repeat(label, count)
    # every text weighs the same, however many lines it has
    weight = np.repeat(1.0 / np.maximum(count, 1), count) / max(1, len(label))
    # one entry per line and 3-gram with its count, instead of one per byte
    line, bucket, count_of = _counted(bucket, gram_first)
    gram_first = np.searchsorted(line, np.arange(len(starts) + 1))
    value = (count_of / size[line]).astype(np.float32)
    model = Model(np.zeros(UNARY), np.zeros(GRAMS), np.zeros((2, 2)), 1.0, 0.0)
    moves = training.Adam(UNARY + GRAMS + 4, 0.15)
    inner = np.ones(len(starts), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    for _ in range(steps):
        unary = features @ model.unary + training.row_sums(model.grams[bucket] * value, gram_first)
        score, ahead, back = passes(unary, first, model.pair)
        error = (marginals(ahead, back) - want) * weight
        expected = (pair_marginals(score, ahead, back, model.pair, at) * weight[at][:, None, None]).sum(0)
        seen = np.bincount(want[at].astype(int), weight[at], 2)
        move = moves.step(np.concatenate([
            features.T.astype(float) @ error + 1e-5 * model.unary,
            np.bincount(bucket, error[line] * value, GRAMS) + 1e-7 * model.grams,
            (expected - np.diag(seen) + 1e-2 * model.pair).reshape(-1)]))
        model.unary -= move[:UNARY]
        model.grams -= GRAM_RATE * move[UNARY:UNARY + GRAMS]
        model.pair -= move[UNARY + GRAMS:].reshape(2, 2)
    return model


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on a bounded sample (``training.labelled``) of labelled rows for which ``allowed`` (on labels) holds, in one task; a
    fifth of it calibrates.

    Without labelled documents every text scores one half; if there are some and all are longer than TEXT_BYTES, that is an error.
    """
    sample = training.labelled(docs, labels, sample_rows, TEXT_BYTES, SAMPLE_BYTES, allowed)
    found = training.in_one_task(sample.select("doc_id", "text", "label"), _fit)
    return Model(found["unary"], found["grams"], found["pair"], *found["rest"].tolist())


def _fit(rows: pa.Table) -> dict[str, np.ndarray]:
    rows = rows.sort_by("doc_id")
    label = np.array(rows.column("label").to_pylist(), float)
    fold = np.array([x // 5 % 5 for x in rows.column("doc_id").to_pylist()], int)
    column = _one(rows.column("text").combine_chunks()).fill_null("")
    pick = lambda chosen: buffers(_one(column.take(pa.array(np.flatnonzero(chosen)))))
    model = fit(pick(fold != 4), label[fold != 4]) if (fold != 4).any() else Model(np.zeros(UNARY), np.zeros(GRAMS), np.zeros((2, 2)), 1.0, 0.0)
    if (fold == 4).any():
        raw = training.logit(np.clip(model.raw(pick(fold == 4)), 1e-4, 1 - 1e-4))
        model.slope, model.shift = training.fit_platt(raw, label[fold == 4])
    return {"unary": model.unary, "grams": model.grams, "pair": model.pair, "rest": np.array([model.slope, model.shift])}


def _one(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row. A null text is empty: one empty line. Very long texts are labelled whole, line by line.
    Repeated rows score alike, an empty table gives no rows; other columns are not read, so their names cannot clash."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        own = shipped.value
        for batch in batches:
            for a, b, texts in slices(shared.text_column(batch, "text")):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(own.scores(texts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """Every line of every text: doc_id, line (from 0), its bytes, probability of being good, and label."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shipped.value
        for batch in batches:
            for a, b, texts in slices(shared.text_column(batch, "text")):
                good, first, size = own.lines(texts)
                count = np.diff(first)
                owner = np.repeat(np.arange(a, b), count)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner)), pa.array(np.arange(len(owner)) - np.repeat(first[:-1], count)), pa.array(size), pa.array(good)],
                    ["doc_id", "line", "bytes", "good"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, line bigint, bytes bigint, good double").withColumn("label", (F.col("good") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) that score at least ``threshold``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shipped.value
        for batch in batches:
            for a, b, texts in slices(shared.text_column(batch, "text")):
                yield batch.slice(a, b - a).filter(pa.array(own.scores(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
