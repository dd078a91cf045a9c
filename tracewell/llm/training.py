"""Bounded labelled samples and logistic regression on sparse rows, for the classifiers."""
from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, rows: int, text_bytes: int, sample_bytes: int, allowed: Column | None = None,
             label: str = "quality") -> DataFrame:
    """doc_id, text and label of a bounded sample of labelled documents, drawn in the order of a hash of their ids.

    At most ``rows`` documents of at most ``text_bytes`` each; each is used whole if it still fits into ``sample_bytes``,
    else the next is tried. Sizes are known before any text is gathered. Labels other than 0 and 1 and null ids are left out;
    of several labels for one id the smaller holds. No labelled documents give no rows; if there are some and all are too
    long, that is an error. The ids are bounded by ``rows``, so they are broadcast.
    """
    sizes = docs.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("_bytes"))
    found = drawn(labels, rows, allowed, sizes, F.col("_bytes") <= text_bytes, label).collect()
    if not found and drawn(labels, 1, allowed, sizes, label=label).count():
        raise ValueError(f"each labelled document has more than {text_bytes} bytes")
    chosen = docs.sparkSession.createDataFrame(_fill(found, sample_bytes), "doc_id bigint, label int")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _fill(found: list, most: int) -> list[tuple[int, int]]:
    """(doc_id, label) of the documents that fit into ``most`` bytes one after another; one that does not is passed over."""
    out = []
    for r in found:
        if r["_bytes"] <= most:
            most -= r["_bytes"]
            out.append((r["doc_id"], r["label"]))
    return out


def in_one_task(sample: DataFrame, fit: Callable[[pa.Table], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """What ``fit`` makes of all rows of a bounded sample, run in one task: the driver holds neither the rows nor the fit."""

    def run(batches):
        held = list(batches)
        if held:
            out = io.BytesIO()
            np.savez(out, **fit(pa.Table.from_batches(held)))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    if not found:
        return fit(sample.limit(0).toArrow())
    with np.load(io.BytesIO(found[0]["model"])) as arrays:
        return {k: arrays[k] for k in arrays.files}


def drawn(labels: DataFrame, rows: int, allowed: Column | None = None, sizes: DataFrame | None = None, fits: Column | None = None,
          label: str = "quality") -> DataFrame:
    """doc_id and label of at most ``rows`` labelled ids in the order of a hash; with ``sizes`` (doc_id and more columns)
    of those in it for which ``fits`` holds, with its columns."""
    kept = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if allowed is not None:
        kept = kept.where(allowed)
    kept = kept.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    if sizes is not None:
        kept = kept.join(sizes if fits is None else sizes.where(fits), "doc_id")
    return kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


class Adam:
    """Steps of gradient descent with running moments."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient ** 2
        return self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-9)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def fit_logistic(index: np.ndarray, value: np.ndarray, first: np.ndarray, label: np.ndarray, size: int, weight: np.ndarray,
                 steps: int = 80, rate: float = 0.3, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias for sparse rows (index, value) with row bounds ``first``; rows count by ``weight``. Deterministic."""
    weights, bias = np.zeros(size), 0.0
    if not weight.sum():
        return weights, bias
    used = np.flatnonzero(np.bincount(index, minlength=size))
    number = np.zeros(size, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    at, share = number[index], weight / weight.sum()
    row = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(first))
    inner, moves = np.zeros(len(used)), Adam(len(used) + 1, rate)
    for _ in range(steps):
        score = row_sums(inner[at] * value, first) + bias
        error = (sigmoid(score) - label) * share
        gradient = np.bincount(at, error[row] * value, len(used)) + ridge * inner
        move = moves.step(np.append(gradient, error.sum()))
        inner -= move[:-1]
        bias -= float(move[-1])
    weights[used] = inner
    return weights, bias


def fit_platt(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and shift of a logistic curve from scores to probabilities, by Newton steps on smoothed labels."""
    good = float(label.sum())
    bad = len(label) - good
    if not len(label):
        return 1.0, 0.0
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = sigmoid(a * score + b)
        w = p * (1 - p) + 1e-9
        ga, gb = (score * (p - target)).sum() + 1e-3 * (a - 1), (p - target).sum()
        haa, hab, hbb = (w * score * score).sum() + 1e-3, (w * score).sum(), w.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = max(0.0, a - scale * da), b - scale * db
    return a, b
