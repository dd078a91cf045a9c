"""Counts against plain loops; the classifiers against held-out labels."""
import re
import zlib

import pytest

from tests.llm.brute import words
from tracewell.llm import line_crf, quality, queries, shared, training

SMOKE = "/root/testdata/sf0.001"
TABLES = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def settings(spark):
    shared.configure(spark)


def counts(text):
    text = text or ""
    found = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts(spark, odd_docs):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SMOKE}/labels.parquet"))
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["a\na\n\n\na \nb b b b b\n a", "x y z x y z", "#*$%&|<> # é漢\n\n#", "\n", "a\nb\na\nb"])], "doc_id bigint, text string")
    for frame in (docs, odd_docs, extra):
        rows = quality.score(frame, model).collect()
        want = sorted((r.doc_id if r.doc_id is not None else -1, *counts(r.text)) for r in frame.collect())
        assert sorted((r.doc_id if r.doc_id is not None else -1, *(r[c] for c in quality.COUNTS)) for r in rows) == want
        for r in rows:
            failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
            assert r.base_failed == failed and not (failed and r.kept) and 0 <= r.probability <= 1
        kept = quality.keep_good(frame, model)
        assert kept.columns == frame.columns and kept.count() == sum(r.kept for r in rows)


def test_rules_follow_labels(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op5_quality_rules"](spark, TABLES).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    judged = [(label[i], r.kept) for i, r in rows.items() if i in label and not r.base_failed]
    good = [kept for quality_, kept in judged if quality_ == 1]
    bad = [kept for quality_, kept in judged if quality_ == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.5


def test_crf_held_out(spark):
    rows = queries.QUERIES["op8_line_crf"](spark, TABLES).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x == 1 for b, y in held if y == 0]
    assert sum(pairs) / len(pairs) > 0.9
    assert sum((s >= 0.3) == (y == 1) for s, y in held) / len(held) > 0.9


def test_crf_passes_match_enumeration():
    """Forward-backward marginals and pair tables equal sums over all label paths."""
    import itertools

    import numpy as np
    rng = np.random.default_rng(3)
    unary, pair, first = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 5, 9])
    score, ahead, back = line_crf.passes(unary, first, pair)
    good = line_crf.marginals(ahead, back)
    for a, b in zip(first, first[1:]):
        total, one, both = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for path in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(unary[a + i] for i, y in enumerate(path) if y) + sum(pair[x, y] for x, y in zip(path, path[1:])))
            total += w
            one += w * np.array(path)
            for i in range(1, b - a):
                both[i, path[i - 1], path[i]] += w
        assert np.allclose(good[a:b], one / total)
        if b - a > 1:
            at = np.arange(a + 1, b)
            assert np.allclose(line_crf.pair_marginals(score, ahead, back, pair, at), both[1:] / total)


def test_crf_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 1), (6, 0), (7, 2), (None, 1)], "doc_id bigint, quality int")
    model = line_crf.train(odd_docs, labels)
    assert line_crf.score(odd_docs, model).count() == odd_docs.count()
    assert line_crf.score(no_docs, model).count() == 0
    none = line_crf.train(odd_docs, labels.limit(0))
    assert {r.score for r in line_crf.score(odd_docs, none).collect()} == {0.5}
    lines = line_crf.line_labels(odd_docs, model)
    assert lines.count() == sum((r.text or "").count("\n") + 1 for r in odd_docs.collect())
    assert line_crf.keep_good(odd_docs, none).columns == odd_docs.columns
    bare = quality.train(odd_docs, labels.limit(0))
    assert {r.probability for r in quality.score(odd_docs, bare).collect()} == {0.5}


def test_crf_long_labelled_text(spark, monkeypatch):
    """A labelled text above the size, first in hash order, costs the sample that text and no other; short ones fill it."""
    from pyspark.sql import functions as F
    ids = [r.doc_id for r in spark.range(40).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id")).collect()]
    text = lambda i: f"A plain sentence number {i}.\nAnother one follows it." if i % 2 else f"$$ ## {i} || <<\n$$ $$ ##"
    rows = [(i, text(i)) for i in ids]
    rows[0] = (ids[0], "long " * (1 + line_crf.SAMPLE_BYTES // 5))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    score = {r.doc_id: r.score for r in line_crf.score(docs, line_crf.train(docs, labels)).collect()}
    assert len(score) == 40
    assert min(score[i] for i in ids[1:] if i % 2) > 0.6 > 0.4 > max(score[i] for i in ids[1:] if not i % 2)
    # a text that does not fit any more is passed over, and later ones are still used
    assert training._fill([{"doc_id": i, "label": 1, "_bytes": n} for i, n in enumerate((6, 5, 3, 2, 1))], 10) == [(0, 1), (2, 1), (4, 1)]
    with pytest.raises(ValueError):
        line_crf.train(docs.where(F.col("doc_id") == ids[0]), labels)
    monkeypatch.setattr(quality, "TEXT_BYTES", 1000)
    kept = {r.doc_id: r.probability for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(kept) == 40 and min(kept[i] for i in ids[1:] if i % 2) > max(kept[i] for i in ids[1:] if not i % 2)
    with pytest.raises(ValueError):
        quality.train(docs.where(F.col("doc_id") == ids[0]), labels)
