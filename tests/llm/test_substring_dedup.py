import hashlib
import random

import pytest

from tests.llm.brute import words
from tracewell.llm import queries, shared, substring_dedup

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def settings(spark):
    shared.configure(spark)


def brute(rows, width):
    """(doc_id, text) rows to [(doc_id, n_words, n_removed, kept)]."""
    first = {}
    for doc_id, text in rows:
        found = words(text)
        if doc_id is not None:
            for i in range(len(found) - width + 1):
                w = tuple(found[i:i + width])
                first[w] = min(doc_id, first.get(w, doc_id))
    out = []
    for doc_id, text in rows:
        found = words(text)
        gone = set()
        if doc_id is not None:
            for i in range(len(found) - width + 1):
                if first[tuple(found[i:i + width])] < doc_id:
                    gone |= set(range(i, i + width))
        out.append((doc_id, len(found), len(gone), " ".join(x for i, x in enumerate(found) if i not in gone)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows, 50)]
    got = [tuple(r) for r in queries.QUERIES["op10_substring_dedup"](spark, SMOKE).collect()]
    assert sorted(got) == sorted(want)
    assert any(g for _, _, g, _ in want)


@pytest.mark.parametrize("width, seed_words", [(50, 8), (10, 3), (5, 8), (1, 1)])
def test_planted(spark, width, seed_words):
    rnd = random.Random(width)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [text(width + k) for k in (0, 1, 20, 3 * width)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            parts += text(rnd.randint(0, 20)) + (rnd.choice(passages) if rnd.random() < 0.5 else passages[3][rnd.randint(0, 9):])
        rows.append((rnd.choice([i, i, i, None, 7]), rnd.choice([" ", "\n", "  "]).join(parts)))
    rows += [(500 + i, rows[3][1]) for i in range(5)] + [(1, None), (2, ""), (3, "x " * 300), (4, "x " * 200), (0, "x " * 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove(docs, width, seed_words).collect()]
    assert order(got) == order(brute(rows, width))


def test_odd(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = substring_dedup.remove(odd_docs)
    assert found.columns == [*odd_docs.columns, "n_words", "n_removed", "kept"]
    assert order((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()) == order(brute(rows, 50))
    assert substring_dedup.remove(no_docs).count() == 0


def test_clashing_columns_are_kept(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage, "x", [1], 7), (2, "q " + passage, "y", [2], 8)], "doc_id bigint, text string, _uid string, _starts array<int>, _words int")
    out = substring_dedup.remove(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    assert sorted((r.doc_id, r._uid, r._starts, r._words, r.n_removed, r.kept) for r in out.collect()) == [(1, "x", [1], 7, 0, passage), (2, "y", [2], 8, 60, "q")]
