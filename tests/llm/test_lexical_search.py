"""Ranked search against a loop over all documents, and against its SQL on the tables."""
import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.sql import same_as_sql
from tracewell.llm import lexical_search, shared


@pytest.fixture(autouse=True)
def settings(spark):
    shared.configure(spark)


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k):
    """docs, items: (id, text); all (item id, rank, doc id, score)."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in held if t]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for name, text in items:
        scored = []
        for i, tf, n in held:
            m = 75 + 25 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(name, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def key(rows):
    return sorted(tuple((x is None, x or 0) for x in r) for r in rows)


def make_docs(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    out = []
    for i in range(n):
        base = rng.choice(words, size=int(rng.integers(1, 60)), p=share / share.sum())
        out.append((i, " ".join(base)))
    out += [(n + i, out[7][1]) for i in range(150)]  # exact copies: ties
    out += [(2 * n + i, out[9][1] + f" w{i % 250}") for i in range(150)]  # near copies
    return out


@pytest.mark.parametrize("share,pairs", [(1, 10 ** 6), (8, 10 ** 6), (10 ** 9, 100)])
def test_small_blocks(spark, monkeypatch, share, pairs):
    """Many shards, blocks and item sets of one small table give the rows of the loop."""
    for name, value in (("SHARD_DOCS", 100), ("SHARD_ENTRIES", 1500), ("BLOCK", 8), ("SUMMARY_DOCS", 2), ("SEED_SHARE", share), ("MOST_PAIRS", pairs), ("MOST_TERMS", 60)):
        monkeypatch.setattr(lexical_search, name, value)
    docs = make_docs(700, 3)
    items = [(i, docs[50 * i][1]) for i in range(8)] + [(100, "w0 w0 w1 W2 w299"), (101, docs[7][1]), (101, "w5 nowhere")]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5),
                                  spark.createDataFrame(items, "item_id bigint, text string").repartition(2))
    assert key(map(tuple, found.collect())) == key(brute(docs, items, 20))


def test_summaries(spark):
    """Blocks are small, every listed posting is in one, and summaries are the largest gains over their documents."""
    docs = make_docs(3000, 5)
    counted = lexical_search.count(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), sorted(set(terms(docs[7][1]))))
    size = len(counted.weights)
    listed = np.arange(size) % 3 > 0
    mates = [[t for t in range(size) if (t + own) % 2 or t == own] for own in range(size)]
    lists = lexical_search.Lists(listed, np.cumsum([0, *map(len, mates)]), np.concatenate(mates))
    held = lexical_search.build(counted, lists).collect()
    names = {t for i, t in enumerate(counted.vocabulary.terms) if listed[i]}
    assert sum(len(r.doc_ids) for r in held) == sum(bool(set(terms(t)) & names) for _, t in docs)
    for r in held:
        doc_first, block_first = np.frombuffer(r.doc_first, "<i8"), np.frombuffer(r.block_first, "<i8")
        postings, own, gains = (np.frombuffer(x, "<i4") for x in (r.postings, r.terms, r.gains))
        first, names, most = np.frombuffer(r.summary_first, "<i8"), np.frombuffer(r.summary_terms, "<i4"), np.frombuffer(r.summary_gains, "<i4")
        r_first, r_terms = np.frombuffer(r.list_first, "<i8"), np.frombuffer(r.list_terms, "<i4")
        assert np.diff(block_first).max() <= lexical_search.BLOCK and len(postings) == listed[own].sum()
        for b in range(len(block_first) - 1):
            inside = postings[block_first[b]:block_first[b + 1]]
            own_term = r_terms[np.searchsorted(r_first, b, "right") - 1]
            want = {}
            for d in inside:
                for t, g in zip(own[doc_first[d]:doc_first[d + 1]], gains[doc_first[d]:doc_first[d + 1]]):
                    if t in mates[own_term]:
                        want[t] = max(want.get(t, 0), g)
            if len(inside) >= lexical_search.SUMMARY_DOCS:
                assert dict(zip(names[first[b]:first[b + 1]], most[first[b]:first[b + 1]])) == want
            else:
                assert first[b] == first[b + 1]


def test_odd(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "the word a b"), (None, "naïve 漢字かな"), (2, None), (3, ""), (4, "!!!"), (5, "zzz unknown"), (1, "the word a b"), (6, "z" * 3000), (7, "the " * 2000)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, rank int, score string")
    found = lexical_search.search(odd_docs, table, k=4)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(map(tuple, found.collect())) == key(brute(docs, items, 4))
    assert lexical_search.search(no_docs, table).count() == 0
    assert lexical_search.search(odd_docs, table.limit(0)).count() == 0


def test_collisions_are_compared():
    """Terms found by hash are compared byte by byte."""
    from tracewell.llm.words import buffers
    import pyarrow as pa
    known = lexical_search.Vocabulary(["b", "abc", "é"])
    text = buffers(pa.array(["abc abd b é"]))
    starts, ends, _ = lexical_search.term_bounds(text)
    hit, number = known.find(text.data, starts, ends)
    assert [(int(h), known.terms[n]) for h, n in zip(hit, number)] == [(0, "abc"), (2, "b"), (3, "é")]
    known.data = known.data.copy()
    known.data[0] ^= 1  # as if another term had the hash of the first
    assert len(known.find(text.data, starts, ends)[0]) == 2


def test_query(spark):
    assert same_as_sql(spark, "op12_lexical_search") > 0
    assert same_as_sql(spark, "op12_lexical_search", "/root/testdata/sf0.01") > 0
