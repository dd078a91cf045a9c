"""Hashes of words: the same wherever a word lies, in bounded memory."""
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import words as W


def of(texts):
    return W.buffers(pa.array(texts, pa.string()))


def at_once(texts, lower):
    """All words hashed over the whole bytes."""
    starts, ends, first = W.word_bounds(texts)
    data = W.LOWER[texts.data] if lower else texts.data
    return starts, ends, first, W.range_hashes(W.BYTE_VALUE[data], starts, ends)


@pytest.mark.parametrize("lower", [False, True])
@pytest.mark.parametrize("size", [1, 7, 64])
def test_runs_give_the_same_hashes(monkeypatch, size, lower):
    given = [
        [], [""], ["", "", " \t\n"], ["one"], ["Aa bB  aa\u00e9\u00df \u4e2d\u6587", "", " lead", "trail ", "x" * 200 + " y " + "Z" * 63 + " " + "q" * 64],
        ["end", "start", "a" * 7, "b" * 8 + " c"] * 50]
    for texts in map(of, given):
        want = at_once(texts, lower)
        monkeypatch.setattr(W, "HASH_BYTES", size)
        found = W.words(texts, lower)
        monkeypatch.undo()
        for a, b in zip((found.starts, found.ends, found.first, found.hashes), want):
            assert a.tolist() == b.tolist()


@pytest.mark.parametrize("size", [1, 7, 64])
def test_ranges_that_touch_or_are_empty(monkeypatch, size):
    data = of(["".join(chr(97 + i * i % 23) for i in range(500))]).data
    cuts = np.array([0, 0, 3, 3, 3, 90, 91, 160, 160, 400, 499, 500, 500])
    want = W.range_hashes(W.BYTE_VALUE[data], cuts[:-1], cuts[1:])
    monkeypatch.setattr(W, "HASH_BYTES", size)
    assert W.byte_hashes(data, cuts[:-1], cuts[1:]).tolist() == want.tolist()
    assert W.byte_hashes(data[:0], cuts[:2], cuts[:2]).tolist() == want[[0, 0]].tolist()
    assert not len(W.byte_hashes(data, cuts[:0], cuts[:0]))


def test_memory_of_a_slice(monkeypatch):
    """The tables and temporary arrays of a slice of texts stay far below eight bytes a number for every byte."""
    monkeypatch.setattr(W, "_powers", {})
    texts = of([" ".join(f"word{i * 7919 % 5000}" for i in range(j, j + 300)) for j in range(800)])
    assert 1 << 20 < len(texts.data) <= W.SLICE_BYTES + (1 << 20)
    tracemalloc.start()
    W.words(texts, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(texts.data)


def test_one_long_word():
    texts = of(["a " + "Bc" * (W.HASH_BYTES + 3) + " a"])
    found = W.words(texts, True)
    assert np.diff(found.starts).tolist() == [2, 2 * (W.HASH_BYTES + 3) + 1]
    assert found.hashes[0] == found.hashes[2] != found.hashes[1]
    assert found.hashes.tolist() == at_once(texts, True)[3].tolist()
