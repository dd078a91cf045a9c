"""Vector codes against a plain loop, and against their SQL on the tables."""
import numpy as np
import pytest

from tests.llm.sql import same_as_sql
from tracewell.llm import shared, vector_codes


@pytest.fixture(autouse=True)
def settings(spark):
    shared.configure(spark)


def brute(rows, parts, entries, rounds):
    """rows: (id, vector, label) that take part, in the order of the first codebooks."""
    x = np.floor(np.array([v for _, v, _ in rows], float) * 256).astype(np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return far.argmin(2), far.min(2)
    for _ in range(rounds):
        codes, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[codes[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    codes, far = assign()
    error = far.sum(1)
    label = {}
    for (_, _, name), e in zip(rows, error):
        label[name] = label.get(name, 0) + int(e)
    return sorted((str(i), bytes(c.astype(np.uint8)), int(e), label[name]) for (i, _, name), c, e in zip(rows, codes, error)), books


@pytest.mark.parametrize("spread", [0.01, 1.0, 40.0])
def test_nearest(spread):
    """Pruned assignment equals the full one, ties included, and computes fewer distances."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(64, 4)) * 256 * spread
    x = np.floor(centres[rng.integers(0, 64, 5000)] + rng.normal(size=(5000, 4)) * 20 * spread).astype(np.int64)
    entries = np.floor(centres).astype(np.int64)
    entries[10] = entries[3]
    x[:64] = entries
    fixed = vector_codes.pivots(entries[None])[0]
    code, best, tried = vector_codes.nearest(x, np.sqrt(vector_codes._apart(x, fixed).astype(float)), entries, fixed)
    far = vector_codes._apart(x, entries)
    assert (code == far.argmin(1)).all() and (best == far.min(1)).all()
    assert spread < 1 or tried < 0.25 * far.size


def test_odd(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=8).round(2).tolist(), [None, 1, 1, 2][i % 4]) for i in range(100)]
    good += [(7, good[8][1], 5), (7, good[8][1], 5), (None, good[1][1], 1), (200, [0.0] * 8, None), (201, [-0.001] * 8, 3), (202, [9000.0] * 8, 3)]
    bad = [(300, None, 1), (301, [], 1), (302, [nan] * 8, 1), (303, [1.0] * 7 + [inf], 1), (304, [1.0] * 7 + [None], 2), (305, [1.0] * 16, 2)]
    table = spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in good + bad], "vec_id bigint, embedding array<double>, label int, codes string, _name int").repartition(6)
    ordered = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want, books = brute(ordered, 4, 16, 3)
    for most in (0, 1000):
        monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", most)
        coded, found = vector_codes.compress(table, parts=4, entries=16, rounds=3)
        rows = vector_codes.with_label_error(coded.drop("label_error"), most).collect()
        assert (found == books).all()
        assert sorted((str(r.vec_id), bytes(r.codes), r.error, r.label_error) for r in rows) == want
    back = {bytes(r.codes): r.vector for r in vector_codes.decode(coded, books).collect()}
    code = next(iter(back))
    assert back[code] == [v / 256 for p in range(4) for v in books[p, code[p]].tolist()]
    none, empty = vector_codes.compress(table.limit(0))
    assert none.count() == 0 and empty.size == 0
    few, _ = vector_codes.compress(table.where("vec_id < 3"), parts=2)
    assert few.where("error != 0").count() == 0 and few.count() == 3
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(table, parts=3)
    with pytest.raises(Exception, match="64-bit"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 16)], "vec_id bigint, embedding array<double>"))[0].collect()


def test_query(spark):
    assert same_as_sql(spark, "op13_vector_codes") > 0
    assert same_as_sql(spark, "op13_vector_codes", "/root/testdata/sf0.01") > 0
