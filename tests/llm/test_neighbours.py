import numpy as np
import pytest

from tracewell.llm import neighbours, queries, shared

SMOKE, TABLES = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


@pytest.fixture(autouse=True)
def settings(spark):
    shared.configure(spark)


def brute(rows, asked, k):
    """rows: (id, vector); {query id: [(id, score)]} with the exact order."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q, v in asked:
        sims = unit @ (np.array(v, float) / np.linalg.norm(v))
        order = [i for i in np.lexsort((ids, -np.round(sims, 12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(sims[i])) for i in order]
    return out


def recall(rows, want, k):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    assert set(got) == {q for q, found in want.items() if found}
    hit = total = 0
    for q, found in want.items():
        mine = sorted(got.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(found) + 1))
        assert [(-round(s, 12), i) for _, i, s in mine] == sorted((-round(s, 12), i) for _, i, s in mine)
        exact = dict(found)
        assert all(s == pytest.approx(exact[i], abs=1e-12) for _, i, s in mine if i in exact)
        hit += len({i for _, i, _ in mine} & set(exact))
        total += len(found)
    return hit / total


def test_query(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()]
    rows = queries.QUERIES["op1_nn_descent"](spark, TABLES).withColumnRenamed("vec_id", "id").collect()
    assert recall(rows, brute(table, [x for x in table if x[0] % 50 == 0], 5), 5) >= 0.95


def test_small_blocks(spark, monkeypatch):
    """With blocks, beams and buckets far smaller than the table the graph still finds the way, also for new vectors."""
    for name, value in (("BLOCK", 64), ("BUCKET", 100), ("BEAM", 64), ("EXPAND", 16), ("DEGREE", 16)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.5 * rng.normal(size=(1500, 16))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    new = [(10_000 + i, (centres[i] + 0.3 * rng.normal(size=16)).tolist()) for i in range(12)]
    make = lambda r: spark.createDataFrame(r, "vec_id bigint, embedding array<double>").repartition(4)
    index = neighbours.build(make(rows))
    assert recall(neighbours.search(index, make(rows[::50])).collect(), brute(rows, rows[::50], 5), 5) >= 0.9
    assert recall(neighbours.search(index, make(new)).collect(), brute(rows, new, 5), 5) >= 0.8


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [None, 1.0]), (10, []), (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (50, [1.0, 1.0]), (100, [0.0, 0.0])] + [(200 + i, [3.0, 4.0]) for i in range(60)]
    docs = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id bigint, embedding array<double>, node bigint")
    good = list({i: (i, v) for i, v in rows if i is not None and v and len(v) == 2 and None not in v and np.isfinite(v).all() and any(v)}.values())
    asked = [x for x in good if x[0] % 50 == 0 or x[0] < 5]
    found = neighbours.search(neighbours.build(docs), docs.where("vec_id % 50 = 0 or vec_id < 5")).collect()
    assert recall(found, brute(good, asked, 5), 5) == 1.0
    none = neighbours.build(docs.limit(0))
    assert neighbours.search(none, docs).count() == 0
    one = docs.where("vec_id = 0")
    assert neighbours.search(neighbours.build(one), one).count() == 0
