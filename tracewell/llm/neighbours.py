"""Approximate nearest neighbours by largest cosine: a graph built by NN-descent, queried by greedy search.

Equal vectors are one node; the graph is built over nodes. It starts from neighbours inside blocks of a few random
sort orders. Each round of NN-descent joins every node with the neighbours of its neighbours: forward and reverse
links meet at the node between them, where pairs closer than a node's worst link are kept. Reverse links of a hub are
drawn by hash, at most DEGREE per round.

A query starts at the links of its own node, or at its neighbours in the random orders, and expands the best unexpanded
nodes of a beam until none is left in it. Nodes lie in buckets of bounded size, one file each with the links and 8-bit
copies of the linked vectors, so one exchange per step asks the buckets and one brings answers back to the queries.
The beam's nodes are then scored on the original vectors in double precision.
"""
from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import shared

DEGREE = 32  # links of a node; as many reverse links at most
ORDERS = 6
BLOCK = 1024
PER_ORDER = 16
ROUNDS = 3
BUCKET = 1024  # nodes
BEAM = 320
EXPAND = 64  # nodes of a beam expanded per step
MOST_STEPS = 40
EMIT = 6  # candidates a node sends to each of its neighbours per round
SEED = 20

EDGES = "u bigint, w bigint, s float"
STATE = "q bigint, vector binary, nodes binary, sims binary, done binary, open int"


def valid(table: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array of double) and node of the rows that take part, each (id, vector) once.

    Null, empty or zero vectors, those with null or non-finite numbers, and rows without an id take no part; nor do
    vectors of another length than the most common one (the greatest of equals).
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(row_id).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0)).withColumn("node", F.xxhash64("v")).dropDuplicates(["id", "node"])


def _matrix(column) -> np.ndarray:
    """Rows of float64 numbers as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _small(unit: np.ndarray) -> np.ndarray:
    """8-bit copies with a scale each, as rows of bytes."""
    scale = np.abs(unit).max(1, keepdims=True) / 127 + 1e-12
    return np.concatenate([np.rint(unit / scale).astype(np.int8).view(np.uint8), scale.astype("<f4").view(np.uint8)], 1)


def _large(small: np.ndarray) -> np.ndarray:
    return small[:, :-4].view(np.int8).astype(np.float32) * np.ascontiguousarray(small[:, -4:]).view("<f4")


def _best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` best distinct others of each owner, owners together, best first."""
    order = np.lexsort((-sim, other, owner))
    o, t = owner[order], other[order]
    order = order[np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])])] if len(order) else order
    order = order[np.lexsort((other[order], -sim[order], owner[order]))]
    o = owner[order]
    head = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
    rank = np.arange(len(o)) - np.repeat(head, np.diff(np.append(head, len(o))))
    return order[rank < most]


def _edge_table(u, w, s) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "w": pa.array(w, pa.int64()), "s": pa.array(s, pa.float32())})


def _block_neighbours(nodes: DataFrame, count: int) -> DataFrame:
    """Best neighbours of each node inside blocks of a few random orders."""
    bits = max(0, int(np.ceil(np.log2(max(1, count / BLOCK)))))

    def keyed(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            unit = _unit(x)
            for order in range(ORDERS):
                planes = np.random.default_rng(SEED + order).normal(size=(unit.shape[1], bits + 1)).astype(np.float32)
                side = unit @ planes
                code = ((side[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(unit), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(unit), order)), pa.array(code), pa.array(side[:, bits]), pa.array([r.tobytes() for r in unit], pa.binary())],
                    ["node", "turn", "code", "side", "unit"])

    def compare(batches):
        held: list[pa.RecordBatch] = []

        def block(table: pa.Table):
            ids = table.column("node").to_numpy()
            unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float32).reshape(len(ids), -1)
            sims = unit @ unit.T
            np.fill_diagonal(sims, -9)
            k = min(PER_ORDER, len(ids) - 1)
            if k > 0:
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                yield from _edge_table(np.repeat(ids, k), ids[top].reshape(-1), np.take_along_axis(sims, top, 1).reshape(-1)).to_batches()

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= 2 * BLOCK:  # the rest of a partition stays with its last block
                table = pa.Table.from_batches(held)
                yield from block(table.slice(0, BLOCK))
                held, size = table.slice(BLOCK).to_batches(), size - BLOCK
        if size:
            yield from block(pa.Table.from_batches(held))

    keys = nodes.select("node", "v").mapInArrow(keyed, "node bigint, turn bigint, code bigint, side float, unit binary")
    order = ["turn", "code", "side", "node"]
    sorted_rows = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("node", "turn", "unit")

    def by_turn(batches):
        # a partition may hold the end of one order and the beginning of the next: blocks may then mix both, which is harmless
        yield from compare(batches)

    return sorted_rows.mapInArrow(by_turn, EDGES).where("u <> w")


def _best_links(edges: DataFrame, buckets: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        u, w, s = (table.column(c).to_numpy() for c in ("u", "w", "s"))
        at = _best(u, w, s, DEGREE)
        return _edge_table(u[at], w[at], s[at])

    return edges.groupBy(_bucket("u", buckets)).applyInArrow(run, EDGES)


def _bucket(column: str, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int").alias("bucket")


def _around(links: DataFrame, salt: int) -> DataFrame:
    """(v, w): links in both directions; of a node's reverse links at most DEGREE, drawn by hash."""
    drawn = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("w", F.lit(salt)), "w"))
    back = links.select(F.col("w").alias("v"), F.col("u").alias("w")).withColumn("_n", drawn).where(F.col("_n") <= DEGREE).drop("_n")
    return links.select(F.col("u").alias("v"), "w").union(back).distinct()


def _with_vectors(around: DataFrame, small: DataFrame) -> DataFrame:
    return around.join(small.withColumnRenamed("node", "w"), "w")


def _descend(links: DataFrame, small: DataFrame, buckets: int, turn: int) -> DataFrame:
    """One round: neighbours of each node are compared with one another."""
    worst = links.groupBy(F.col("u").alias("w")).agg(F.min("s").alias("worst"), F.count("*").alias("n"))
    ends = _with_vectors(_around(links, turn), small).join(worst, "w", "left").select(
        "v", "w", "small", F.when(F.col("n") >= DEGREE, F.col("worst")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by("v")
        v, w, worst_ = (table.column(c).to_numpy() for c in ("v", "w", "worst"))
        vectors = _large(np.frombuffer(b"".join(table.column("small").to_pylist()), np.uint8).reshape(len(v), -1))
        head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        us, ws, ss = [], [], []
        for a, b in zip(head, np.append(head[1:], len(v))):
            if b - a < 2:
                continue
            sims = vectors[a:b] @ vectors[a:b].T
            np.fill_diagonal(sims, -9)
            k = min(EMIT, b - a - 1)
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(sims, top, 1)
            at = best > worst_[a:b, None]
            us.append(np.broadcast_to(w[a:b, None], at.shape)[at])
            ws.append(w[a:b][top][at])
            ss.append(best[at])
        if not us:
            return _edge_table([], [], [])
        u, o, s = np.concatenate(us), np.concatenate(ws), np.concatenate(ss)
        at = _best(u, o, s, DEGREE)
        return _edge_table(u[at], o[at], s[at])

    found = ends.groupBy(_bucket("v", buckets)).applyInArrow(meet, EDGES)
    return _best_links(links.unionByName(found), buckets)


class Index:
    """The built graph: nodes with vectors, members of each node, and bucket files for the search."""

    def __init__(self, nodes: DataFrame, rows: DataFrame, links: DataFrame, folder: str, buckets: int):
        self.nodes, self.rows, self.links, self.folder, self.buckets = nodes, rows, links, folder, buckets


def build(table: DataFrame, row_id: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> Index:
    """Graph over all rows that take part (see ``valid``); every such row is indexed. Repeated rows and equal vectors share a
    node, very long vectors are read whole, an empty table gives an index without nodes. Other columns are not read, so
    their names cannot clash."""
    spark = table.sparkSession
    rows = shared.stage(valid(table, row_id, vector), "ann-rows")
    nodes = shared.stage(rows.groupBy("node").agg(F.first("v").alias("v")), "ann-nodes")
    count = nodes.count()
    buckets = max(1, -(-count // BUCKET))

    def shrink(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in _small(_unit(_matrix(batch.column(1))))], pa.binary())], ["node", "small"])

    small = shared.stage(nodes.select("node", "v").mapInArrow(shrink, "node bigint, small binary"), "ann-small")
    links = shared.stage(_best_links(_block_neighbours(nodes, count), buckets), "ann-links-0")
    for turn in range(rounds):
        links = shared.stage(_descend(links, small, buckets, turn), f"ann-links-{turn + 1}")
    folder = shared.scratch(spark, "ann-index")

    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by("v")
        v, w = table.column("v").to_numpy(), table.column("w").to_numpy()
        store, root = shared.open_store(folder)
        held = io.BytesIO()
        np.savez(held, v=v, w=w, small=np.frombuffer(b"".join(table.column("small").to_pylist()), np.uint8).reshape(len(v), -1))
        shared.write_once(store, f"{root}/{table.column('bucket')[0].as_py()}.npz", [held.getvalue()])
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()), "links": pa.array([len(v)])})

    stored = _with_vectors(_around(links, -1), small).withColumn("bucket", _bucket("v", buckets)).groupBy("bucket").applyInArrow(keep, "bucket int, links bigint")
    shared.stage(stored, "ann-buckets")  # the files are complete when this table is
    return Index(nodes, rows, links, folder, buckets)


def _pack(q: int, vector: bytes, nodes: np.ndarray, sims: np.ndarray, done: np.ndarray):
    return q, vector, nodes.astype("<i8").tobytes(), sims.astype("<f4").tobytes(), done.astype(np.uint8).tobytes(), int((~done).sum())


def _state_table(rows) -> pa.Table:
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
    columns = list(zip(*rows)) if rows else [[] for _ in kinds]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("q", "vector", "nodes", "sims", "done", "open"), columns, kinds)})


def _entries(index: Index, queries: DataFrame) -> DataFrame:
    """First beam of each query (q, v): the links of its own node, or of the node next to it in the random orders."""
    edges = queries.select(F.col("q").alias("u")).join(index.links, "u")
    strangers = queries.join(index.nodes.select(F.col("node").alias("q")), "q", "left_anti")
    mixed = index.nodes.select("node", "v").unionByName(strangers.select(F.col("q").alias("node"), "v"))
    near = _block_neighbours(mixed, mixed.count()) if strangers.limit(1).count() else None
    if near is not None:
        known = near.join(strangers.select(F.col("q").alias("u")), "u", "left_semi").join(index.nodes.select(F.col("node").alias("w")), "w", "left_semi")
        edges = edges.unionByName(known.select(*edges.columns))

    def begin(left: pa.Table, right: pa.Table) -> pa.Table:
        units = _unit(_matrix(left.column("v")))
        u, w, s = (right.column(c).to_numpy() for c in ("u", "w", "s"))
        rows = []
        for q, unit in zip(left.column("q").to_pylist(), units):
            own = np.flatnonzero(u == q)
            at = own[_best(u[own], w[own], s[own], BEAM)]
            rows.append(_pack(q, unit.tobytes(), w[at], s[at], np.zeros(len(at), bool)))
        return _state_table(rows)

    spread = F.pmod(F.xxhash64("q"), F.lit(_query_groups(index.nodes.sparkSession)))
    spread_u = F.pmod(F.xxhash64("u"), F.lit(_query_groups(index.nodes.sparkSession)))
    return queries.groupBy(spread.alias("g")).cogroup(edges.groupBy(spread_u.alias("g"))).applyInArrow(begin, STATE)


def _query_groups(spark: SparkSession) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _step(index: Index, state: DataFrame) -> DataFrame:
    folder, buckets = index.folder, index.buckets

    def ask(batches):
        for batch in batches:
            rows = [x for x in batch.to_pylist() if x["open"]]
            qs, vectors, nodes = [], [], []
            for x in rows:
                done = np.frombuffer(x["done"], np.uint8)
                chosen = np.frombuffer(x["nodes"], "<i8")[np.flatnonzero(done == 0)[:EXPAND]]  # best first
                qs += [x["q"]] * len(chosen)
                vectors += [x["vector"]] * len(chosen)
                nodes += chosen.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(nodes, pa.int64()), pa.array(vectors, pa.binary())], ["q", "node", "vector"])

    def expand(table: pa.Table) -> pa.Table:
        store, root = shared.open_store(folder)
        with store.open_input_stream(f"{root}/{table.column('bucket')[0].as_py()}.npz") as opened:
            with np.load(io.BytesIO(opened.read())) as held:
                v, w, small = held["v"], held["w"], held["small"]
        table = table.sort_by("q")
        q, node = table.column("q").to_numpy(), table.column("node").to_numpy()
        unit = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(len(q), -1)
        vectors = _large(small)
        first, last = np.searchsorted(v, node), np.searchsorted(v, node, "right")
        head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rows = []
        for a, b in zip(head, np.append(head[1:], len(q))):
            at = np.concatenate([np.arange(x, y) for x, y in zip(first[a:b], last[a:b])])
            near, place = np.unique(w[at], return_index=True)
            sims = vectors[at[place]] @ unit[a]
            top = np.argsort(-sims, kind="stable")[:BEAM]
            rows.append(_pack(int(q[a]), b"", near[top], sims[top], np.zeros(len(top), bool)))
        return _state_table(rows)

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda x: (x["q"], not x["vector"]))
        out, at = [], 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end]["q"] == rows[at]["q"]:
                end += 1
            nodes, sims, done = (np.concatenate([np.frombuffer(x[c], k) for x in rows[at:end]]) for c, k in (("nodes", "<i8"), ("sims", "<f4"), ("done", np.uint8)))
            own = len(rows[at]["nodes"]) // 8
            done = done.astype(bool)
            done[np.flatnonzero(~done[:own])[:EXPAND]] = True
            _, first = np.unique(nodes, return_index=True)  # the beam's own entries come first and keep their marks
            keep = first[np.lexsort((nodes[first], -sims[first]))][:BEAM]
            out.append(_pack(rows[at]["q"], rows[at]["vector"], nodes[keep], sims[keep], done[keep]))
            at = end
        return _state_table(out)

    asked = state.mapInArrow(ask, "q bigint, node bigint, vector binary").withColumn("bucket", _bucket("node", buckets))
    answers = asked.groupBy("bucket").applyInArrow(expand, STATE)
    groups = F.pmod(F.xxhash64("q"), F.lit(_query_groups(state.sparkSession)))
    return state.unionByName(answers).groupBy(groups.alias("g")).applyInArrow(merge, STATE)


def search(index: Index, queries: DataFrame, k: int = 5, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score of the ``k`` nearest rows found for each query row, its own id left out.

    Nearest first, ties to the smaller id; all candidates, if fewer. Scores are cosines of the original vectors in
    double precision. Queries that take no part (see ``valid``) have no rows, nor has any query of an empty index; repeated
    queries are answered once, an empty table of queries gives no rows. Other columns are not read, so their names cannot clash.
    """
    asked = valid(queries, row_id, vector).select(F.col("id").alias("query_id"), "v", F.col("node").alias("q"))
    asked = shared.stage(asked, "ann-queries")
    distinct = asked.groupBy("q").agg(F.first("v").alias("v"))  # equal queries search once
    state = shared.stage(_entries(index, distinct), "ann-beam-0")
    for turn in range(MOST_STEPS):
        if not state.where("open > 0").limit(1).count():
            break
        state = shared.stage(_step(index, state), f"ann-beam-{turn + 1}")

    def nodes_of(batches):
        for batch in batches:
            for x in batch.to_pylist():
                found = np.frombuffer(x["nodes"], "<i8")
                found = np.unique(np.append(found, x["q"]))  # its own node, for equal vectors
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x["q"])), pa.array(found)], ["q", "node"])

    met = state.mapInArrow(nodes_of, "q bigint, node bigint").join(index.nodes.select("node", "v"), "node")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    scored = met.join(distinct.withColumnRenamed("v", "a"), "q").withColumnRenamed("v", "b").select(
        "q", "node", (dot / (length("a") * length("b"))).alias("score"))
    few = Window.partitionBy("node").orderBy("id")  # of many equal vectors the k + 1 smallest ids can matter
    members = index.rows.select("id", "node").withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= k + 1).drop("_n")
    best_nodes = Window.partitionBy("q").orderBy(F.desc("score"))
    close = scored.withColumn("_n", F.rank().over(best_nodes)).where(F.col("_n") <= k + 1).drop("_n")  # ties stay
    rows = asked.select("query_id", "q").join(close.join(members, "node"), "q").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
