"""Vector code compression: one codebook per part of the vectors, entries assigned with the help of LAESA pivots.

Vectors become integers and are cut into equal parts. Some entries of each part position's first codebook are its fixed
pivots; the distances of every part to them are computed once and stored beside the part. In each round the distances
between pivots and current entries give, by the triangle inequality, a lower bound for every pair of part and entry.
Entries are tried in the order of that bound; squared distances are whole numbers and exact, and a part is done when the
next bound exceeds its best distance. Bounds are lessened by more than the rounding of their square roots, so nothing
that could be nearest, or equally near, is left out.

Rounds are passes over one written table. A task sends one row of sums per part position and entry, so what reaches the
driver is bounded by partitions' partial sums added up by Spark: parts x entries rows.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import shared

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
PIVOTS = 6
SLICE = 4096  # rows at a time
BROADCAST_LABELS = 100_000
SALT = 16

SUMS = "part int, entry int, sums array<bigint>, n bigint"


def kept(table: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and v (array of double) of the rows that take part.

    Vectors that are null or empty, or hold null or non-finite numbers, are left out; so are those of another length than
    the vector of the smallest id (of equal ids the longest). Null ids come after all others. A missing label column is null.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    name = F.col(f"`{label}`") if label in table.columns else F.lit(None).cast("int")
    rows = table.select(F.col(f"`{row_id}`").cast("bigint").alias("vec_id"), name.alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    first = rows.select("vec_id", F.size("v").alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), F.desc("n")).first()
    return rows.where(F.size("v") == (first["n"] if first else 0))


def _whole(column: pa.Array, scale: int) -> np.ndarray:
    """Rows of floor(scale * x)."""
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
    most = np.abs(x).max() if len(x) else 0
    width = len(x) // max(1, len(column))
    if 4.0 * most * most * width >= 2.0 ** 62:
        raise OverflowError(f"components up to {most / scale} do not fit 64-bit squared distances")
    return x.astype(np.int64).reshape(len(column), width)


def _apart(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    gap = x[:, None, :] - entries[None, :, :]
    return np.einsum("ijk,ijk->ij", gap, gap)


def pivots(entries: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Entries far apart, chosen one after another (parts x pivots x components)."""
    out = []
    for book in entries:
        chosen = [0]
        far = _apart(book, book[:1])[:, 0]
        while len(chosen) < min(most, len(book)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, _apart(book, book[chosen[-1:]])[:, 0])
        out.append(book[chosen])
    return np.stack(out)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivot: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row (ties to the lower index), its exact squared distance, and how many distances were computed.

    ``to_pivots`` holds the rows' distances to ``pivot``.
    """
    apart = np.sqrt(_apart(pivot, entries).astype(np.float64))  # pivots x entries
    bound = np.zeros((len(x), len(entries)))
    for p in range(len(pivot)):
        np.maximum(bound, np.abs(to_pivots[:, p:p + 1] - apart[p]), out=bound)
    slack = 1e-6 + 1e-12 * (to_pivots.max(1, keepdims=True) + apart.max())
    bound = np.maximum(bound - slack, 0.0)
    order = np.argsort(bound, axis=1, kind="stable")
    least = np.take_along_axis(bound, order, 1)
    least = least * least * (1 - 1e-12)
    best = np.full(len(x), np.iinfo(np.int64).max)
    code = np.full(len(x), len(entries))
    open_rows, tried = np.arange(len(x)), 0
    for turn in range(len(entries)):
        open_rows = open_rows[least[open_rows, turn] <= best[open_rows]]
        if not len(open_rows):
            break
        entry = order[open_rows, turn]
        gap = x[open_rows] - entries[entry]
        found = np.einsum("ij,ij->i", gap, gap)
        tried += len(open_rows)
        better = (found < best[open_rows]) | ((found == best[open_rows]) & (entry < code[open_rows]))
        rows = open_rows[better]
        best[rows], code[rows] = found[better], entry[better]
    return code, best, tried


def _long_lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))


def _prepared(rows: DataFrame, fixed: np.ndarray, scale: int) -> DataFrame:
    """vec_id, label, ints and the parts' distances to their pivots, written once."""
    n_parts, n_pivots, size = fixed.shape
    schema = T.StructType([f for f in rows.schema.fields if f.name != "v"] + [
        T.StructField("ints", T.ArrayType(T.LongType())), T.StructField("to_pivots", T.ArrayType(T.DoubleType()))])

    def measure(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                piece = batch.slice(a, SLICE)
                x = _whole(piece.column(2), scale)
                far = [np.sqrt(_apart(x[:, p * size:(p + 1) * size], fixed[p]).astype(np.float64)) for p in range(n_parts)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), _long_lists(x), _long_lists(np.concatenate(far, 1))], schema.names)

    return shared.stage(rows.select("vec_id", "label", "v").mapInArrow(measure, schema), "vector-parts")


def _assigned(batch: pa.RecordBatch, books: np.ndarray, fixed: np.ndarray):
    """Slices of a batch with (first row, ints, codes, distances) of all parts."""
    n_parts, n_pivots, size = fixed.shape
    for a in range(0, batch.num_rows, SLICE):
        piece = batch.slice(a, SLICE)
        x = piece.column(2).flatten().to_numpy().reshape(piece.num_rows, -1)
        far = piece.column(3).flatten().to_numpy().reshape(piece.num_rows, n_parts, n_pivots)
        found = [nearest(x[:, p * size:(p + 1) * size], far[:, p], books[p], fixed[p]) for p in range(n_parts)]
        yield piece, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _moved(parts: DataFrame, books: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Codebooks after one round: componentwise floor(sum / count); unused entries stay."""
    n_parts, n_entries, size = books.shape

    def add(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((n_parts, n_entries), np.int64)
        for batch in batches:
            for _, x, codes, _ in _assigned(batch, books, fixed):
                for p in range(n_parts):
                    np.add.at(sums[p], codes[:, p], x[:, p * size:(p + 1) * size])
                    counts[p] += np.bincount(codes[:, p], minlength=n_entries)
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), _long_lists(sums[part, entry]), pa.array(counts[part, entry])],
                ["part", "entry", "sums", "n"])

    partial = parts.mapInArrow(add, SUMS)
    totals = partial.groupBy("part", "entry").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]).alias("sums"), F.sum("n").alias("n"))
    moved = books.copy()
    for row in totals.collect():  # parts x entries rows
        moved[row["part"], row["entry"]] = [s // row["n"] for s in row["sums"]]
    return moved


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The written table of parts, the codebooks (parts x entries x components) and the pivots, from the rows of ``kept``.

    The first codebooks are the parts of the ``entries`` smallest ids; null ids come last, equal ids are ordered by their
    vectors. Fewer rows give fewer entries, none give empty codebooks. A vector length that ``parts`` does not divide is an error.
    """
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    width = len(start[0]["v"]) if start else parts
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    flat = _whole(pa.array([r["v"] for r in start], pa.list_(pa.float64())), scale) if start else np.zeros((0, width), np.int64)
    books = flat.reshape(len(flat), parts, width // parts).transpose(1, 0, 2).copy()
    fixed = pivots(books) if start else np.zeros((parts, 0, width // parts), np.int64)
    table = _prepared(rows, fixed, scale)
    for _ in range(rounds if start else 0):
        books = _moved(table, books, fixed)
    return table, books, fixed


def encode(table: DataFrame, books: np.ndarray, fixed: np.ndarray) -> DataFrame:
    """vec_id, label, codes (one byte per part) and error (squared distances summed over parts) of the table of parts."""
    if books.shape[1] > 256:
        raise ValueError("codes of one byte need at most 256 entries")
    schema = T.StructType([f for f in table.schema.fields if f.name in ("vec_id", "label")] + [T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())])

    def assign(batches):
        for batch in batches:
            for piece, _, codes, far in _assigned(batch, books, fixed):
                raw = codes.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(far.sum(1))], schema.names)

    return table.mapInArrow(assign, schema)


def decode(encoded: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``encoded`` with ``vector``: the entries of its codes, divided by the scale. Null codes give null."""
    schema = T.StructType([f for f in encoded.schema.fields if f.name != "vector"] + [T.StructField("vector", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in schema.fields[:-1]]
    part = np.arange(books.shape[0])

    def restore(batches):
        for batch in batches:
            codes = batch.column(batch.schema.get_field_index("codes")).to_pylist()
            found = [None if c is None else (books[part, np.frombuffer(c, np.uint8)] / scale).ravel().tolist() for c in codes]
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(found, pa.list_(pa.float64()))], schema.names)

    return encoded.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(restore, schema)


def with_label_error(encoded: DataFrame, most: int = BROADCAST_LABELS) -> DataFrame:
    """``encoded`` with ``label_error``: the errors of all rows of its label (null labels together).

    Errors are added up per label before any join. Up to ``most`` labels are broadcast; more are joined with salted keys, as
    one label may hold a third of all rows.
    """
    sums = shared.stage(encoded.groupBy(F.col("label").alias("_name")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= most:
        return encoded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_name"))).drop("_name")
    left = encoded.withColumn("_part", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALT)).cast("int"))
    right = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.join(right, (F.col("_part") == F.col("_salt")) & F.col("label").eqNullSafe(F.col("_name"))).drop("_name", "_part", "_salt")


def compress(table: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors that take part (see ``kept``), with their errors and those of their label, and the codebooks.

    vec_id, label, codes, error, label_error. Repeated rows stay, each with its code; an empty table gives no rows and empty
    codebooks. Very long vectors are read whole. Other columns are not read, so their names cannot clash; vectors whose
    squared distances exceed 64 bits are an error.
    """
    held, books, fixed = train(kept(table, row_id, vector, label), parts, entries, rounds)
    encoded = shared.stage(encode(held, books, fixed), "vector-codes")
    return with_label_error(encoded), books
