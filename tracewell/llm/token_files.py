"""Token ids of all documents in flat files: unsigned integers without a header, with 64-bit offsets beside them.

Documents are ordered by id in range partitions. Each partition encodes its documents and writes

- ``ids-<part>.bin``: the ids, little-endian, 16 bits if the vocabulary allows, else 32;
- ``docs-<part>.bin``: per document id, offset of its first token in the part, number of tokens, and 1 if the id is
  known (four signed 64-bit numbers).

A table with one row per partition goes with them; prefix sums over it give where each part begins in the whole.
Readers map the files into memory where the store is a local or mounted folder, else they read ranges.
"""
from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import bpe_cache, shared
from tracewell.llm.words import slices

PARTS = "part int, tokens bigint, docs bigint, width int, folder string"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
BLOCK = 8 << 20
_FIELDS = 4


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, special: bool = False) -> DataFrame:
    """Writes the files and returns the table of parts with ``base``, the tokens of all parts before.

    Ascending doc_id; null ids first, equal ids by their text's hash. A null text counts as empty: it holds the end id
    alone. Only ``doc_id`` and ``text`` are read. An empty table writes no tokens. With ``special`` names of special tokens
    in a text become their ids.
    """
    spark = docs.sparkSession
    folder = folder or shared.scratch(spark, "token-files")
    order = [F.col("doc_id"), F.xxhash64("text")]
    sorted_docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)

    def put(batches):
        store, root = shared.open_store(folder)
        part = TaskContext.get().partitionId()
        coder = bpe_cache.encoder(vocabulary)
        end = np.array([end_id], f"<u{coder.width}").tobytes()
        index, total = [], 0

        def encoded():
            nonlocal total
            for batch in batches:
                names, texts = batch.column(0), shared.text_column(batch, "text")
                for a, b, _ in slices(texts):
                    for name, ids in zip(names[a:b].to_pylist(), coder.encode(texts[a:b].to_pylist(), special)):
                        n = len(ids) // coder.width + 1
                        index.append((name or 0, total, n, name is not None))
                        total += n
                        yield ids + end

        def buffered():
            held, size = [], 0
            for x in encoded():
                held.append(x)
                size += len(x)
                if size >= BLOCK:
                    yield b"".join(held)
                    held, size = [], 0
            yield b"".join(held)

        shared.write_once(store, f"{root}/ids-{part:06d}.bin", buffered())
        shared.write_once(store, f"{root}/docs-{part:06d}.bin", [np.array(index, "<i8").reshape(-1, _FIELDS).tobytes()])
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([total]), pa.array([len(index)]), pa.array([coder.width], pa.int32()), pa.array([folder])],
            ["part", "tokens", "docs", "width", "folder"])

    parts = shared.stage(sorted_docs.mapInArrow(put, PARTS), "token-parts")
    return shared.prefix_base(parts, "part", F.col("tokens"), "base")


class _File:
    """Bytes of a file by range: a memory map where the store is a folder, else ranged reads."""

    def __init__(self, store, path: str):
        self.size = store.get_file_info(path).size
        self.map = self.file = None
        if store.type_name == "local" and self.size:
            with open(path, "rb") as opened:
                self.map = mmap.mmap(opened.fileno(), 0, access=mmap.ACCESS_READ)
        elif self.size:
            self.file = store.open_input_file(path)

    def read(self, begin: int, end: int) -> bytes:
        if not self.size or begin == end:
            return b""
        return self.map[begin:end] if self.map is not None else self.file.read_at(end - begin, begin)


def read(parts: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start in the whole, n_tokens, ids as 32-bit little-endian numbers."""
    def get(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, root = shared.open_store(row["folder"])
                index = _File(store, f"{root}/docs-{row['part']:06d}.bin")
                ids = _File(store, f"{root}/ids-{row['part']:06d}.bin")
                step = 8 * _FIELDS
                for at in range(0, index.size, 500 * step):
                    rows = np.frombuffer(index.read(at, min(index.size, at + 500 * step)), "<i8").reshape(-1, _FIELDS)
                    for a, b in shared.spans((rows[:, 2] * 4).tolist(), BLOCK):
                        some, width = rows[a:b], row["width"]
                        begin, end = int(some[0, 1]), int(some[-1, 1] + some[-1, 2])
                        wide = np.frombuffer(ids.read(begin * width, end * width), f"<u{width}").astype("<u4").tobytes()
                        yield pa.RecordBatch.from_arrays([
                            pa.array(some[:, 0], mask=some[:, 3] == 0), pa.array(some[:, 1] + row["base"]), pa.array(some[:, 2]),
                            pa.array([wide[4 * (s - begin):4 * (s - begin + n)] for s, n in some[:, 1:3].tolist()], pa.binary())],
                            ["doc_id", "start", "n_tokens", "ids"])

    return parts.repartitionByRange("part").mapInArrow(get, READ)
