"""Packs documents into sequences by concatenating and cutting.

First pass: documents are encoded, and each partition sums its tokens. Prefix sums over one row per partition give
every document its place in the whole. Second pass: the stream is cut at multiples of the sequence length; a document
that crosses a cut gives one piece per sequence, marked as going on. Only the last sequence is padded.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import bpe_cache, shared
from tracewell.llm.words import slices

ENCODED = "doc_id bigint, n_tokens bigint, ids binary, part int, place bigint"
PIECES = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
          "goes_on boolean, ids binary")
BLOCK_TOKENS = 2 << 20


def encode(docs: DataFrame, vocabulary: str, end_id: int, special: bool = False) -> DataFrame:
    """Token ids per document (end id included, 16 or 32 bits each) with its place in its partition."""
    def run(batches):
        coder = bpe_cache.encoder(vocabulary)
        end = np.array([end_id], f"<u{coder.width}").tobytes()
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = shared.text_column(batch, "text")
            for a, b, _ in slices(texts):
                ids = [x + end for x in coder.encode(texts[a:b].to_pylist(), special)]
                sizes = np.array([len(x) // coder.width for x in ids], np.int64)
                places = place + np.cumsum(sizes) - sizes
                place += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(sizes), pa.array(ids, pa.binary()), pa.array(np.full(b - a, part, np.int32)), pa.array(places)],
                    ["doc_id", "n_tokens", "ids", "part", "place"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def pack(docs: DataFrame, vocabulary: str, end_id: int, length: int = 2048, special: bool = False) -> DataFrame:
    """Pieces of all documents with their ids (32-bit little-endian), sequence and offset in it.

    ``start`` counts the document's ids before the piece, ``doc_tokens`` all of them with the end id; ``goes_on`` says
    that the document continues in the next sequence. A null text is empty and still holds the end id. Repeated
    doc_ids are packed as they come; very long texts are encoded whole and cut into many pieces; an empty table gives no
    pieces; other columns are not read, so their names cannot clash. Which document stands where follows the partitions of
    the input; the staged first pass fixes it. With ``special`` names of special tokens in a text become their ids.
    """
    encoded = shared.stage(encode(docs, vocabulary, end_id, special), "packing")
    parts = encoded.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))
    bases = shared.prefix_base(parts, "part", F.col("_tokens"), "base").select("part", "base")

    def cut(batches):
        for batch in batches:
            table = batch.to_pydict()
            sizes = np.array(table["n_tokens"], np.int64)
            for a, b in shared.spans(sizes.tolist(), BLOCK_TOKENS):
                rows = {k: [] for k in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "goes_on", "ids")}
                for i in range(a, b):
                    raw, n = table["ids"][i], int(sizes[i])
                    wide = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()
                    begin = table["base"][i] + table["place"][i]
                    at = 0
                    while at < n:
                        sequence, offset = divmod(begin + at, length)
                        size = min(n - at, length - offset)
                        for k, v in (("doc_id", table["doc_id"][i]), ("start", at), ("length", size), ("doc_tokens", n), ("sequence_id", sequence),
                                     ("offset", offset), ("goes_on", at + size < n), ("ids", wide[4 * at:4 * (at + size)])):
                            rows[k].append(v)
                        at += size
                kinds = {"doc_id": pa.int64(), "goes_on": pa.bool_(), "ids": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()], list(rows))

    placed = encoded.join(F.broadcast(bases), "part")  # one row per partition of the first pass
    return placed.select("doc_id", "n_tokens", "ids", "place", "base").mapInArrow(cut, PIECES)


def sequences(pieces: DataFrame, length: int = 2048, pad_id: int = 0) -> DataFrame:
    """The packed sequences: ids padded to ``length`` (the last may be short) and the number of real tokens."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))
    padding = F.unhex(F.repeat(F.lit(f"{int(pad_id).to_bytes(4, 'little').hex()}"), (F.lit(length) - F.col("n_tokens")).cast("int")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids")).withColumn(
        "ids", F.concat("ids", padding))
