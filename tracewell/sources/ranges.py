"""Byte ranges of files: tasks open only the files that are asked for, and fetch only the asked bytes.

Asked ranges are sorted by path and position over range partitions, so ranges of one file lie together, and a file that
most of them point into is still read by several tasks. Files are opened by their path's file system (a local or mounted
folder, hdfs:, s3: and others that Arrow knows).
"""
from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_SIGHT_BYTES = 200_000
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 64 << 20
LINES = "source_path string, byte_start bigint, byte_end bigint, raw binary"


class Files:
    """Opens files by path, the last one kept open."""

    def __init__(self):
        self._stores, self._path, self._file = {}, None, None

    def _store(self, path: str):
        from pyarrow import fs
        uri = "file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path
        if "://" not in uri or uri.startswith("file://"):
            key, inside = "file", uri.removeprefix("file://")
        else:
            scheme, rest = uri.split("://", 1)
            key, inside = f"{scheme}://{rest.split('/', 1)[0]}", None
        if key not in self._stores:
            self._stores[key] = fs.LocalFileSystem() if key == "file" else fs.FileSystem.from_uri(uri)[0]
        return self._stores[key], inside if inside is not None else fs.FileSystem.from_uri(uri)[1]

    def open(self, path: str):
        if path != self._path:
            store, inside = self._store(path)
            self._path, self._file = None, store.open_input_file(inside)
            self._path = path
        return self._file

    def identity(self, path: str) -> tuple[int | None, int | None]:
        """inode and device where the store has them."""
        store, inside = self._store(path)
        if store.type_name != "local":
            return None, None
        found = os.stat(inside)
        return found.st_ino, found.st_dev


def _sorted(asked: DataFrame, *order: str) -> DataFrame:
    return asked.repartitionByRange(*order).sortWithinPartitions(*order)


def with_identity(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds inode and dev (null where the store has none, or the file is gone) to a list of files."""
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema]

    def look(batches):
        import pyarrow as pa
        known = Files()
        for batch in batches:
            found = []
            for p in batch.column(batch.schema.get_field_index(path)).to_pylist():
                try:
                    found.append(known.identity(p))
                except OSError:
                    found.append((None, None))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], [*batch.schema.names, "inode", "dev"])

    return files.mapInArrow(look, ", ".join([*names, "inode bigint", "dev bigint"]))


def read_records(asked: DataFrame, first_line_bytes: int) -> DataFrame:
    """id, size, inode, dev, first_line_hash, data and readable for rows of id, path, byte_start and wanted.

    ``data``: the ``wanted`` bytes from ``byte_start`` on, as far as the file has them. ``first_line_hash``: SHA-256 of the line
    that begins there without its end, of which at most ``first_line_bytes`` are read, if ``hashed`` is set. A file that is not
    there has a null size; one that cannot be read has ``readable`` false.
    """
    out = "id string, size bigint, inode bigint, dev bigint, first_line_hash string, data binary, readable boolean"

    def fetch(batches):
        import hashlib

        import pyarrow as pa
        files = Files()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                size = inode = dev = digest = data = None
                readable = True
                try:
                    handle = files.open(row["path"])
                    size = handle.size()
                    inode, dev = files.identity(row["path"])
                    left = max(0, size - row["byte_start"])
                    data = handle.read_at(min(row["wanted"], left), row["byte_start"]) if left else b""
                    if row["hashed"]:
                        head = handle.read_at(min(first_line_bytes, left), row["byte_start"]) if left else b""
                        end = head.find(b"\n")
                        digest = hashlib.sha256((head if end < 0 else head[:end]).rstrip(b"\r\n")).hexdigest()
                except FileNotFoundError:
                    pass
                except OSError:
                    readable = False
                rows.append({"id": row["id"], "size": size, "inode": inode, "dev": dev, "first_line_hash": digest, "data": data, "readable": readable})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("id", pa.string()), ("size", pa.int64()), ("inode", pa.int64()), ("dev", pa.int64()), ("first_line_hash", pa.string()),
                ("data", pa.binary()), ("readable", pa.bool_())]))

    return _sorted(asked.select("id", "path", "byte_start", "wanted", "hashed"), "path", "byte_start").mapInArrow(fetch, out)


def read_from(pieces: DataFrame, ceiling: int | None = None) -> DataFrame:
    """Complete lines (source_path, byte_start, byte_end, raw with its newline) that begin in each piece.

    ``pieces``: source_path, begin, until, aligned. A piece that is not ``aligned`` begins behind the first newline at or after
    ``begin``. With ``ceiling``, lines that begin ``ceiling`` bytes or more behind the first one are left. An unfinished last
    line is left too. A file is read in blocks, so its size does not matter.
    """

    def lines(handle, begin: int, until: int, aligned: bool) -> Iterator[tuple]:
        import numpy as np
        size, at, limit = handle.size(), begin, until
        if not aligned:
            while at < size:
                block = handle.read_at(min(BLOCK_BYTES, size - at), at)
                found = block.find(b"\n")
                at += len(block) if found < 0 else found + 1
                if found >= 0:
                    break
            else:
                return
        if ceiling is not None:
            limit = min(limit, at + ceiling)
        start, rest = at, []  # the open line begins at start; its bytes so far
        while start < limit and at < size:
            block = handle.read_at(min(BLOCK_BYTES, size - at), at)
            ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10) + 1
            at += len(block)
            if not len(ends):
                rest.append(block)
                continue
            head = b"".join(rest)
            data = head + block[:ends[-1]]
            bounds = np.concatenate([[0], ends + len(head)])
            keep = int(np.searchsorted(start + bounds[:-1], limit))
            if keep:
                yield start + bounds[:keep + 1], data[:bounds[keep]], bounds[:keep + 1]
            rest = [block[ends[-1]:]]
            start += int(bounds[-1])

    def read(batches):
        import numpy as np
        import pyarrow as pa
        files = Files()
        for batch in batches:
            for piece in batch.to_pylist():
                try:
                    handle = files.open(piece["source_path"])
                except FileNotFoundError:
                    continue
                for places, data, bounds in lines(handle, piece["begin"], piece["until"], piece["aligned"]):
                    n = len(bounds) - 1
                    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([piece["source_path"]] * n), pa.array(places[:-1]), pa.array(places[1:]), raw], ["source_path", "byte_start", "byte_end", "raw"])

    return _sorted(pieces.select("source_path", "begin", "until", "aligned"), "source_path", "begin").mapInArrow(read, LINES)


def starts(files: DataFrame, committed: DataFrame, restart_at_zero: bool = False) -> DataFrame:
    """Where reading goes on in each file: source_path, size, inode, dev, begin, aligned, known, rotated, shrunk.

    ``files``: source_path, size, inode, dev. ``committed``: source_path, offset, inode, dev. A file is the same if its
    identity is (without identities, if its path is). A new, replaced or shrunk file is read from its last 200,000 bytes on,
    behind the first newline there (from byte 0 if ``restart_at_zero``).
    """
    c = F.col
    prior = committed.select("source_path", c("offset").alias("_offset"), c("inode").alias("_inode"), c("dev").alias("_dev"))
    same = c("_offset").isNotNull() & c("inode").eqNullSafe(c("_inode")) & c("dev").eqNullSafe(c("_dev"))
    state = files.join(prior, "source_path", "left").withColumns({
        "rotated": c("_offset").isNotNull() & ~same, "shrunk": same & (c("size") < c("_offset")), "known": same & (c("size") >= c("_offset"))})
    first = F.lit(0).cast("bigint") if restart_at_zero else F.greatest(F.lit(0), c("size") - FIRST_SIGHT_BYTES)
    return state.withColumn("begin", F.when(c("known"), c("_offset")).otherwise(first)).withColumn(
        "aligned", c("known") | (c("begin") == 0)).drop("_offset", "_inode", "_dev")


def read_tail(state: DataFrame, ceiling: int | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The lines behind ``begin`` of each file of ``starts``; what lies before is not read.

    Without a ceiling a long tail is read in pieces by several tasks; with one, what is read of a file is bounded.
    """
    c = F.col
    grown = state.filter(c("size") > c("begin"))
    if ceiling is not None:
        return read_from(grown.withColumn("until", c("size")), ceiling)
    cuts = grown.withColumn("_at", F.explode(F.sequence(c("begin"), c("size") - 1, F.lit(piece_bytes).cast("bigint"))))
    first = c("_at") == c("begin")
    # A later piece begins behind the first newline at or after the byte before it: a line that starts at the cut is its own.
    pieces = cuts.select("source_path", F.when(first, c("begin")).otherwise(c("_at") - 1).alias("begin"),
                         F.least(c("_at") + piece_bytes, c("size")).alias("until"), (first & c("aligned")).alias("aligned"))
    return read_from(pieces)


def captured(lines: DataFrame, limit: int = 800) -> DataFrame:
    """Nonblank lines as captured: clipped text, whether it was clipped, original bytes (with the line's end) and content hash."""
    bare = F.encode(F.rtrim(F.decode("raw", "ISO-8859-1"), F.lit("\r\n")), "ISO-8859-1")  # byte by byte: the line need not be UTF-8
    text = F.rtrim(F.make_valid_utf8(F.col("raw").cast("string")), F.lit("\r\n"))
    return lines.withColumns({"_text": text, "content_hash": F.sha2(bare, 256)}).filter("_text != ''").select(
        "source_path", F.substring_index("source_path", "/", -1).alias("source_name"), "byte_start", "byte_end", F.left("_text", F.lit(limit)).alias("text"),
        (F.length("_text") > limit).alias("text_truncated"), (F.col("byte_end") - F.col("byte_start")).alias("original_text_bytes"), "content_hash")


def progress(state: DataFrame, lines: DataFrame) -> DataFrame:
    """What to commit after reading: source_path, offset, size, inode, dev, backlog_bytes. ``lines``: what ``read_tail`` gave, stored."""
    c = F.col
    used = lines.groupBy("source_path").agg(F.max("byte_end").alias("_used"))
    # a first sight that found no line end goes on at the end of the file, as nothing before it will be read
    idle = F.when(c("aligned"), c("begin")).otherwise(c("size"))
    return state.join(used, "source_path", "left").withColumn("offset", F.coalesce("_used", idle)).select(
        "source_path", "offset", "size", "inode", "dev", (c("size") - c("offset")).alias("backlog_bytes"))
