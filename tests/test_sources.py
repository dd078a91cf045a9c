"""Positions of lines in files that are split, ranged reads and excerpts, against plain loops over the bytes."""
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import excerpts
from tracewell.sources import files as S, ranges as R


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "4096")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def content(seed, lines, last_newline=True, longest=200):
    rng = random.Random(seed)
    out = []
    for _ in range(lines):
        body = bytes(rng.choice("abc \r{}\"é漢".encode()) for _ in range(rng.choice([0, 1, 5, longest])))
        out.append(body.replace(b"\n", b"") + rng.choice([b"\n", b"\r\n"]))
    data = b"".join(out)
    return data if last_newline else data + b"unfinished"


def plain(data):
    """(start, end, raw without the newline) of complete lines."""
    out, at = [], 0
    while (end := data.find(b"\n", at)) >= 0:
        out.append((at, end + 1, data[at:end]))
        at = end + 1
    return out


def test_positions_in_split_files(spark, tmp_path, small_splits):
    files = {"a.log": content(1, 900), "b.log": content(2, 900, False), "c+d %20.log": content(3, 40), "empty.log": b"", "none.log": b"no end",
             "newlines.log": b"\n" * 9000, "wide.log": b"x" * 30_000 + b"\n" + b"y" * 9000 + b"\r\n" + content(4, 200)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    frame = S.read_lines(spark, [f"{tmp_path}/*.log"])
    assert frame.rdd.getNumPartitions() > 10
    got = {}
    for r in frame.select("source_path", "byte_start", "byte_end", F.col("raw").cast("binary").alias("raw")).collect():
        got.setdefault(r.source_path.rsplit("/", 1)[1], []).append((r.byte_start, r.byte_end, bytes(r.raw)))
    for name, data in files.items():
        assert sorted(got.get(name, [])) == plain(data), name
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("MapInArrow")[-1]  # no text is shuffled to find positions


def test_overlapping_globs_read_a_file_once(spark, tmp_path):
    for name in ("agent.log", "agent.log.1", "other.txt", "errors.log"):
        (tmp_path / name).write_text(f"{name}\n")
    rows = S.read_text_lines(spark, [f"{tmp_path}/agent.log*", f"{tmp_path}/{{agent,errors}}.lo?", f"{tmp_path}/agent.log"]).collect()
    assert sorted(r.text for r in rows) == ["agent.log", "agent.log.1", "errors.log"]
    for folder in ("east/logs", "west/logs"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "agent.log").write_text(f"{folder}\n")
    rows = S.read_text_lines(spark, [f"{tmp_path}/east/logs/*.log", f"file:{tmp_path}/west/*/agent*", f"{tmp_path}/west/logs/agent.log"]).collect()
    assert sorted(r.text for r in rows) == ["east/logs", "west/logs"]
    assert S._folder("file:///a/b/c*.log") == S._folder("/a/b/*") == "/a/b"


@pytest.mark.parametrize("glob,yes,no", [
    ("/x/*.log", ["/x/a.log", "file:/x/a.log", "file:///x/.log"], ["/x/y/a.log", "/x/a.log1"]),
    ("hdfs://nn/x/[ab]?.log", ["/x/ab.log", "hdfs://nn/x/bb.log"], ["/x/cb.log"]),
    ("/x//[!a]{1,2*}/f.(g)", ["/x/b1/f.(g)", "/x/c2z/f.(g)"], ["/x/a1/f.(g)", "/x/b3/f.(g)"]),
])
def test_globs(glob, yes, no):
    import re
    pattern = re.compile(S.glob_regex(glob).replace(r"\z", r"\Z"))
    assert all(pattern.match(p) for p in yes) and not any(pattern.match(p) for p in no)


def loop_tail(data, offset, ceiling):
    """Lines behind ``offset`` (None: a first sight), as a loop over the file reads them."""
    if offset is None:
        start = max(0, len(data) - R.FIRST_SIGHT_BYTES)
        if start:
            found = data.find(b"\n", start)
            start = found + 1 if found >= 0 else len(data)
    else:
        start = offset
    out = []
    for begin, end, raw in plain(data):
        if begin >= start and (ceiling is None or begin - start < ceiling):
            out.append((begin, end, raw + b"\n"))
    return out, (out[-1][1] if out else start)


@pytest.mark.parametrize("ceiling", [None, 1, 5000])
def test_tail_reads_what_is_new(spark, tmp_path, monkeypatch, ceiling):
    monkeypatch.setattr(R, "FIRST_SIGHT_BYTES", 3000)
    monkeypatch.setattr(R, "BLOCK_BYTES", 700)
    data = {name: content(seed, n, last) for seed, (name, n, last) in enumerate(
        [("new", 300, True), ("known", 300, False), ("rotated", 200, True), ("shrunk", 50, True), ("same", 80, True), ("tiny", 3, True), ("wide", 5, True)])}
    data["wide"] = b"z" * 9000 + b"\n" + data["wide"]
    data["endless"] = b"q" * 9000
    offsets = {"known": plain(data["known"])[100][1], "rotated": plain(data["rotated"])[50][1], "shrunk": 10 ** 6, "same": len(data["same"]), "wide": 0}
    rows, prior = [], []
    for name, d in data.items():
        path = str(tmp_path / name)
        open(path, "wb").write(d)
        found = os.stat(path)
        rows.append((path, len(d), found.st_ino, found.st_dev))
        if name in offsets:
            prior.append((path, offsets[name], found.st_ino + (name == "rotated"), found.st_dev))
    files = spark.createDataFrame(rows, "source_path string, size bigint, inode bigint, dev bigint")
    state = R.starts(files, spark.createDataFrame(prior, "source_path string, offset bigint, inode bigint, dev bigint"))
    assert {(r.source_path.rsplit("/", 1)[1], r.rotated, r.shrunk) for r in state.filter("rotated or shrunk").collect()} == {("rotated", True, False), ("shrunk", False, True)}
    new = R.read_tail(state, ceiling, piece_bytes=1000)
    got = {}
    for r in new.collect():
        got.setdefault(r.source_path.rsplit("/", 1)[1], []).append((r.byte_start, r.byte_end, bytes(r.raw)))
    done = {r.source_path.rsplit("/", 1)[1]: (r.offset, r.backlog_bytes) for r in R.progress(state, new).collect()}
    for name, d in data.items():
        lines, consumed = loop_tail(d, offsets[name] if name in ("known", "same", "wide") else None, ceiling)
        assert sorted(got.get(name, [])) == lines, name
        assert done[name] == (consumed, len(d) - consumed), name
    shown = R.captured(new, limit=3).filter("source_path like '%/known'").orderBy("byte_start").collect()
    want = [(raw, b, e) for b, e, raw in loop_tail(data["known"], offsets["known"], ceiling)[0] if raw.rstrip(b"\r\n")]
    assert [(r.byte_start, r.byte_end, r.content_hash, r.original_text_bytes) for r in shown] == [
        (b, e, hashlib.sha256(raw.rstrip(b"\r\n")).hexdigest(), e - b) for raw, b, e in want]
    assert [r.text for r in shown] == [raw.decode("utf-8", "replace").rstrip("\r\n")[:3] for raw, _, _ in want]


def test_bytes_before_the_offset_are_not_read(spark, tmp_path, monkeypatch):
    """A sparse file of 50 GB is read from its end within seconds."""
    path = str(tmp_path / "huge.log")
    with open(path, "wb") as f:
        f.seek(50 << 30)
        f.write(b"\nlast line\n")
    found = os.stat(path)
    files = spark.createDataFrame([(path, found.st_size, found.st_ino, found.st_dev)], "source_path string, size bigint, inode bigint, dev bigint")
    known = spark.createDataFrame([(path, (50 << 30) + 1, found.st_ino, found.st_dev)], "source_path string, offset bigint, inode bigint, dev bigint")
    assert [bytes(r.raw) for r in R.read_tail(R.starts(files, known)).collect()] == [b"last line\n"]
    assert [bytes(r.raw) for r in R.read_tail(R.starts(files, known.limit(0))).collect()] == [b"last line\n"]


EVIDENCE = "id int, source_path string, byte_start bigint, byte_end bigint, text string, content_hash string, inode bigint, dev bigint, cursor string, boot_id string"


def test_excerpts(spark, tmp_path):
    path, other = str(tmp_path / "agent.log"), str(tmp_path / "private.log")
    data = b"first line\r\nsecond \xff line\nthird" + "é".encode() * 10
    open(path, "wb").write(data)
    open(other, "w").write("never opened")
    os.chmod(other, 0)
    at, end = 12, 26
    good, found = hashlib.sha256(b"second \xff line").hexdigest(), os.stat(path)
    rows = [(1, path, at, end, "t", good, None, None, None, None), (2, path, at, end, "t" * 30, "0" * 64, None, None, None, None),
            (3, path, at, end, "t", good, found.st_ino, found.st_dev, None, None), (4, path, at, end, "t", good, found.st_ino + 1, found.st_dev, None, None),
            (5, path, 0, 0, "t", None, None, None, None, None), (6, path, 10 ** 6, 10 ** 6 + 5, "t", None, None, None, None, None),
            (7, str(tmp_path / "gone"), 0, 5, "é" * 9, None, None, None, None, None), (8, str(tmp_path / "gone"), 0, 5, "t", good, None, None, None, None),
            (9, "journald", 0, 0, "entry", None, None, None, "s=1", None), (10, "journald", 0, 0, "entry", None, None, None, None, None), (11, None, 0, 0, None, None, None, None, None, None)]
    out = {r.id: (r.excerpt_status, r.excerpt, r.excerpt_truncated, r.verified) for r in excerpts.excerpt(spark.createDataFrame(rows, EVIDENCE), max_bytes=13).collect()}
    assert out == {
        1: ("exact_source", "second � line", True, True), 2: ("rotated_or_truncated", "t" * 13, True, False),
        3: ("exact_source", "second � line", True, True), 4: ("rotated_or_truncated", "t", False, False),
        5: ("exact_source", "first line\r\ns", False, None), 6: ("rotated_or_truncated", "t", False, None),
        7: ("source_file_missing", "é" * 6 + "�", True, None), 8: ("rotated_or_truncated", "t", False, False),
        9: ("journald_entry", "entry", False, None), 10: ("journald_unretained", "entry", False, None), 11: ("source_file_missing", None, None, None)}


def test_excerpts_open_only_what_is_asked(spark, tmp_path):
    plan = excerpts.excerpt(spark.createDataFrame([], EVIDENCE))._jdf.queryExecution().executedPlan().toString()
    assert "Scan binaryFile" not in plan and "Scan text" not in plan and "FileScan" not in plan
    with pytest.raises(ValueError):
        excerpts.excerpt(spark.createDataFrame([], EVIDENCE), max_bytes=0)
