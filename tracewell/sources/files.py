"""File sources: JSON lines, raw logs, journal exports, changed files."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import patterns as P, session
from tracewell.functions import text as text_functions
from tracewell.operators.lines import profile_of, source_kind

MAX_ROW_BYTES = 1 << 20
JOURNAL_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in P.JOURNAL_FIELDS])
UNIT_FIELDS = ("_SYSTEMD_UNIT", "_SYSTEMD_USER_UNIT", "SYSLOG_IDENTIFIER", "_COMM")
EVENT_SCHEMA = "ts string, host string, profile string, file string, sig string, sev string, text string"


LINES = "source_path string, byte_start bigint, byte_end bigint, raw string"
SMALL_SPLITS = 200_000  # rows of (path hash, split, offset), a few MB, that may be broadcast


def list_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """path, modified and size of the matched files, each once; contents are not read."""
    return spark.read.format("binaryFile").load(patterns).select(
        "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).dropDuplicates(["path"])


def plain_path(path: Column) -> Column:
    """The path of ``_metadata`` as it is written in other places: without percent encoding."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def glob_regex(glob: str) -> str:
    """A glob (``*``, ``?``, ``[...]``, ``{a,b}``) as a pattern for whole paths, whatever their scheme and host."""
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", glob)
    out, depth, i = "", 0, 0
    while i < len(path):
        ch = path[i]
        i += 1
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[" and "]" in path[i + 1:]:
            end = path.index("]", i + 1)
            out += "[" + path[i:end].replace("!", "^", 1 if path[i] == "!" else 0).replace("\\", "\\\\") + "]"
            i = end + 1
        elif ch == "{":
            out, depth = out + "(?:", depth + 1
        elif ch == "}" and depth:
            out, depth = out + ")", depth - 1
        elif ch == "," and depth:
            out += "|"
        else:
            out += re.escape(path[i] if ch == "\\" and i < len(path) else ch)
            i += ch == "\\"
    return r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?" + re.sub("/+", "/", out) + r"\z"


def _folder(glob: str) -> str:
    """The folder of a glob above its first wildcard."""
    plain = re.sub(r"^file:(//)?(?=/)", "", glob)
    return re.split(r"[*?\[{]", plain)[0].rsplit("/", 1)[0]


def _text(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """value and _metadata of the lines of the matched files, each file once.

    Several globs may match one file, and Spark would read it once for each. So globs whose folders lie in each other become
    one pattern on the files below the outer folder; it is applied to the listing, before any file is opened. Globs in
    folders apart are read apart.
    """
    reader = spark.read.option("lineSep", "\n")
    folders = {_folder(p) for p in patterns}
    outer = sorted(f for f in folders if not any(f != g and f.startswith(g.rstrip("/") + "/") for g in folders))
    parts = []
    for root in outer:
        own = sorted({p for p in patterns if _folder(p) == root or _folder(p).startswith(root.rstrip("/") + "/")})
        if len(own) == 1:
            parts.append(reader.text(own[0]).select("value", "_metadata"))
        else:
            wanted = "|".join(glob_regex(p) for p in own)
            found = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(root or "/").select("value", "_metadata")
            parts.append(found.filter(plain_path(F.col("_metadata.file_path")).rlike(wanted)))
    return reduce(DataFrame.unionByName, parts)


def read_lines(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """source_path, byte_start, byte_end and raw (the line without its end) of all complete lines of the matched plain-text files.

    Files are split like any text source, so one file of any size is read by many tasks. A task adds up the bytes of
    the lines of its splits in the order in which it reads them; no text is shuffled for that. Where a split begins comes
    from a table with one row per split, with the bytes of the file's earlier splits: a first pass over the text that counts,
    and is left out if no file is large enough to be split. Lines end with a newline; one without, at the end of a file, is
    left for later. Blank lines are there too; bytes that are not UTF-8 are as in the file.
    """
    if not patterns:
        return spark.createDataFrame([], LINES)
    meta = "_metadata"
    scanned = _text(spark, patterns).select(
        "value", F.col(f"{meta}.file_path").alias("path"), F.col(f"{meta}.file_block_start").alias("split"), F.col(f"{meta}.file_size").alias("size"))

    def place(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        path, split, done = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            width = pc.cast(pc.binary_length(batch.column(0)), pa.int64()).to_numpy(zero_copy_only=False) + 1
            start = np.cumsum(width) - width
            paths, splits = batch.column(1), batch.column(2)
            turn = np.zeros(len(width), bool)
            turn[0] = paths[0].as_py() != path or splits[0].as_py() != split
            if len(width) > 1:
                turn[1:] = pc.or_(pc.not_equal(paths[1:], paths[:-1]), pc.not_equal(splits[1:], splits[:-1])).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(turn)
            before = np.full(len(width), done, np.int64)
            if len(heads):
                bounds = np.append(heads, len(width))
                before[heads[0]:] = np.repeat(-start[heads], np.diff(bounds))
            offset = start + before
            path, split, done = paths[len(width) - 1].as_py(), splits[len(width) - 1].as_py(), int(offset[-1] + width[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offset), pa.array(width)], ["value", "path", "split", "size", "offset", "width"])

    placed = scanned.mapInArrow(place, "value string, path string, split bigint, size bigint, offset bigint, width bigint")
    largest = list_files(spark, patterns).agg(F.max("size")).first()[0] or 0
    whole = min(_bytes_setting(spark, "spark.sql.files.maxPartitionBytes"), _bytes_setting(spark, "spark.sql.files.openCostInBytes"))
    start = F.col("offset")
    if largest > whole:
        placed = _with_split_starts(placed, scanned)
        # a split without a start would mean that the two passes were cut in different places
        start = F.coalesce("begins", F.when(F.col("split") == 0, 0), F.raise_error(F.lit("the splits of a file moved between two passes"))) + F.col("offset")
    placed = placed.withColumn("byte_start", start.cast("bigint"))
    packed = F.col("path").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)\z")  # sizes are those of the packed bytes
    return placed.withColumn("byte_end", F.col("byte_start") + F.col("width")).filter((F.col("byte_end") <= F.col("size")) | packed).select(
        plain_path(F.col("path")).alias("source_path"), "byte_start", "byte_end", F.col("value").alias("raw"))


def _bytes_setting(spark: SparkSession, name: str) -> int:
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))


def _with_split_starts(placed: DataFrame, scanned: DataFrame) -> DataFrame:
    """``placed`` with ``begins``: the bytes of the file's earlier splits (null for a split that is not known). Runs a job.

    One row per split; broadcast only if there are few, and then as hashes of the path.
    """
    c = F.col
    sums = scanned.groupBy(F.xxhash64("path").alias("file"), c("split")).agg(F.sum(F.octet_length("value") + 1).cast("bigint").alias("_bytes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = session.cut_lineage(sums.select("file", "split", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0).cast("bigint")).alias("begins")))
    few = starts.limit(SMALL_SPLITS + 1).count() <= SMALL_SPLITS
    return placed.withColumn("file", F.xxhash64("path")).join(F.broadcast(starts) if few else starts, ["file", "split"], "left")


def read_text_lines(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """``read_lines`` with ``text`` in place of the raw bytes: valid UTF-8 without carriage returns at its end; blank lines go."""
    text = F.rtrim(F.make_valid_utf8("raw"), F.lit("\r"))
    return read_lines(spark, patterns).select("source_path", "byte_start", "byte_end", text.alias("text")).filter("text != ''")


def read_events(spark: SparkSession, patterns: list[str], positions: bool = False) -> DataFrame:
    """JSON objects, one per line, from several globs; each file is read once, and files split.

    Keeps the raw row, so unknown keys survive, and the path. With ``positions`` also the byte range of the row; an
    unfinished last line is then left for later.
    """
    if positions:
        rows = read_lines(spark, patterns)
    else:
        rows = _text(spark, patterns).select(F.col("value").alias("raw"), plain_path(F.col("_metadata.file_path")).alias("source_path"))
    rows = rows.filter(F.trim("raw") != "").withColumns({
        "is_object": is_json_object(F.col("raw")),
        "event": F.from_json("raw", EVENT_SCHEMA),
    })
    return rows.select(*[c for c in rows.columns if c != "event"], "event.*")


def is_json_object(row: Column) -> Column:
    """Well-formed JSON whose top level is an object."""
    return F.coalesce(F.try_parse_json(row).isNotNull() & row.rlike(r"^\s*\{"), F.lit(False))


def guard(df: DataFrame, path: str, row: str, limit: int = MAX_ROW_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows of clean files, and the rejected rows; one bad row withholds its whole file."""
    reason = (
        F.when(F.octet_length(row) > limit, "oversize")
        .when(F.try_parse_json(row).isNull(), "malformed")
        .when(~is_json_object(F.col(row)), "not an object")
    )
    marked = df.withColumn("reject_reason", reason)
    rejects = marked.filter(F.col("reject_reason").isNotNull())
    clean = df.join(rejects.select(path).distinct(), path, "left_anti")
    return clean, rejects


def read_raw_logs(spark: SparkSession, root: str, host: str = "UNKNOWN") -> DataFrame:
    """Lines of the agent, errors and gateway logs, rotated ones included, under a root and its profiles."""
    globs = [f"{root}/{sub}/{base}*" for base in P.LOG_KINDS for sub in ("logs", "profiles/*/logs")]
    named = read_text_lines(spark, _existing(spark, globs)).withColumn("source_name", F.substring_index("source_path", "/", -1))
    return named.withColumns({
        "kind": source_kind(F.col("source_name")), "profile": profile_of(F.col("source_path")), "host": F.lit(host),
    }).filter(F.col("kind") != "")


def _existing(spark: SparkSession, globs: list[str]) -> list[str]:
    """The globs that match something; Spark refuses to load an empty one."""
    from pyspark.errors import AnalysisException
    found = []
    for glob in globs:
        try:
            spark.read.format("binaryFile").load(glob)
            found.append(glob)
        except AnalysisException:
            continue
    return found


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return gate_journal(spark.read.schema(JOURNAL_SCHEMA).json(path))


def gate_journal(entries: DataFrame) -> DataFrame:
    """Warning and worse, each cursor once; entries without a cursor are dropped.

    Among repeats of a cursor the one with the least content wins, which makes
    the choice independent of arrival order.
    """
    passed = entries.filter(
        (text_functions.journal_priority(F.col("PRIORITY")) <= 4) & (F.coalesce("__CURSOR", F.lit("")) != ""))
    others = [c for c in passed.columns if c != "__CURSOR"]
    return passed.groupBy("__CURSOR").agg(F.min(F.struct(*others)).alias("_entry")).select("__CURSOR", "_entry.*")


def recent_journal(entries: DataFrame, now: Column, hours: int = 24, limit: int = 10_000) -> DataFrame:
    """Without a saved cursor: the first ``limit`` entries of the last hours, oldest first."""
    placed = entries.withColumn("event_ts", text_functions.journal_ts(F.col("__REALTIME_TIMESTAMP")))
    return placed.filter(F.col("event_ts") >= now - F.make_dt_interval(hours=F.lit(hours))).orderBy("event_ts", "__CURSOR").limit(limit)


def journal_profile() -> Column:
    named = F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in UNIT_FIELDS], F.lit("kernel-or-unknown"))
    return F.concat(F.lit("system:"), named)


def unify(logs: DataFrame, journal: DataFrame, limit: int = 800) -> DataFrame:
    """Log lines and journal entries as one record schema."""
    c = F.col
    message = F.coalesce(c("MESSAGE"), F.lit(""))
    records = journal.select(
        c("_HOSTNAME").alias("host"), journal_profile().alias("profile"),
        F.concat(F.lit("journald(p"), F.coalesce("PRIORITY", F.lit("?")), F.lit(")")).alias("file"),
        F.lit("journald").alias("source_type"), F.left(message, F.lit(limit)).alias("text"),
        (F.length(message) > limit).alias("text_truncated"), F.octet_length(message).cast("bigint").alias("original_text_bytes"),
        F.coalesce(text_functions.canonical_text(text_functions.journal_ts(c("__REALTIME_TIMESTAMP"))), F.lit("UNKNOWN")).alias("ts"),
        c("__CURSOR").alias("cursor"))
    captured = text_functions.capture(c("text"), limit)
    lines = logs.select(
        "host", "profile", c("source_name").alias("file"), F.lit("log").alias("source_type"),
        captured["text"].alias("text"), captured["text_truncated"].alias("text_truncated"),
        captured["original_text_bytes"].alias("original_text_bytes"),
        F.coalesce(text_functions.canonical_text(text_functions.leading_ts(c("text"))), F.lit("UNKNOWN")).alias("ts"),
        "source_path", "byte_start", "byte_end")
    return lines.unionByName(records, allowMissingColumns=True)


def changed_files(files: DataFrame, stamps: DataFrame) -> DataFrame:
    """Files whose (modified, size) differs from the recorded stamp, or that have none."""
    return files.join(stamps.select("path", "modified", "size"), ["path", "modified", "size"], "left_anti")
