"""From raw lines to records: level context, roles, folding, incremental intake."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import regex as rx
from tracewell.functions import text as T
from tracewell.operators import scan

FOLD_LIMIT = 8000
LINE_LIMIT = 800


def source_kind(name: Column) -> Column:
    """Base kind of a rotated log name; '' when it is none of the known kinds."""
    return F.coalesce(*[
        F.when((name == base) | name.startswith(base + ".") | name.startswith(base + "-"), F.lit(base)) for base in P.LOG_KINDS
    ], F.lit(""))


def profile_of(path: Column) -> Column:
    """profiles/<name>/logs/<file> gives the name, anything else 'default'."""
    return F.coalesce(rx.first(path, r"/profiles/([^/]+)/logs/[^/]+\z", 1), F.lit("default"))


def with_chunks(df: DataFrame, chunk_bytes: int) -> DataFrame:
    return df.withColumn("_chunk", scan.chunk_of(F.col("byte_start"), chunk_bytes))


def keep_lines(df: DataFrame, chunk_bytes: int = scan.CHUNK_BYTES) -> DataFrame:
    """Adds ``keep``: error logs keep every nonblank line; the others keep warnings and
    worse, and unlevelled lines follow the last decision in the same file."""
    text = F.col("text")
    level = F.upper(rx.first(text, P.LEVEL_GATE, 1))
    decision = F.when(level.isNotNull(), level.isin(*P.KEPT_LEVELS)).when(T.is_context_line(text), F.lit(True))
    scanned = scan.carry_last(with_chunks(df, chunk_bytes), ["source_path"], "_chunk", "byte_start", decision, "_context")
    errors = source_kind(F.col("source_name")) == "errors.log"
    return scanned.withColumn("keep", F.when(errors, text != "").otherwise(
        F.coalesce("_context", F.lit(False)))).drop("_context", "_chunk")


def stage_lines(df: DataFrame, now: Column, initial: bool = True, hours: int = 72,
                chunk_bytes: int = scan.CHUNK_BYTES) -> DataFrame:
    """Adds role, event_ts, timestamp_basis, parent_start and dropped (reason) to lines with ``keep``.

    A kept line without a timestamp that looks like a continuation attaches to
    the record open in its file; a dropped line closes that record.
    """
    c = F.col
    staged = df.withColumn("_instant", T.leading_ts(c("text"))).withColumns({
        "_status": T.leading_status(c("text"), c("_instant")),
    }).withColumns({
        "_child": (c("_status") != "ok") & T.is_context_line(c("text")),
        "_fresh": T.is_fresh(c("_instant"), now, hours),
    })
    accepted = c("_fresh") if initial else c("_fresh") | (c("_status") != "ok")
    head = c("keep") & ~c("_child") & accepted
    head_ts = F.coalesce(c("_instant"), now)
    opened = F.struct(c("byte_start").alias("start"), head_ts.alias("ts"))
    closed = F.struct(F.lit(-1).cast("bigint").alias("start"), F.lit(None).cast("timestamp").alias("ts"))
    marker = F.when(head, opened).when(~c("keep") | ~c("_child"), closed)
    scanned = scan.carry_last(with_chunks(staged, chunk_bytes), ["source_path"], "_chunk", "byte_start", marker, "_open")
    child = c("keep") & c("_child")
    attached = child & (F.coalesce(c("_open.start"), F.lit(-1)) >= 0)
    return scanned.withColumns({
        "role": F.when(head & (c("_status") == "ok"), "parent").when(head, "standalone").when(attached, "continuation"),
        "parent_start": F.when(head | attached, c("_open.start")),
        "event_ts": F.when(head, head_ts).when(attached, c("_open.ts")),
        "timestamp_basis": F.when(head & (c("_status") == "ok"), "text").when(head, "new_append").when(attached, "inherited"),
        "dropped": F.when(~c("keep"), "filtered").when(head | attached, None)
        .when(child, "missing").when(c("_status") == "ok", "old").otherwise(c("_status")),
    }).drop("_instant", "_status", "_child", "_fresh", "_open", "_chunk")


def fold(staged: DataFrame, limit: int = FOLD_LIMIT, chunk_bytes: int = scan.CHUNK_BYTES, line_limit: int | None = LINE_LIMIT) -> DataFrame:
    """One row per record: its text joined with its continuation lines, cut at ``limit`` characters.

    Each line counts with its first ``line_limit`` characters (None: whole), as captured; byte counts stay whole.
    ``text_truncated`` tells of the join, and of the line itself for a record of one line.

    Lines are joined per chunk first and cut there: the beginning of a joined
    text only depends on the beginnings of its parts. Parts that start beyond
    the limit are never collected, so a record of any length stays small.
    """
    c = F.col
    lines = with_chunks(staged.filter(c("role").isNotNull()), chunk_bytes).withColumn("_clipped", F.lit(False))
    if line_limit is not None:
        lines = lines.withColumns({"_clipped": F.length("text") > line_limit, "text": F.left("text", F.lit(line_limit))})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("byte_start", "text"))), lambda x: x["text"])
    parts = lines.groupBy("source_path", "parent_start", "_chunk").agg(
        F.left(F.array_join(ordered, "\n"), F.lit(limit)).alias("_part"),
        (F.sum(F.length("text") + 1) - 1).alias("_length"),
        F.sum(c("byte_end") - c("byte_start")).alias("_bytes"),
        F.max("byte_end").alias("_end"), F.count("*").alias("_lines"), F.max("_clipped").alias("_clipped"),
        F.max(F.when(c("role") != "continuation", F.struct("role", "event_ts", "timestamp_basis", "line_id"))).alias("_head"),
    )
    earlier = Window.partitionBy("source_path", "parent_start").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    begun = parts.withColumn("_before", F.coalesce(F.sum(c("_length") + 1).over(earlier), F.lit(0)))
    wanted = F.collect_list(F.when(c("_before") < limit, F.struct("_chunk", "_part")))
    return begun.groupBy("source_path", "parent_start").agg(
        F.left(F.array_join(F.transform(F.array_sort(wanted), lambda x: x["_part"]), "\n"), F.lit(limit)).alias("text"),
        F.when(F.sum("_lines") == 1, F.max("_clipped")).otherwise(F.sum(c("_length") + 1) - 1 > limit).alias("text_truncated"),
        F.sum("_bytes").alias("original_text_bytes"), F.max("_end").alias("byte_end"),
        (F.sum("_lines") - 1).alias("children"), F.max("_head").alias("_head"),
    ).select("source_path", c("parent_start").alias("byte_start"), "byte_end", "text", "text_truncated",
             "original_text_bytes", "children", "_head.*")


def split_at_first_bad(df: DataFrame, path: str, position: str, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Per file: rows before the first bad one are good; that row is reported; later ones wait."""
    firsts = df.groupBy(path).agg(F.min(F.when(bad, F.col(position))).alias("_first_bad"))
    marked = df.join(firsts, path)
    good = marked.filter(F.col("_first_bad").isNull() | (F.col(position) < F.col("_first_bad")))
    errors = marked.filter(F.col(position) == F.col("_first_bad"))
    return good.drop("_first_bad"), errors.drop("_first_bad")


def run_counters(staged: DataFrame) -> DataFrame:
    """Counts by outcome, in one row."""
    def count(test: Column) -> Column:
        return F.count_if(F.coalesce(test, F.lit(False)))
    c = F.col
    return staged.agg(
        count(c("role") == "parent").alias("kept"), count(c("role") == "standalone").alias("new_append"),
        count(c("role") == "continuation").alias("inherited"), count(c("dropped") == "old").alias("dropped_old"),
        count(c("dropped") == "missing").alias("dropped_missing"), count(c("dropped") == "malformed").alias("dropped_malformed"),
        count(c("dropped") == "filtered").alias("filtered"))
