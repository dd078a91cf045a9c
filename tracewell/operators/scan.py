"""Ordered scans that never put a whole file, or the whole table, into one task.

A plain window over a file sorts that file in one task, and one file may hold
a third of all rows. Here rows are windowed per chunk of bounded size; what a
chunk passes on to the next is carried through a table with one row per chunk.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

CHUNK_BYTES = 64 << 20


def chunk_of(position: Column, size: int = CHUNK_BYTES) -> Column:
    return F.floor(position / size).cast("bigint")


def carry_last(df: DataFrame, keys: list[str], chunk: str, order: str, value: Column, out: str) -> DataFrame:
    """Adds the last non-null ``value`` at or before each row, in ``order`` within ``keys``."""
    staged = df.withColumn("_value", value)
    inside = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    scanned = staged.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    ends = staged.groupBy(*keys, chunk).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, chunk, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    return (
        scanned.join(carried, [*keys, chunk], "left")
        .withColumn(out, F.coalesce("_local", "_carry")).drop("_value", "_local", "_carry")
    )


def running_min(df: DataFrame, keys: list[str], order: str, value: Column, out: str, chunk_size: int) -> DataFrame:
    """Adds the least non-null ``value`` over rows with an equal or greater ``order`` (a whole number)."""
    staged = df.withColumns({"_value": value, "_chunk": F.floor(F.col(order) / chunk_size).cast("bigint")})
    inside = Window.partitionBy(*keys, "_chunk").orderBy(F.col(order).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = staged.groupBy(*keys, "_chunk").agg(F.min("_value").alias("_end"))
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_chunk", F.min("_end").over(later).alias("_carry"))
    return (
        staged.withColumn("_local", F.min("_value").over(inside)).join(carried, [*keys, "_chunk"], "left")
        .withColumn(out, F.least("_local", "_carry")).drop("_value", "_chunk", "_local", "_carry")
    )


def global_order(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Adds _pid and _row: a global sort, fixed by a checkpoint, with positions inside each partition.

    Sorted range partitions keep any one task bounded; the checkpoint makes
    the partition boundaries the same for every later use. Runs a job.
    """
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    fixed = cut_lineage(spread.sortWithinPartitions(*order))
    identifier = F.monotonically_increasing_id()
    return fixed.withColumn("_id", identifier).withColumns({
        "_pid": F.shiftright("_id", 33),
        "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
    }).drop("_id")


def running_total(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Sum of ``value`` (a whole number) up to each row in a global order, from per-partition sums. Runs a job."""
    placed = global_order(df.withColumn("_value", value.cast("bigint")), order)
    sums = placed.groupBy("_pid").agg(F.sum("_value").alias("_sum"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sums.select("_pid", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_pid").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.join(F.broadcast(offsets), "_pid").withColumn(out, F.col("_offset") + F.sum("_value").over(inside))
    return summed.drop("_pid", "_row", "_value", "_offset")


def global_position(df: DataFrame, order: list[Column], out: str = "position", partitions: int | None = None) -> DataFrame:
    """1-based row number in a global order, from per-partition counts instead of one big window."""
    placed = global_order(df, order, partitions)
    counts = placed.groupBy("_pid").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_pid").withColumn(
        out, F.col("_offset") + F.col("_row") + 1).drop("_pid", "_row", "_offset")


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "left") -> DataFrame:
    """Joins a table in which one key may hold a third of all rows with one that has at most one row per key.

    Left rows of a key are dealt over ``salts`` tasks by their content; right rows are repeated that often.
    """
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
