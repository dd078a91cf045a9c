"""URL filter: rules with a host and a path prefix, resolved by a sort-merge range join. DataFrame functions only.

A host is written label by label from the right, so a rule is a prefix of such a key and a prefix is an interval of
the sorted keys. A URL asks once per suffix of its host: a point. Points and interval ends are sorted together and
swept. Rules that nest form a stack: a running sum of starts and ends is its height, and the innermost active rule of
a point is the last one opened at that height. Partitions are swept on their own; height and stack at their start
come from one row per partition (and height).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import shared
from tracewell.operators.scan import global_order

BETWEEN = "#"  # in no host and no path
AFTER = b"\xff"  # greater than every byte of UTF-8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.encode(F.concat(F.array_join(labels, "."), F.lit(BETWEEN), path), "UTF-8")


def _innermost(marks: DataFrame) -> DataFrame:
    """Every mark with the innermost rule active at it in ``top`` (null: none)."""
    # equal keys may lie in several partitions: open intervals are carried, so no key needs a task of its own
    placed = global_order(marks, [F.col("key"), F.col("kind"), F.col("salt")])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = placed.groupBy("_pid").agg(F.sum("step").alias("_sum")).select(
        "_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    running = Window.partitionBy("_pid").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    level = (
        placed.join(F.broadcast(base), "_pid")
        .withColumn("_height", F.sum("step").over(running) + F.col("_base")).drop("_base")
    )
    opened = F.col("step") == 1
    inside = Window.partitionBy("_pid", "_height").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    swept = level.withColumn("_top", F.last(F.when(opened, F.col("rule")), ignorenulls=True).over(inside))
    # one row per partition and height: what the stack holds when a partition begins
    ends = level.groupBy("_pid", "_height").agg(F.max_by("rule", F.when(opened, F.col("_row"))).alias("_end"))
    earlier = Window.partitionBy("_height").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stack = ends.select("_pid", "_height", F.last("_end", ignorenulls=True).over(earlier).alias("_stack"))
    return swept.join(stack, ["_pid", "_height"], "left").withColumn(
        "top", F.when(F.col("_height") > 0, F.coalesce("_top", "_stack")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    ``rules`` has host, path and verdict (text). A rule fits its host and all subdomains if the URL's path starts with
    the rule's path; the longest ``host + path`` wins, then the longer host. Of equal rules the greatest verdict holds
    (block before allow). Rows without a fitting rule get rule null and verdict ``default``. A null URL, or one
    without ``://``, has an empty host and path; rules with a null host or verdict are left out, a null path is empty.
    Repeated rows stay; very long URLs are judged whole; empty tables of pages or rules give no rows or no fitting rule.
    Columns of ``pages`` with the names of the four results are replaced, all others are kept.
    """
    best = shared.free_name(pages.columns, "_best")
    named = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    distinct = named.select("host", "path").distinct()  # a URL that fills a third of the rows is asked once
    labels = F.split("host", r"\.")
    points = distinct.withColumn("_labels", _reversed(F.col("host"))).select(
        "host", "path", "_labels", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("_n")
    ).select(
        _key(F.slice("_labels", 1, F.col("_n")), F.col("path")).alias("key"), F.lit(1).alias("kind"),
        F.xxhash64("host", "path").alias("salt"), F.lit(0).alias("step"),
        F.lit(None).cast("struct<size:int,wide:int,rule:string,verdict:string>").alias("rule"), "host", "path")
    whole = F.concat("host", "path")
    kept = (
        rules.where("host is not null and verdict is not null")
        .select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select(
            _key(_reversed(F.col("host")), F.col("path")).alias("key"),
            F.struct(F.length(whole).alias("size"), F.length("host").alias("wide"), whole.alias("rule"), "verdict").alias("rule"))
    )
    nothing = F.lit(None).cast("string")
    starts = kept.select("key", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("salt"), F.lit(1).alias("step"), "rule",
                         nothing.alias("host"), nothing.alias("path"))
    stops = kept.select(F.concat("key", F.lit(AFTER)).alias("key"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("salt"),
                        F.lit(-1).alias("step"), "rule", nothing.alias("host"), nothing.alias("path"))
    longest = (
        _innermost(points.unionByName(starts).unionByName(stops)).where("step = 0 and top is not null")
        .groupBy("host", "path").agg(F.max("top").alias(best))
    )
    return named.join(longest, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in named.columns], F.col(best)["rule"].alias("rule"),
        F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"))
