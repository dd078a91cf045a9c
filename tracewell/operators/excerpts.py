"""Bounded excerpts of the source files evidence points into."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.sources import ranges

FIRST_LINE_BYTES = 128 * 1024 + 1
MAX_EXCERPT = 128 * 1024


def _clipped(text: Column, size: int) -> Column:
    """The first ``size`` bytes of a text; a character cut in two becomes the replacement character."""
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), F.lit(1), F.lit(size)).cast("string"))


def excerpt(evidence: DataFrame, max_bytes: int = 8192) -> DataFrame:
    """Adds excerpt, excerpt_status, excerpt_truncated and verified to evidence.

    Needs id, source_path, byte_start, byte_end, text, cursor, boot_id, and the identity kept at capture: content_hash (of the
    first line), inode and dev; nulls were not kept. ``verified`` is null if nothing was. Only the files that evidence
    points into are opened, and only its bytes are fetched (see ``ranges``): nothing is listed or scanned.
    """
    if not 1 <= max_bytes <= MAX_EXCERPT:
        raise ValueError("the excerpt budget must be 1 to 131072 bytes")
    c = F.col
    span = F.when(c("byte_end") > c("byte_start"), c("byte_end") - c("byte_start")).otherwise(max_bytes)
    journal = (c("source_path") == "journald") | c("cursor").isNotNull() | c("boot_id").isNotNull()
    asked = evidence.filter(~F.coalesce(journal, F.lit(False)) & (F.coalesce("source_path", F.lit("")) != "")).select(
        c("id").cast("string").alias("id"), c("source_path").alias("path"), "byte_start", F.least(span, F.lit(max_bytes)).cast("bigint").alias("wanted"),
        c("content_hash").isNotNull().alias("hashed"))
    found = ranges.read_records(asked, FIRST_LINE_BYTES).select(
        c("id").alias("_id"), c("size").alias("_size"), c("inode").alias("_inode"), c("dev").alias("_dev"), c("first_line_hash").alias("_hash"),
        c("data").alias("_data"), c("readable").alias("_readable"))
    joined = evidence.join(found, c("id").cast("string") == c("_id"), "left")
    kept = c("content_hash").isNotNull() | c("inode").isNotNull() | c("dev").isNotNull()
    same_file = c("_inode").eqNullSafe(c("inode")) & c("_dev").eqNullSafe(c("dev"))
    # a store without inodes cannot disprove one
    same_file = F.when(c("inode").isNull() & c("dev").isNull(), True).when(c("_size").isNotNull() & c("_inode").isNull(), True).otherwise(same_file)
    holds = c("_size").isNotNull() & (c("content_hash").isNull() | F.coalesce(c("_hash") == c("content_hash"), F.lit(False))) & same_file
    staged = joined.withColumn("verified", F.when(kept & ~F.coalesce(journal, F.lit(False)), F.coalesce(holds, F.lit(False))))
    status = (
        F.when(journal, F.when(c("cursor").isNotNull() | c("boot_id").isNotNull(), "journald_entry").otherwise("journald_unretained"))
        .when(~F.coalesce("verified", F.lit(True)), "rotated_or_truncated")
        .when(~F.coalesce("_readable", F.lit(True)), "source_file_inaccessible")
        .when(c("_size").isNull(), "source_file_missing")
        .when(c("byte_start") > c("_size"), "rotated_or_truncated")
        .otherwise("exact_source")
    )
    exact = c("excerpt_status") == "exact_source"
    return staged.withColumn("excerpt_status", status).withColumns({
        "excerpt": F.when(exact, F.make_valid_utf8(c("_data").cast("string"))).otherwise(_clipped(c("text"), max_bytes)),
        "excerpt_truncated": F.when(exact, span > max_bytes).otherwise(F.octet_length("text") > max_bytes),
    }).drop("_id", "_size", "_inode", "_dev", "_hash", "_data", "_readable")
