"""The chronological feed, event-time buckets and retention."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators import scan

FEED_TEXT = 300
FEED_HOURS = 144
RETENTION_HOURS = 72
MAX_STORE_BYTES = 250 * 1024 * 1024
FEED_FIELDS = ("component", "tool", "target", "operation", "provider", "model", "http_status", "exit_code", "errno", "signal")


def feed_rows(enriched: DataFrame) -> DataFrame:
    """Sparse feed rows: no ignored records, no continuations, nothing without a time. Needs event_at."""
    c = F.col
    severity = F.coalesce(c("severity.label"), F.lit("watch"))
    role = c("record_role") if "record_role" in enriched.columns else F.lit("")
    wanted = enriched.filter((severity != "ignore") & (F.coalesce(role, F.lit("")) != "continuation") & c("event_at").isNotNull())
    return wanted.select(
        c("event_at").alias("ts"), "host", "profile", F.coalesce("classification.domain", F.lit("system")).alias("domain"),
        F.coalesce("classification.kind", F.lit("incident")).alias("kind"), c("classification.event").alias("event"),
        c("classification.cause").alias("cause"), severity.alias("severity"), c("severity.rule_id").alias("severity_rule_id"),
        c("provenance.source_path").alias("source_path"), c("provenance.byte_start").alias("byte_start"),
        c("provenance.byte_end").alias("byte_end"), F.left("text", F.lit(FEED_TEXT)).alias("text"),
        *[c(f"classification.{f}").alias(f) for f in FEED_FIELDS],
        F.when(F.size("classification.exceptions") > 0, c("classification.exceptions")).alias("exceptions"))


def feed_tail(feed: DataFrame, order: list[str], row_bytes: Column, minutes: int | None = 60, since: Column | None = None,
              max_bytes: int = 500_000, now: Column | None = None) -> DataFrame:
    """The last rows within a byte budget that are after ``since`` or of the last minutes (before ``now``, or before
    the newest row).

    Newest first, both conditions cut a prefix, so the time filter goes first: it reaches the scan and prunes.
    """
    if since is not None:
        recent = feed.filter(F.col("ts") > since)
    elif minutes is None:
        recent = feed
    else:
        if now is None:
            now = F.lit(feed.agg(F.max("ts")).first()[0]).cast("timestamp")  # one value
        recent = feed.filter(F.col("ts") >= now - F.make_dt_interval(mins=F.lit(minutes)))
    used = scan.running_total(recent, [F.col(o).desc() for o in order], row_bytes.cast("bigint") + 1, "_used")
    return used.filter(F.col("_used") <= max_bytes).drop("_used")


def bucket(event_at: Column, zone: str = "UTC") -> dict[str, Column]:
    """Half-day bucket of local event time: day, and 00 or 12."""
    local = F.from_utc_timestamp(event_at, zone)
    return {"bucket_day": F.date_format(local, "yyyyMMdd"), "bucket_half": F.when(F.hour(local) < 12, "00").otherwise("12")}


def retention_plan(rows: DataFrame, size: str, now: Column, max_bytes: int = MAX_STORE_BYTES, hours: int = RETENTION_HOURS) -> DataFrame:
    """What to do per bucket: archive closed ones, split the straddling one, then displace the
    oldest closed buckets until the rest fits. Sums per bucket first; the running sum is over
    the few buckets that exist, not over rows.

    A day counts as closed at its end; the buckets of the day of ``now`` are active.
    """
    c = F.col
    horizon = now - F.make_dt_interval(hours=F.lit(hours))
    marked = rows.withColumn("_expired", c("event_at") < horizon)
    buckets = marked.groupBy("bucket_day", "bucket_half").agg(
        F.count("*").alias("rows"), F.count_if("_expired").alias("expired_rows"),
        F.sum(F.when(~c("_expired"), c(size)).otherwise(0)).alias("kept_bytes"))
    closing = F.to_timestamp("bucket_day", "yyyyMMdd") + F.make_dt_interval(days=F.lit(1))
    buckets = buckets.withColumns({
        "active": c("bucket_day") == F.date_format(now, "yyyyMMdd"),
        "closed_old": (c("bucket_day") != F.date_format(now, "yyyyMMdd")) & (closing <= horizon),
    })
    competing = ~c("active") & ~c("closed_old") & (c("rows") > c("expired_rows"))
    newest = Window.orderBy(c("bucket_day").desc(), c("bucket_half").desc()).rowsBetween(Window.unboundedPreceding, 0)
    weighed = buckets.withColumn("_used", F.sum(F.when(competing, c("kept_bytes")).otherwise(0)).over(newest))
    action = (
        F.when(c("closed_old"), "archive").when(competing & (c("_used") > max_bytes), "displace")
        .when(c("expired_rows") == c("rows"), "archive rows").when(c("expired_rows") > 0, "split").otherwise("keep")
    )
    return weighed.withColumn("action", action).drop("_used", "closed_old")


def rotate_feed(feed: DataFrame, now: Column, hours: int = FEED_HOURS) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): together every row, each in one of the two."""
    fresh = F.coalesce(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(hours)), F.lit(True))
    return feed.filter(fresh), feed.filter(~fresh)
