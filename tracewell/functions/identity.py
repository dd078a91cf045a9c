"""Stable identities. Each digest is over length-prefixed parts, so it is injective."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(*parts: Column) -> Column:
    """length:value of each part, '-' for null, joined with commas."""
    def one(part: Column) -> Column:
        text = part.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.concat_ws(",", *[one(p) for p in parts])


def packed_columns(names: tuple[str, ...] | list[str]) -> Column:
    """``packed`` of plain columns, as one parsed expression."""
    return F.expr("concat_ws(',', " + ", ".join(
        f"coalesce(concat(length(CAST({n} AS string)), ':', CAST({n} AS string)), '-')" for n in names) + ")")


def packed_list(values: Column) -> Column:
    """Number of elements, then the elements with a separator that no label or path contains."""
    return F.concat_ws("\x1e", F.size(values).cast("string"), values)


def digest(*parts: Column) -> Column:
    return F.sha2(packed(*parts), 256)


def record_id(path: Column, start: Column, end: Column, text: Column, cursor: Column, ts: Column) -> Column:
    return digest(F.coalesce(path, F.lit("journald")), start, end, text, cursor, ts)


def evidence_id(host: Column, profile: Column, path: Column, record: Column, start: Column, end: Column, cursor: Column, ts: Column, text: Column,
                kept: tuple[Column, ...] = ()) -> Column:
    """Identity of a stored record. ``kept``: inode, device and content hash of the file at capture, where they were kept: the
    same text at the same place of a replaced file is other evidence, and ids of records without them do not change."""
    return digest(host, profile, path, record, start, end, cursor, ts, text, *kept)


def finding_id(fingerprint: Column, severity: Column) -> Column:
    return F.left(digest(fingerprint, severity), F.lit(20))


def event_key(host: Column, profile: Column, event: Column, cause: Column, path: Column, start: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in (host, profile, event, cause, path, start)])


def source_pointer(path: Column, start: Column, end: Column) -> Column:
    """path:start-end, or the bare path when a bound is unknown."""
    return F.when(start.isNull() | end.isNull(), path).otherwise(
        F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def notice_key(message: Column) -> Column:
    return F.sha2(message, 256)


def mechanism_key(event: Column, cause: Column, component: Column) -> Column:
    """Some causes repeat across layers and profiles; they are one mechanism by cause alone."""
    alone = F.coalesce(cause.isin("missing_access", "websocket_unhealthy", "adapter_error"), F.lit(False))
    return F.struct(
        F.when(~alone, event).alias("event"), cause.alias("cause"), F.when(~alone, component).alias("component"))
