"""Column expressions over raw log text: prefix, timestamps, redaction, templates."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import regex as rx


# --- prefix -----------------------------------------------------------------
def log_level(text: Column) -> Column:
    return rx.first(text, P.PREFIX, 2)


def parse_prefix(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds text_stamp, log_level, session, component, body, body_lower and text_lower.

    A levelled prefix wins; otherwise a bare logger name counts as component
    unless it is really an exception name, and the body is what follows.
    """
    line = F.col(text)
    staged = df.withColumns({
        "log_level": log_level(line),
        "_logger": F.when(~rx.has(line, P.PREFIX), rx.first(line, P.LOGGER, 1)),
    })
    levelled = F.col("log_level").isNotNull()
    named = F.col("_logger").isNotNull() & ~rx.has(F.col("_logger"), P.LOGGER_IS_EXCEPTION)
    return staged.withColumns({
        "text_stamp": F.when(levelled, rx.first(line, P.PREFIX, 1)),
        "session": F.when(levelled, rx.first(line, P.PREFIX, 3)),
        "component": F.when(levelled, rx.first(line, P.PREFIX, 4)).when(named, F.col("_logger")),
        "body": F.when(levelled, F.regexp_replace(line, P.PREFIX, ""))
        .when(named, F.regexp_replace(line, P.LOGGER, ""))
        .otherwise(line),
    }).drop("_logger").withColumns({"body_lower": F.lower("body"), "text_lower": F.lower(line)})


def is_continuation(text: Column) -> Column:
    """Traceback frame or code line; a line with a level is always a record of its own."""
    return ~rx.has(text, P.PREFIX) & (rx.has(text, P.FRAME) | rx.has(text, P.CODE_LINE))


def is_context_line(text: Column) -> Column:
    return rx.has(text, P.CONTEXT_LINE)


# --- timestamps -------------------------------------------------------------
def _offset_seconds(offset: Column) -> Column:
    digits = F.regexp_replace(offset, "[^0-9]", "")
    seconds = F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60
    return F.when(offset == "Z", 0).when(offset.startswith("-"), -seconds).otherwise(seconds)


def _instant(text: Column, pattern: str, zone: str) -> Column:
    """UTC instant of the matched parts; naive values are read in ``zone``; bad dates are null."""
    naive = F.try_to_timestamp(
        F.concat_ws(" ", rx.first(text, pattern, 1), rx.first(text, pattern, 2)), F.lit("yyyy-MM-dd HH:mm:ss"))
    offset = rx.first(text, pattern, 3)
    shifted = F.timestamp_seconds(F.unix_timestamp(naive) - _offset_seconds(offset))
    return F.when(offset.isNull(), F.to_utc_timestamp(naive, zone)).otherwise(shifted)


def leading_ts(text: Column, zone: str = "UTC") -> Column:
    return F.when(rx.has(text, P.LEADING_PARTS), _instant(text, P.LEADING_PARTS, zone))


def leading_status(text: Column, instant: Column) -> Column:
    """ok, malformed (bad calendar value, or a timestamp later in the line), or missing."""
    return (
        F.when(instant.isNotNull(), "ok")
        .when(rx.has(text, P.ANY_STAMP), "malformed")
        .otherwise("missing")
    )


def parse_instant(text: Column, zone: str = "UTC") -> Column:
    """Any ISO instant to UTC; naive values are read in ``zone``."""
    return _instant(text, P.ISO_INSTANT, zone)


def canonical_text(instant: Column, zone: str = "UTC") -> Column:
    """Seconds-precision ISO text in ``zone``, with Z for a zero offset."""
    local = F.from_utc_timestamp(instant, zone)
    offset = F.unix_timestamp(local) - F.unix_timestamp(instant)
    size = F.abs(offset)
    suffix = F.when(offset == 0, "Z").otherwise(F.concat(
        F.when(offset < 0, "-").otherwise("+"),
        F.lpad(F.floor(size / 3600).cast("string"), 2, "0"), F.lit(":"),
        F.lpad(F.floor(size % 3600 / 60).cast("string"), 2, "0")))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), suffix)


def journal_ts(micros: Column) -> Column:
    return F.timestamp_micros(micros.try_cast("bigint"))


def journal_status(micros: Column) -> Column:
    return (
        F.when(micros.isNull() | (micros == ""), "missing")
        .when(micros.try_cast("bigint").isNull(), "malformed")
        .otherwise("ok")
    )


def event_time(text: Column, stored: Column) -> dict[str, Column]:
    """Event time as written in the text, else the stored one, with basis and certainty."""
    stamp = rx.first(text, P.TEXT_STAMP)
    kept = F.when(stored != "UNKNOWN", stored)
    return {
        "event_ts": F.coalesce(F.translate(stamp, " ,", "T."), kept),
        "event_ts_basis": F.when(stamp.isNotNull(), "text").when(kept.isNotNull(), "stored_unverified"),
        "event_ts_certainty": F.when(stamp.isNotNull(), "explicit").when(kept.isNotNull(), "derived"),
    }


def is_fresh(instant: Column, now: Column, hours: int = 72) -> Column:
    """Within [now - hours, now], inclusive at both ends; null is not fresh."""
    horizon = now - F.make_dt_interval(hours=F.lit(hours))
    return F.coalesce(instant.between(horizon, now), F.lit(False))


def journal_priority(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(99))


# --- redaction and templates ------------------------------------------------
def _replace_all(text: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, step: F.regexp_replace(t, step[0], step[1]), steps, text)


REDACTIONS = [(p, "<REDACTED>") for p in P.SECRETS]


def redact(text: Column) -> Column:
    """Hides credentials; a key=value secret keeps its key."""
    return _replace_all(text, [*REDACTIONS, (P.KEYED_SECRET, "$1=<REDACTED>")])


SECRET_WORDS = ("sk-", "gh", "xox", "bearer", "key", "token", "secret", "password")


def redact_guarded(text: Column, lowered: Column) -> Column:
    """Same as ``redact``, skipping texts that mention nothing secret."""
    return F.when(rx.mentions(lowered, *SECRET_WORDS), redact(text)).otherwise(text)


# Ordered: later steps see the output of earlier ones.
TEMPLATE_STEPS = [
    (P.SCHEDULED_RUN, "[$1_<RUN>]"),
    (P.COOLDOWN_EXPIRY, "$1<TIME>"),
    (P.SESSION_TAG, "[<SESSION_ID>]"),
    (P.SESSION_KEY, "$1=<ID>"),
    (P.UUID, "<UUID>"),
    (P.LONG_HEX, "<HEX>"),
    (P.ISO_ANYWHERE, "<TIMESTAMP>"),
    (P.SYSLOG_STAMP, "<TIMESTAMP>"),
    (P.DURATION, "<DURATION>"),
    (P.TOKEN_COUNT, "<TOKENS>"),
    (P.CHAR_COUNT, "<CHARS>"),
    (P.PROCESS_ID, "$1<PID>"),
]
# Any text may hold these; the other later steps need one of the words or forms in ``_rare``.
COMMON_STEPS = [(P.LONG_HEX, "<HEX>"), (P.DURATION, "<DURATION>")]
RARE_WORDS = ("token", "char", "pid", "process id", "processid")
RARE_FORMS = "[0-9]:[0-9]|[0-9a-fA-F]-[0-9a-fA-F]{4}-"
# Without it every run of white space is one blank already.
NOT_ONE_SPACE = r"[\t\n\x0B\f\r]|  "
DROP_PATHS = [(P.WINDOWS_PATH, ""), (P.POSIX_PATH, "$1")]
SHORTEN_PATHS = [(P.WINDOWS_DIRECTORY, "$1"), (P.POSIX_DIRECTORY, "$1$2")]


def _rare(text: Column, lowered: Column) -> Column:
    """Whether a later template step beside COMMON_STEPS can match: tests that each of them implies.

    No step removes characters without a mark in angle brackets, so what the text does not mention before them
    it does not mention between them.
    """
    keyed = lowered.contains("id") & rx.mentions(lowered, "session", "conversation", "trace", "span", "request", "run")
    return keyed | rx.mentions(lowered, *RARE_WORDS) | text.rlike(RARE_FORMS)


@rx.once
def _template() -> rx.Steps:
    """From _text and _is_system to _template; every step only runs on lines that mention what it looks for."""
    c = F.col

    def when_mentions(source: str, words: tuple[str, ...], steps: list[tuple[str, str]]) -> Column:
        return F.when(rx.mentions(c(source), *words), _replace_all(c(source), steps)).otherwise(c(source))

    restored = F.array_join(
        F.zip_with(F.split("_plain", P.URL_MARK, -1), "_urls", lambda part, url: F.concat(
            F.coalesce(part, F.lit("")), F.coalesce(url, F.lit("")))), "")
    with_urls = F.when(F.size("_urls") > 0, restored).otherwise(c("_plain"))
    return [
        {"_lower": F.lower("_text")},
        {"_safe": redact_guarded(c("_text"), c("_lower"))},
        {"_urls": rx.every_if(c("_safe").contains("://"), c("_safe"), P.URL),
         "_plain": when_mentions("_safe", ("://",), [(P.URL, P.URL_MARK)])},
        {"_plain": F.regexp_replace("_plain", P.LEADING_STAMP, "")},
        {"_plain": when_mentions("_plain", ('File "',), [(P.FRAME_REFERENCE, 'File "<F>", line')])},
        {"_plain": F.when(~rx.mentions(c("_plain"), "/", "\\"), c("_plain"))
         .when(c("_is_system"), _replace_all(c("_plain"), SHORTEN_PATHS))
         .otherwise(_replace_all(c("_plain"), DROP_PATHS))},
        {"_plain": when_mentions("_plain", ("[", "Subsequent"), TEMPLATE_STEPS[:3])},
        {"_low": F.lower("_plain")},
        {"_plain": F.when(~c("_plain").rlike("[0-9]|[iI][dD]"), c("_plain"))
         .when(_rare(c("_plain"), c("_low")), _replace_all(c("_plain"), TEMPLATE_STEPS[3:]))
         .otherwise(_replace_all(c("_plain"), COMMON_STEPS))},
        {"_plain": with_urls},
        {"normalized_text": F.trim(F.when(c("_plain").rlike(NOT_ONE_SPACE), F.regexp_replace("_plain", r"\s+", " ")).otherwise(c("_plain")))},
    ]


def add_template(df: DataFrame, text: Column, is_system: Column) -> DataFrame:
    """Adds normalized_text, the message template: volatile parts become placeholders, URLs stay as written.

    Paths are dropped for application records and cut to their base name for
    system records.
    """
    # the other columns wait in one struct: each step would copy them one by one
    kept = [F.col(f"`{n}`") for n in df.columns if n != "normalized_text"]
    given = df.select(F.struct(*kept).alias("_row"), F.coalesce(text, F.lit("")).alias("_text"), is_system.alias("_is_system"))
    return rx.staged(given, _template()).select("_row.*", "normalized_text")


def resources(text: Column) -> Column:
    """Sorted distinct absolute paths, after removing traceback frames and secrets."""
    changed = _replace_all(text, [(P.FRAME_REFERENCE, ""), *REDACTIONS, (P.KEYED_SECRET, "<REDACTED>")])
    clean = F.when(rx.mentions(F.lower(text), 'file "', *SECRET_WORDS), changed).otherwise(text)

    def paths(t: Column) -> Column:
        both = F.concat(rx.every_if(t.contains(":\\"), t, P.WINDOWS_PATH), rx.every_if(t.contains("/"), t, P.POSIX_PATH, 2))
        return F.array_sort(F.array_distinct(both))

    found = F.element_at(F.transform(F.array(clean), paths), 1)  # the cleaned text is made once
    return F.when(rx.mentions(text, "/", "\\"), found).otherwise(F.array().cast("array<string>"))


def canonical_host(host: Column, aliases: dict[str, str] | None = None) -> Column:
    """Alias lookup ignoring case; unknown names are kept trimmed, empty ones become UNKNOWN."""
    name = F.trim(host)
    known = name
    if aliases:
        table = F.create_map(*[F.lit(v) for pair in aliases.items() for v in pair])
        known = F.coalesce(F.try_element_at(table, F.lower(name)), name)
    return F.when(host.isNull() | (host == ""), "UNKNOWN").otherwise(known)


def clip(text: Column, size: int) -> dict[str, Column]:
    return {"sample": F.left(text, F.lit(size)), "sample_truncated": F.coalesce(F.length(text) > size, F.lit(False))}


def capture(text: Column, size: int = 800) -> dict[str, Column]:
    """What the tail keeps of a line: clipped text, flags, and the identity of the full line."""
    return {
        "text_truncated": F.length(text) > size,
        "original_text_bytes": F.octet_length(text).cast("bigint") + 1,
        "content_hash": F.sha2(text, 256),
        "text": F.left(text, F.lit(size)),
    }
