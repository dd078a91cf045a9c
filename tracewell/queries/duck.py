"""Pieces of DuckDB SQL used by the oracles."""
from __future__ import annotations

from tracewell import patterns as P
from tracewell.queries.adapters import LINES_CTE, NOW


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def has(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, {q(pattern)}), false)"


def first(col: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({col}, {q(pattern)}, {group}), '')"


def every(col: str, pattern: str, group: int = 0) -> str:
    return f"list_filter(regexp_extract_all({col}, {q(pattern)}, {group}), lambda m: m <> '')"


def distinct(items: str) -> str:
    """Distinct elements in order of first appearance."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def only(items: str) -> str:
    return f"CASE WHEN len({items}) = 1 THEN {items}[1] END"


def sub(col: str, pattern: str, replacement: str) -> str:
    for n in (1, 2):
        replacement = replacement.replace(f"${n}", f"\\{n}")
    return f"regexp_replace({col}, {q(pattern)}, {q(replacement)}, 'g')"


def subs(col: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        col = sub(col, pattern, replacement)
    return col


def compact(items: list[str]) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def join(items: str, sep: str = "|") -> str:
    return f"array_to_string({items}, {q(sep)})"


def packed(*parts: str) -> str:
    """Same length-prefixed packing as the identity functions."""
    one = [f"coalesce(length(CAST({p} AS STRING)) || ':' || CAST({p} AS STRING), '-')" for p in parts]
    return " || ',' || ".join(one)


def digest(*parts: str) -> str:
    return f"sha256({packed(*parts)})"


def packed_list(items: str) -> str:
    return f"array_to_string(list_concat([CAST(len({items}) AS STRING)], {items}), chr(30))"


def iso(ts: str) -> str:
    """Instant as canonical UTC text."""
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"


NOW_TS = f"TIMESTAMP '{NOW}'"


def instant(col: str, pattern: str) -> str:
    naive = f"try_strptime({first(col, pattern, 1)} || ' ' || {first(col, pattern, 2)}, '%Y-%m-%d %H:%M:%S')"
    off = first(col, pattern, 3)
    digits = f"regexp_replace({off}, '[^0-9]', '', 'g')"
    secs = f"(CAST(substr({digits}, 1, 2) AS INT) * 3600 + CAST(substr({digits}, 3, 2) AS INT) * 60)"
    shift = f"CASE WHEN {off} IS NULL OR {off} = 'Z' THEN 0 WHEN {off} LIKE '-%' THEN {secs} ELSE -{secs} END"
    return f"({naive} + to_seconds({shift}))"


def with_lines(select: str, *ctes: str) -> str:
    return "WITH " + ", ".join([LINES_CTE, *ctes]) + " " + select


# parsed: prefix columns and body of every line
PARSED = f"""parsed AS (
  SELECT *,
    {first('text', P.PREFIX, 2)} AS log_level,
    CASE WHEN {first('text', P.PREFIX, 2)} IS NOT NULL THEN {first('text', P.PREFIX, 1)} END AS text_stamp,
    CASE WHEN {first('text', P.PREFIX, 2)} IS NOT NULL THEN {first('text', P.PREFIX, 3)} END AS session,
    CASE WHEN {first('text', P.PREFIX, 2)} IS NOT NULL THEN {first('text', P.PREFIX, 4)}
         WHEN NOT {has(first('text', P.LOGGER, 1), P.LOGGER_IS_EXCEPTION)} THEN {first('text', P.LOGGER, 1)} END AS component,
    CASE WHEN {first('text', P.PREFIX, 2)} IS NOT NULL THEN regexp_replace(text, {q(P.PREFIX)}, '')
         WHEN {has('text', P.LOGGER)} AND NOT {has(first('text', P.LOGGER, 1), P.LOGGER_IS_EXCEPTION)} THEN regexp_replace(text, {q(P.LOGGER)}, '')
         ELSE text END AS body
  FROM lines)"""
