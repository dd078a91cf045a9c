"""Small regex helpers over built-in expressions; an absent match is null, never ''.

A regular expression costs microseconds per line, a substring test a fraction
of that. Where a pattern cannot match without some plain words, the caller
passes a ``mentions`` test and the pattern only runs on lines that pass it.
"""
from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable
from functools import reduce, wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    """All non-empty matches in order; the group may be absent in some of them."""
    return F.array_remove(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), "")


def distinct(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(every(text, pattern, group))


def only(values: Column) -> Column:
    """The single element, or null when there are none or several."""
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def integer(text: Column) -> Column:
    return text.try_cast("bigint")


def mentions(text: Column, *words: str) -> Column:
    """Any of the words occurs as a substring."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def first_if(test: Column, text: Column, pattern: str, group: int = 0) -> Column:
    return F.when(test, first(text, pattern, group))


def every_if(test: Column, text: Column, pattern: str, group: int = 0) -> Column:
    return F.when(test, every(text, pattern, group)).otherwise(F.array().cast("array<string>"))


def has_if(test: Column, text: Column, pattern: str) -> Column:
    return F.coalesce(test & text.rlike(pattern), F.lit(False))


def listed(*items: Column) -> Column:
    """The non-null items as an array.

    For long lists of conditions this is on purpose a lambda-based expression:
    it is evaluated as an expression tree. As generated code the same list
    becomes one method too large for the JIT, which measured 30 times slower.
    """
    return F.array_compact(F.array(*items))


_BUILT: dict[tuple[Hashable, ...], Any] = {}


def once(build: Callable[..., Any]) -> Callable[..., Any]:
    """Keeps column definitions for the life of the application.

    Building thousands of Column objects takes seconds in Python; they are
    immutable, so a second use of the same definitions can share them.
    """
    @wraps(build)
    def kept(*args: Hashable) -> Any:
        key = (SparkSession.active().sparkContext.applicationId, build, *args)
        if key not in _BUILT:
            _BUILT[key] = build(*args)
        return _BUILT[key]
    return kept


Steps = list[dict[str, Column]]


def staged(df: DataFrame, *groups: Steps) -> DataFrame:
    """Applies groups of column definitions level by level, one projection per level.

    Level n of a group may use the columns of its earlier levels; merging the
    levels of independent groups keeps the number of row copies small.
    Columns starting with an underscore are dropped at the end.
    """
    for level in range(max(len(g) for g in groups)):
        df = df.withColumns({name: column for g in groups if level < len(g) for name, column in g[level].items()})
    helpers = {name for g in groups for step in g for name in step if name.startswith("_")}
    return df.drop(*helpers)


ASIDE = "_aside"


def aside(df: DataFrame, used: Iterable[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` over the columns that it reads; the others wait in one struct, which each of its projections copies in one piece.

    A column that ``step`` makes replaces one of that name among the others, as ``withColumns`` does.
    """
    wanted = set(used)
    kept = [n for n in df.columns if n not in wanted]
    if not kept:
        return step(df)
    done = step(df.select(F.struct(*[F.col(f"`{n}`") for n in kept]).alias(ASIDE), *[F.col(f"`{n}`") for n in df.columns if n in wanted]))
    made = [n for n in done.columns if n != ASIDE]
    taken = {n.lower() for n in made}
    return done.select(*[F.col(f"{ASIDE}.`{n}`").alias(n) for n in kept if n.lower() not in taken], *[F.col(f"`{n}`") for n in made])
