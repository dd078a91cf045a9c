"""Severity policy: an ordered JSON rule list turned into one CASE expression."""
from __future__ import annotations

import json
from functools import reduce
from importlib import resources
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LABELS = ("ignore", "watch", "needs-attention")


def load(path: str | None = None, basic: bool = False) -> dict[str, Any]:
    """A policy file, the shipped policy, or the shipped table without tracked conditions."""
    if path is not None:
        with open(path, encoding="utf-8") as handle:
            return validate(json.load(handle))
    return validate(json.loads(resources.files("tracewell.resources").joinpath("policy_basic.json" if basic else "policy.json").read_text(encoding="utf-8")))


def validate(policy: Any) -> dict[str, Any]:
    if not isinstance(policy, dict):
        raise ValueError("a severity policy is a JSON object")
    if not isinstance(policy.get("rules"), list):
        raise ValueError("severity policy rules must be a list")
    if policy.get("default", "watch") not in DEFAULT_LABELS:
        raise ValueError(f"unsupported default severity: {policy.get('default')}")
    return policy


def _wanted(expected: Any) -> list[Any]:
    return expected if isinstance(expected, list) else [] if expected is None else [expected]


def _holds(key: str, expected: Any, column) -> Column:
    wanted = _wanted(expected)
    if key == "causes_any":
        if not wanted:
            return F.lit(False)
        listed = F.arrays_overlap(column("causes"), F.array(*[F.lit(w) for w in wanted]))
        return F.coalesce(listed, F.lit(False)) | F.coalesce(column("cause").isin(*wanted), F.lit(False))
    values = [w for w in wanted if w is not None]
    test = F.coalesce(column(key).isin(*values), F.lit(False)) if values else F.lit(False)
    return test | column(key).isNull() if None in wanted else test


def severity(policy: dict[str, Any], column=F.col, known: set[str] | None = None) -> Column:
    """struct(label, rule_id, policy_version) of the first rule whose conditions all hold.

    ``known`` lists the available attributes; a condition on any other one
    compares null, as it would for an absent field.
    """
    version = str(policy.get("version") or "unversioned")
    default = policy.get("default", "watch")

    def outcome(label: str, rule_id: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(rule_id).alias("rule_id"), F.lit(version).alias("policy_version"))

    def attribute(name: str) -> Column:
        return column(name) if known is None or name in known else F.lit(None).cast("string")

    chain = None
    for index, rule in enumerate(policy["rules"]):
        when = rule.get("when") or {}
        if not isinstance(when, dict):
            continue
        test = reduce(lambda a, b: a & b, [_holds(k, v, attribute) for k, v in when.items()], F.lit(True))
        value = outcome(rule.get("label", default), rule.get("id") or f"rule-{index}")
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    fallback = outcome(default, "default")
    return fallback if chain is None else chain.otherwise(fallback)


def apply_severity(df: DataFrame, policy: dict[str, Any] | None = None) -> DataFrame:
    """Adds the severity struct from flat classification columns."""
    return df.withColumn("severity", severity(policy or load(), F.col, set(df.columns)))


def reapply(enriched: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """A new policy over retained rows; captured and classified fields stay as they are."""
    known = set(enriched.schema["classification"].dataType.names)
    return enriched.withColumn("severity", severity(policy, lambda n: F.col(f"classification.{n}"), known))
