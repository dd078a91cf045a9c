"""Enrichment: classification, severity, fingerprint and provenance beside the original columns."""
from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import identity as I
from tracewell.functions import text as T
from tracewell.plans import policy as severity_policy
from tracewell.plans import rules

CLASSIFICATION = (
    "event", "events", "cause", "causes", "domain", "kind", "provider", "model", "fallback_provider", "fallback_model",
    "platform", "component", "tool", "target", "database", "path_basename", "operation", "stream_stage", "exception",
    "exceptions", "http_status", "provider_code", "provider_codes", "rpc_code", "errno", "exit_code", "signal",
    "attempt", "max_attempts", "service_result", "device", "log_level", "event_ts", "event_ts_basis",
    "matched_rules", "conflicts", "field_evidence", "field_confidence", "rule_version", "is_observation",
)
# The dimensions that separate two fingerprints.
SEMANTIC_FIELDS = (
    "provider", "model", "fallback_provider", "fallback_model", "platform", "component", "domain", "tool", "target",
    "event", "events", "cause", "causes", "exception", "exceptions", "http_status", "provider_code", "rpc_code",
    "errno", "exit_code", "signal", "operation", "stream_stage", "service_result", "device", "kind",
)
LIST_FIELDS = ("events", "causes", "exceptions")
OVERFLOW = "generated"


def add_fingerprint(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Adds the fingerprint struct to records with text, host, profile and the classification struct; equal keys mean the same
    problem on the same host and profile.

    The template may drop paths, so the affected resources are part of the key.
    """
    said = {f: F.col(f"classification.{f}") for f in SEMANTIC_FIELDS}
    system = (F.coalesce(said["domain"] == "system", F.lit(False)) | F.coalesce(F.col("profile").startswith("system:"), F.lit(False)))
    staged = T.add_template(df, F.col("text"), system).withColumns({
        "_host": T.canonical_host(F.col("host"), aliases),
        "_profile": F.when(F.col("profile").isNull() | (F.col("profile") == ""), "UNKNOWN").otherwise(F.col("profile")),
        "_resources": T.resources(F.col("text")),
    })
    staged = staged.withColumns({
        **{f"_{f}": I.packed_list(said[f]) for f in LIST_FIELDS}, "__resources": I.packed_list(F.col("_resources"))})
    parts = ["__resources", "_host", "_profile", "normalized_text", *[f"_{f}" if f in LIST_FIELDS else f"classification.{f}" for f in SEMANTIC_FIELDS]]
    key = F.sha2(I.packed_columns(parts), 256)
    shown = ("event", "events", "cause", "causes", "provider", "model", "domain", "kind", "platform", "component",
             "tool", "target", "operation")
    return staged.withColumn("fingerprint", F.struct(
        key.alias("key"), F.col("_host").alias("host"), F.col("_profile").alias("profile"), "normalized_text",
        F.col("_resources").alias("resources"), *[said[f].alias(f) for f in shown])).drop(
            "_host", "_profile", "_resources", "normalized_text", "__resources", *[f"_{f}" for f in LIST_FIELDS])


def enrich(df: DataFrame, policy: dict[str, Any] | None = None, book: dict[str, Any] | None = None,
           aliases: dict[str, str] | None = None) -> DataFrame:
    """Original columns unchanged, plus classification, severity, fingerprint and provenance.

    Reads text, host, profile and, where present, ts, event_ts, sig,
    source_path, byte_start and byte_end. A generated name the input already
    uses goes into the struct ``generated`` instead, so originals survive.
    Expressions are narrow: no shuffle happens here.
    """
    original = df.columns
    work = df.select(F.struct(*[F.col(f"`{c}`") for c in original]).alias("_original"))

    def given(name: str, kind: str = "string") -> Column:
        return F.col(f"_original.`{name}`") if name in original else F.lit(None).cast(kind)

    work = work.select("_original", given("text").alias("text"), given("profile").alias("profile"), given("host").alias("host"),
                       given("ts").cast("string").alias("_ts"), given("event_ts").alias("_event_ts"))
    time = T.event_time(F.col("text"), F.col("_ts"))
    staged = rules.classify(work, book).withColumns({
        "event_ts": F.coalesce(F.col("_event_ts").cast("string"), time["event_ts"]),
        "event_ts_basis": time["event_ts_basis"],
    })
    staged = severity_policy.apply_severity(rules.field_evidence(staged), policy or severity_policy.load())
    # written once: the steps of the template copy a struct in one piece
    staged = staged.select("_original", "text", "host", "profile", "severity", F.struct(*CLASSIFICATION).alias("classification"))
    staged = add_fingerprint(staged, aliases)
    generated = {
        "classification": F.col("classification"),
        "severity": F.col("severity"),
        "fingerprint": F.col("fingerprint"),
        "provenance": F.struct(
            given("source_path").alias("source_path"), given("byte_start", "bigint").alias("byte_start"),
            given("byte_end", "bigint").alias("byte_end"), F.col("classification.rule_version"),
            given("sig").alias("original_signature"), F.col("severity.policy_version").alias("policy_version")),
    }
    kept = [given(c).alias(c) for c in original]
    free = [c.alias(n) for n, c in generated.items() if n not in original]
    taken = [c.alias(n) for n, c in generated.items() if n in original]
    overflow = [F.struct(*taken).alias(OVERFLOW)] if taken else []
    return staged.select(*kept, *free, *overflow)
