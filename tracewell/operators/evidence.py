"""From enriched records to ledger evidence: one row per record with all keys that the ledger joins on."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import attributes as A
from tracewell.functions import identity as I
from tracewell.functions import regex as rx
from tracewell.functions import text as T
from tracewell.operators import coverage

KEPT_IDENTITY = ("inode", "dev", "content_hash")


def recurring(text: Column) -> Column:
    """Records of scheduled runs and of cooldowns: the same problem with another run or another time in its text."""
    return rx.has(text, P.SCHEDULED_RUN) | rx.has(text, P.COOLDOWN_EXPIRY)


def evidence_rows(enriched: DataFrame, aliases: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, gid, canonical_key, ts, what was classified (event, cause, provider, model, component, function, severity), record_role, scope_key,
    concrete, impact, signature, host, profile and text of enriched records.

    Needs host, profile, text, event_at, record_id, provenance, classification, severity and fingerprint. Where present, these
    columns count too: known_key (the fingerprint key under which an earlier run stored the problem), cursor, impact,
    record_role, and source_identity with inode, dev and content_hash. ``canonical_key`` is null for records that do not
    recur. A record without a time cannot be evidence, and reading it fails: it must not vanish. Nothing is shuffled.
    """
    c = F.col
    there = set(enriched.columns)

    def given(name: str, kind: str = "string") -> Column:
        return c(name) if name in there else F.lit(None).cast(kind)

    at = F.coalesce(c("event_at"), F.raise_error(F.lit("evidence lacks its time")).cast("timestamp"))
    label = F.coalesce(c("severity.label"), F.lit("watch"))
    identity = coverage.identity(c("host"), c("profile"), c("classification.provider"), c("classification.model"), c("classification.target"),
                                 c("text"), label, given("impact"), aliases)
    material = (c("host"), c("profile"), c("provenance.source_path"), c("record_id"), c("provenance.byte_start"), c("provenance.byte_end"),
                given("cursor"), T.canonical_text(c("event_at")), c("text"))
    plain = I.evidence_id(*material)
    if "source_identity" in there:
        kept = I.evidence_id(*material, tuple(c(f"source_identity.{name}") for name in KEPT_IDENTITY))
        plain = F.when(c("source_identity").isNull(), plain).otherwise(kept)
    key = c("fingerprint.key")
    return enriched.select(
        plain.alias("id"), I.finding_id(F.coalesce(given("known_key"), key), label).alias("gid"),
        F.when(recurring(c("text")), I.digest(key, label)).alias("canonical_key"), F.unix_timestamp(at).alias("ts"),
        *[c(f"classification.{n}").alias(n) for n in ("event", "cause", "provider", "model", "component")],
        A.function_slot(c("classification.tool"), c("classification.operation"), c("classification.component")).alias("function"), label.alias("severity"), given("record_role").alias("record_role"),
        identity["scope_key"].alias("scope_key"), identity["concrete"].alias("concrete"), given("impact").alias("impact"),
        identity["signature"].alias("signature"), "host", "profile", "text", *keep)


def canonical_findings(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings with the canonical key of their newest evidence; those whose newest evidence does not recur are left out."""
    newest = evidence.groupBy("gid").agg(F.max_by(F.struct("gid", "canonical_key"), F.struct("ts", "id")).alias("_new"))
    keyed = newest.select(F.col("_new.gid").alias("id"), F.col("_new.canonical_key").alias("canonical_key")).filter("canonical_key IS NOT NULL")
    return findings.join(keyed, "id")
