"""Audits and merges of repair histories.

Consecutive revisions are found by an equi-join on (report, revision), not by
a window per report, so a report with very many revisions is no hot partition.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import patterns as P


def with_previous(history: DataFrame, report: str = "report_id") -> DataFrame:
    """Adds ``previous``: the row of the revision before, or null."""
    before = history.select(report, (F.col("revision") + 1).alias("revision"), F.struct("status", "attempts").alias("previous"))
    return history.join(before, [report, "revision"], "left")


def transition_audit(history: DataFrame) -> DataFrame:
    """One row per violation: report, revision and rule.

    Revisions are contiguous from 1, statuses follow the allowed transitions
    (a repeated status is a progress note), and some statuses need more facts.
    """
    c = F.col
    allowed = [F.concat_ws(">", F.lit(a), F.lit(b)) for a, b in P.REPAIR_TRANSITIONS]
    linked = with_previous(history)
    step = F.concat_ws(">", c("previous.status"), c("status"))
    moved = c("previous").isNotNull() & (c("previous.status") != c("status"))
    checks: list[tuple[str, Column]] = [
        ("revision gap", (c("revision") > 1) & c("previous").isNull()),
        ("transition", moved & ~step.isin(*allowed)),
        ("assignee", c("status").isin("repair assigned", "repairing") & c("assigned_agent").isNull()),
        ("checks", (c("status") == "fixed") & ~(F.coalesce("checks_passed", F.lit(False)) & (F.size("attempts") > 0))),
        ("owner confirmation", (c("status") == "verified by owner") & c("owner_confirmation").isNull()),
        ("reason", c("status").isin("deferred", "won't fix") & c("reason").isNull()),
    ]
    broken = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks]))
    return linked.select("report_id", "revision", F.explode(broken).alias("rule"))


def append_only_audit(history: DataFrame) -> DataFrame:
    """Revisions whose attempts do not start with all attempts of the revision before."""
    c = F.col
    before = c("previous.attempts")
    kept = F.when(F.size(before) == 0, F.lit(True)).otherwise(F.slice("attempts", F.lit(1), F.greatest(F.size(before), F.lit(1))) == before)
    return with_previous(history).filter(c("previous").isNotNull() & ~kept).select("report_id", "revision")


REPAIR_FACTS = ("status", "attempts", "assigned_agent", "checks_passed", "reason", "owner_confirmation")


def sync_siblings(reports: DataFrame) -> DataFrame:
    """Copies the repair facts of the latest revision to every report of the same finding and
    episode; each keeps its own diagnosis. One maximum per episode, joined back."""
    facts = [c for c in REPAIR_FACTS if c in reports.columns]
    newest = reports.groupBy("finding_id", "episode").agg(
        F.max_by(F.struct(*facts, F.col("report_id").alias("synced_from")), F.struct("revision", "report_id")).alias("_newest"))
    return reports.drop(*facts).join(newest, ["finding_id", "episode"]).select(
        *[c for c in reports.columns if c not in facts], "_newest.*")


def episodes(incidents: DataFrame, evidence: DataFrame, batches: DataFrame) -> DataFrame:
    """Closed incidents that recurred: evidence after closure and cutoff, investigated by a batch
    created after closure. They become open again under the next episode.

    ``batches``: finding_id, created. Both sides are reduced to one row per finding first.
    """
    c = F.col
    last = evidence.groupBy(c("gid").alias("finding_id")).agg(F.max("ts").alias("_last"))
    made = batches.groupBy("finding_id").agg(F.max("created").alias("_created"))
    rows = incidents.join(last, "finding_id", "left").join(made, "finding_id", "left")
    again = F.coalesce(
        c("closed_at").isNotNull() & (c("_created") > c("closed_at"))
        & (c("_last") > F.greatest(F.coalesce("evidence_cutoff", F.lit(0)), c("closed_at"))), F.lit(False))
    return rows.withColumn("recurred", again).withColumns({
        "status": F.when(c("recurred"), "open").otherwise(c("status")),
        "episode": c("episode") + F.when(c("recurred"), 1).otherwise(0),
        "closed_at": F.when(~c("recurred"), c("closed_at")),
        "evidence_cutoff": F.when(c("recurred"), c("_last")).otherwise(c("evidence_cutoff")),
    }).drop("_last", "_created")
