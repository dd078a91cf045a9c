"""The review ledger: evidence, findings, batches and decisions as pure table functions.

Evidence is the large table and one finding may own a third of it, so evidence
is always reduced per finding with aggregates that combine before the shuffle;
joins are then between tables with one row per finding.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators import scan
from tracewell.operators.serious import serious, serious_per_finding

COOLDOWN_SECONDS = 3600
RETENTION_SECONDS = 72 * 3600
DECISIONS = ("watch", "rca", "informational", "tracked")  # fixed values
MIN_REASON = 12
SAMPLE = 240
LANE_KINDS = ("rca", "rca-a", "rca-b")


def latest(evidence: DataFrame) -> DataFrame:
    """Newest row per finding, by time then id; a maximum instead of a sort per finding.

    The finding id is taken from the winning row, not from the grouping: Spark
    would push a later semi or anti join on the grouping key below the
    aggregate, and then shuffle all evidence by finding, busy ones included.
    """
    return evidence.groupBy("gid").agg(
        F.max_by(F.struct(*evidence.columns), F.struct("ts", "id")).alias("_row")).select("_row.*")


def finding_stats(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("gid").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def new_evidence(evidence: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows whose id is not stored yet, each once; the anti join comes before anything costly."""
    return rows.join(evidence.select("id"), "id", "left_anti").dropDuplicates(["id"])


def ingest(evidence: DataFrame, findings: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds unseen rows; creates their findings. Replaying the same rows adds nothing.

    A finding that starts with an ignored record or a continuation starts as
    ignored. Tracked records decide an undecided finding each time they are
    offered, stored or not, but only one that is there already: the first
    sighting creates the finding, the second decides it. ``investigated`` is
    set with the decision.
    """
    c = F.col
    fresh = new_evidence(evidence, rows)
    quiet = (c("severity") == "ignore") | (c("record_role") == "continuation")
    opening = fresh.groupBy("gid").agg(F.min_by(quiet, F.struct("ts", "id")).alias("_quiet")).withColumnRenamed("gid", "id")
    tracked = rows.filter(c("severity") == "tracked").groupBy(c("gid").alias("id")).agg(F.count("*").alias("_tracked"))
    kept = findings.join(opening, "id", "full").join(tracked, "id", "left")
    started = F.coalesce(c("decision"), F.when(c("seq").isNull() & c("_quiet"), "ignore"))
    sighted = F.coalesce(c("_tracked"), F.lit(0)) >= F.when(c("seq").isNotNull(), 1).otherwise(2)
    by_tracking = started.isNull() & sighted
    before = F.coalesce(c("investigated"), F.lit(False)) if "investigated" in findings.columns else F.lit(False)
    updated = kept.withColumns({
        "decision": F.when(by_tracking, "tracked").otherwise(started), "investigated": before | by_tracking}).drop("_quiet", "_tracked")
    return evidence.unionByName(fresh, allowMissingColumns=True), updated


def alias(new: DataFrame, findings: DataFrame) -> DataFrame:
    """Attaches recurring scheduled or cooldown records of ``new`` to known findings by their canonical key.

    ``findings`` have a canonical_key (see ``evidence.canonical_findings``). When all findings of a key share one decision, the
    most complete one is used: most lanes done, then latest review, then greatest id. With no finding the key itself
    names a new one; with differing decisions the record keeps its own id, as do records without a canonical key,
    which are not shuffled. There is one row per key to join with, so a key with many records splits.
    """
    c = F.col
    done = c("lane_a_done").cast("int") + c("lane_b_done").cast("int")
    per_key = findings.groupBy("canonical_key").agg(
        F.countDistinct(F.coalesce("decision", F.lit(""))).alias("_decisions"),
        F.max_by("id", F.struct(done, F.coalesce("reviewed_at", F.lit(0)), "id")).alias("_best"))
    joined = scan.salted_join(new.filter(c("canonical_key").isNotNull()), per_key, ["canonical_key"]).withColumn(
        "gid", F.when(c("_decisions") == 1, c("_best")).when(c("_decisions").isNull(), F.left("canonical_key", F.lit(20)))
        .otherwise(c("gid"))).select(*new.columns)
    return joined.unionByName(new.filter(c("canonical_key").isNull()))


def reopen(findings: DataFrame, fresh: DataFrame, now: Column, cooldown: int = COOLDOWN_SECONDS) -> DataFrame:
    """Adds ``reopened`` and clears the decision of findings for which new evidence was stored ``now``, at least
    ``cooldown`` seconds after the last review, unless the finding is investigated or queued.

    ``fresh``: the evidence rows stored in this run. When they arrive counts, not when their events were: a late
    event reopens as well.
    """
    c = F.col
    arrived = fresh.select(c("gid").alias("id")).distinct().withColumn("_fresh", F.lit(True))
    investigated = c("lane_a_done") | c("lane_b_done") | F.coalesce(c("decision") == "rca", F.lit(False))
    due = F.coalesce(c("_fresh") & (now - c("reviewed_at") >= cooldown), F.lit(False))
    marked = findings.join(arrived, "id", "left").withColumn("reopened", due & ~investigated)
    return marked.withColumn("decision", F.when(~c("reopened"), c("decision"))).drop("_fresh")


def review_items(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per finding with evidence: id, last, text, and ``item``, what a reviewer is shown of it.

    The item has the newest evidence, the finding's count and times, and its prior status; fields are in the order of their
    names. The sample is the text's first 240 characters.
    """
    c = F.col
    shown = ("host", "function", "event", "cause", "provider", "model", "component", "severity")
    newest = latest(evidence.select("gid", "ts", "id", "profile", "text", *shown)).select(
        c("gid").alias("_gid"), c("id").alias("_evidence"), c("profile").alias("_agent"), "text", *shown)
    prior = findings.select("id", F.struct("decision", "lane_a_done", "lane_b_done", "reason", "reviewed_at").alias("_prior"))
    stats = finding_stats(evidence).withColumnRenamed("gid", "id")
    joined = prior.join(stats, "id").join(newest, c("id") == c("_gid"))
    fields = {
        "agent": c("_agent"), "evidence": c("_evidence"), "evidence_rows": c("n"), "first": c("first"), "id": c("id"), "last": c("last"), "prior_status": c("_prior"),
        "sample": F.left("text", F.lit(SAMPLE)), "sample_original_chars": F.length("text"), "sample_truncated": F.length("text") > SAMPLE, **{n: c(n) for n in shown}}
    return joined.select("id", "last", "text", F.struct(*[fields[n].alias(n) for n in sorted(fields)]).alias("item"))


def prioritise(items: DataFrame) -> DataFrame:
    """Serious first, then newest; ``position`` in that order. Runs a job."""
    return scan.global_position(items, [F.col("serious").desc(), F.col("last").desc(), F.col("id").asc()])


def members(batches: DataFrame) -> DataFrame:
    """One row per batch and finding."""
    return batches.select(F.col("id").alias("batch_id"), "kind", "status", "attempts", "lease_until", F.explode("ids").alias("id"))


def membership(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Per batch and id: missing, extra, duplicate, invalid or ok."""
    c = F.col
    valid = F.coalesce(c("decision").isin(*DECISIONS) & (F.length(F.trim("reason")) >= MIN_REASON), F.lit(False))
    answered = results.groupBy("batch_id", "id").agg(F.count("*").alias("_n"), F.bool_and(valid).alias("_valid"))
    known = expected.select("batch_id", "id").distinct().withColumn("_expected", F.lit(True))
    joined = known.join(answered, ["batch_id", "id"], "full")
    return joined.select("batch_id", "id", F.when(c("_n").isNull(), "missing").when(c("_expected").isNull(), "extra")
                         .when(c("_n") > 1, "duplicate").when(~c("_valid"), "invalid").otherwise("ok").alias("outcome"))


def check_results(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Per batch: the counts of each fault, and whether the whole batch may be applied."""
    def count(kind: str) -> Column:
        return F.count_if(F.col("outcome") == kind).alias(kind)
    return membership(expected, results).groupBy("batch_id").agg(
        count("missing"), count("extra"), count("duplicate"), count("invalid"),
        F.bool_and(F.col("outcome") == "ok").alias("accepted"))


def apply_decisions(findings: DataFrame, expected: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Decisions of the accepted batches; a faulty batch changes nothing."""
    accepted = check_results(expected, results).filter("accepted").select("batch_id")
    chosen = results.join(accepted, "batch_id", "left_semi").groupBy("id").agg(
        F.max_by(F.struct("decision", "reason"), "batch_id").alias("_new"))
    joined = findings.join(chosen, "id", "left")
    return joined.withColumns({
        "decision": F.coalesce("_new.decision", "decision"), "reason": F.coalesce("_new.reason", "reason"),
        "reviewed_at": F.when(F.col("_new").isNotNull(), now).otherwise(F.col("reviewed_at")),
    }).drop("_new")


def recoverable(batches: DataFrame, findings: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """Members of blocked batches: eligible to run again, expired, or retained with the reason."""
    c = F.col
    blocked = members(batches.filter(c("status") == "blocked"))
    last = evidence.groupBy(c("gid").alias("id")).agg(F.max("ts").alias("_last"))
    lane_done = F.when(c("kind") == "rca-b", c("lane_b_done")).otherwise(c("lane_a_done"))
    pending = F.coalesce(F.when(c("kind") == "triage", c("decision").isNull()).otherwise((c("decision") == "rca") & ~lane_done), F.lit(False))
    alive = F.coalesce(c("_last") >= now - RETENTION_SECONDS, F.lit(False))
    known = findings.select("id", "decision", "lane_a_done", "lane_b_done", F.lit(True).alias("_found"))
    return blocked.join(known, "id", "left").join(last, "id", "left").select(
        "batch_id", "id", F.when(c("_found").isNotNull() & pending & alive, "eligible").when(c("_found").isNotNull() & pending, "expired")
        .otherwise("retained").alias("state"),
        F.when(~alive, "evidence missing/expired").when(~pending, "already decided/completed").alias("reason"))


def expire(evidence: DataFrame, findings: DataFrame, batches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence beyond the retention window is removed. A finding that loses its last evidence
    while undecided or unfinished becomes evidence_expired and blocks running batches."""
    c = F.col
    kept = evidence.filter(c("ts") >= now - RETENTION_SECONDS)
    ages = evidence.groupBy(c("gid").alias("id")).agg(F.max("ts").alias("_last"))
    unfinished = c("decision").isNull() | ((c("decision") == "rca") & ~(c("lane_a_done") & c("lane_b_done")))
    marked = findings.join(ages, "id", "left").withColumn(
        "_expired", F.coalesce(c("_last") < now - RETENTION_SECONDS, F.lit(False)) & unfinished)
    updated = marked.withColumn("decision", F.when(c("_expired"), "evidence_expired").otherwise(c("decision"))).drop("_last", "_expired")
    expired = marked.filter("_expired").select("id")
    hit = members(batches.filter(c("status") == "running")).join(expired, "id", "left_semi").select(
        c("batch_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    blocked = batches.join(hit, "id", "left").withColumn(
        "status", F.when(c("_hit"), "blocked").otherwise(c("status"))).drop("_hit")
    return kept, updated, blocked


def promote(findings: DataFrame, evidence: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Report of undecided findings with a serious observation, by their latest one; it changes no decision.

    ``excluded``: findings that are covered, uncertain or worked on (``coverage.busy``).
    """
    undecided = findings.filter(F.col("decision").isNull()).select(F.col("id").alias("gid"))
    if excluded is not None:
        undecided = undecided.join(excluded.select(F.col("id").alias("gid")), "gid", "left_anti")
    # Reduce evidence to one row per finding before the join: a busy finding is not a busy join key.
    seen = serious_per_finding(serious(evidence, event="event", role="record_role"))
    return seen.join(undecided, "gid", "left_semi").select(
        F.col("gid").alias("id"), "serious", "first_seen",
        F.concat(F.lit("Deterministic urgent observation; cause unverified: "), "serious", F.lit(" observed in unreviewed finding "), "gid").alias("reason"))


def missing_extra(expected: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    missing = expected.select(*keys).distinct().join(returned.select(*keys), keys, "left_anti").withColumn("side", F.lit("missing"))
    extra = returned.select(*keys).distinct().join(expected.select(*keys), keys, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def fully_covered(batches: DataFrame, covered: DataFrame) -> DataFrame:
    """Batches all of whose members are covered."""
    known = covered.select("id").distinct().withColumn("_covered", F.lit(True))
    return members(batches).join(known, "id", "left").groupBy("batch_id").agg(
        F.bool_and(F.coalesce("_covered", F.lit(False))).alias("_all")).filter("_all").select("batch_id")


def eligible(findings: DataFrame, evidence: DataFrame, covered: DataFrame, uncertain: DataFrame, busy: DataFrame, kind: str) -> DataFrame:
    """Findings a batch of this kind may take.

    Triage takes undecided findings and uncertain approved ones; an
    investigation lane takes approved findings that are certain.
    """
    c = F.col
    doubt = uncertain.select("id").distinct().withColumn("_uncertain", F.lit(True))
    open_ = findings.filter(c("decision").isNull() | (c("decision") == "rca"))
    rows = open_.join(covered.select("id"), "id", "left_anti").join(busy.select("id"), "id", "left_anti").join(doubt, "id", "left")
    wanted = (c("decision").isNull() | c("_uncertain").isNotNull()) if kind == "triage" else (c("decision") == "rca") & c("_uncertain").isNull()
    with_evidence = evidence.select(c("gid").alias("id")).distinct()
    return rows.filter(wanted).join(with_evidence, "id", "left_semi").select("id", "decision")


def unacknowledged(events: DataFrame) -> DataFrame:
    """Answers without an acknowledgement event."""
    answers = events.filter(F.col("kind") == "answer")
    acks = events.select(F.col("event_id").alias("_ack"))
    return answers.join(acks, F.concat(F.lit("ack:"), answers["event_id"]) == acks["_ack"], "left_anti")


def undelivered(history: DataFrame, deliveries: DataFrame) -> DataFrame:
    return history.join(deliveries.select("batch_id"), "batch_id", "left_anti")


def retention_gaps(files: DataFrame, stamps: DataFrame, archive: DataFrame) -> DataFrame:
    """Files not yet synced or changed since, and synced files that are neither on disk nor archived."""
    c = F.col
    joined = files.select("name", c("modified").alias("_m"), c("size").alias("_s"), F.lit(True).alias("_disk")).join(
        stamps.select("name", "modified", "size", F.lit(True).alias("_synced")), "name", "full")
    stale = c("_disk").isNotNull() & ~F.coalesce((c("_m") == c("modified")) & (c("_s") == c("size")), F.lit(False))
    unsynced = joined.filter(stale).select("name", F.lit("unsynced").alias("gap"))
    gone = joined.filter(c("_disk").isNull()).join(archive.select("name"), "name", "left_anti").select("name", F.lit("missing").alias("gap"))
    return unsynced.unionByName(gone)


def top_history(history: DataFrame, findings: DataFrame, n: int = 20) -> DataFrame:
    """Latest reports and decisions, as one list of kind, id and time."""
    reports = history.orderBy(F.col("completed_at").desc(), F.col("id").desc()).limit(n).select(
        F.lit("report").alias("kind"), F.col("id").cast("string").alias("id"), F.col("completed_at").alias("at"))
    decided = findings.filter("decision IS NOT NULL").orderBy(F.col("reviewed_at").desc(), F.col("id").desc()).limit(n).select(
        F.lit("decision").alias("kind"), "id", F.col("reviewed_at").alias("at"))
    return reports.unionByName(decided)


def notices_to_send(notices: DataFrame, sent: DataFrame) -> DataFrame:
    """Messages never sent before, each once."""
    return notices.dropDuplicates(["notice_key"]).join(sent.select("notice_key"), "notice_key", "left_anti")


def review_status(findings: DataFrame, evidence: DataFrame, batches: DataFrame, covered: DataFrame, uncertain: DataFrame,
                  reopened: DataFrame, now: Column) -> DataFrame:
    """The ledger's balance as name and value."""
    c = F.col

    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select("id").distinct().withColumn(name, F.lit(True))

    rows = findings.join(flag(covered, "_covered"), "id", "left").join(flag(uncertain, "_uncertain"), "id", "left").join(
        flag(reopened, "_reopened"), "id", "left")
    is_covered, is_uncertain = c("_covered").isNotNull(), c("_uncertain").isNotNull()
    approved = F.coalesce(c("decision") == "rca", F.lit(False))
    of_findings = rows.agg(
        F.count_if((c("decision").isNull() & ~is_covered) | (approved & is_uncertain)).alias("pending_triage"),
        F.count_if(approved & ~is_covered & ~is_uncertain).alias("pending_investigation"),
        F.count_if(is_covered).alias("covered"), F.count_if(is_uncertain).alias("uncertain"),
        F.count_if(c("_reopened").isNotNull()).alias("reopened"), F.count("*").alias("findings"),
        F.count_if(F.coalesce(c("decision") == "evidence_expired", F.lit(False))).alias("evidence_expired"))
    running = c("status") == "running"
    of_batches = batches.agg(
        F.count_if(running & (c("lease_until") > now)).alias("active_leases"),
        F.count_if(running & (c("lease_until") <= now)).alias("retry_eligible"),
        F.count_if(c("status") == "blocked").alias("blocked_batches"))
    return _named(of_findings).unionByName(_named(of_batches)).unionByName(_named(evidence.agg(F.count("*").alias("evidence"))))


def _named(one_row: DataFrame) -> DataFrame:
    """The columns of a one-row table as rows of name and value."""
    pairs = F.create_map(*[x for name in one_row.columns for x in (F.lit(name), F.col(name))])
    return one_row.select(F.explode(pairs).alias("name", "value"))


def delivery_status(history: DataFrame, deliveries: DataFrame, incidents: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of what still has to be delivered, repaired or answered, as name and value."""
    c = F.col
    of_incidents = incidents.agg(
        F.count_if(c("status").isin("open", "repair assigned", "repairing")).alias("pending_repairs"),
        F.count_if(c("status") == "deferred").alias("deferred_incidents"))
    counted = (
        deliveries.agg(F.count_if(c("publication_state") != "published").alias("delivery_pending")),
        undelivered(history, deliveries).agg(F.count("*").alias("unregistered_history")),
        unacknowledged(events).agg(F.count("*").alias("pending_answers")),
    )
    return reduce(DataFrame.unionByName, [_named(t) for t in (of_incidents, *counted)])


def daily_balance(status: DataFrame, history: DataFrame, previous: str | None = None) -> DataFrame:
    """The day's packet and its digest; ``changed`` is false when it repeats the previous one."""
    recent = history.orderBy(F.col("completed_at").desc(), F.col("id").desc()).limit(5).select(
        F.concat(F.lit("history:"), F.col("id").cast("string")).alias("name"), F.col("completed_at").alias("value"))
    # A handful of rows: the status names and five reports.
    packet = status.unionByName(recent).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("packet"))
    digest = packet.withColumn("digest", F.sha2("packet", 256))
    return digest.withColumn("changed", F.lit(True) if previous is None else F.col("digest") != previous)
