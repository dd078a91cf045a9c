"""Queries over the review ledger."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.operators import coverage as C, evidence as EV, ledger as O, packing as K, repairs as RP, serious as Z
from tracewell.queries import adapters, duck as d, groups as Q, streams as ST
from tracewell.queries import ledger_adapter as LA
from tracewell.queries.ledger_adapter import NOW_S, read, sql
from tracewell.queries.registry import query
from tracewell.streaming import jobs


def now():
    return F.lit(NOW_S).cast("bigint")


def batches(spark, folder):
    """Batches with their member ids as an array, as a ledger stores them."""
    return read(spark, folder, "members").groupBy(
        F.col("batch_id").alias("id"), "kind", "status", "attempts", "lease_until", "created").agg(F.collect_list("id").alias("ids"))


def _tables(spark, folder, *names):
    return [read(spark, folder, n) for n in names]


# --- evidence and findings ------------------------------------------------------------------------
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY ts DESC, id DESC) AS rn FROM evidence) WHERE rn = 1)"


@query("win_latest_evidence", sql("SELECT gid, id, ts, signature, text FROM latest", LATEST))
def latest_evidence(spark, folder):
    return O.latest(read(spark, folder, "evidence").select("gid", "id", "ts", "signature", "text"))


@query("agg_finding_stats", sql("SELECT gid, count(*) AS n, min(ts) AS first, max(ts) AS last FROM evidence GROUP BY gid"))
def finding_stats(spark, folder):
    return O.finding_stats(read(spark, folder, "evidence"))


_NEW = """had AS (SELECT * FROM evidence WHERE line_id % 3 = 0), known AS (SELECT * FROM findings WHERE id IN (SELECT gid FROM had)),
 came AS (SELECT * FROM evidence WHERE line_id % 3 <> 0),
 opening AS (SELECT gid, arg_min(severity = 'ignore' OR record_role = 'continuation', {'a': ts, 'b': id}) AS quiet FROM came GROUP BY gid)"""


@query("join_new_evidence", sql("""SELECT id, CASE WHEN tracks THEN 'tracked' ELSE started END AS decision, tracks AS investigated FROM (
    SELECT *, started IS NULL AND coalesce(sightings, 0) >= CASE WHEN existing THEN 1 ELSE 2 END AS tracks FROM (
      SELECT coalesce(k.id, o.gid) AS id, k.id IS NOT NULL AS existing, CASE WHEN k.id IS NULL AND o.quiet THEN 'ignore' ELSE k.decision END AS started, t.sightings
      FROM known k FULL JOIN opening o ON o.gid = k.id LEFT JOIN (SELECT gid, count(*) + count(*) FILTER (WHERE line_id % 2 = 0) AS sightings
        FROM evidence WHERE severity = 'tracked' GROUP BY gid) t ON t.gid = coalesce(k.id, o.gid)))""", _NEW))
def join_new_evidence(spark, folder):
    evidence, findings = _tables(spark, folder, "evidence", "findings")
    stored = evidence.filter("line_id % 3 = 0")
    known = findings.join(stored.select(F.col("gid").alias("id")).distinct(), "id", "left_semi")
    # The table is offered with a part of it twice: a tracked row counts each time, storing does not repeat.
    return O.ingest(stored, known, evidence.union(evidence.filter("line_id % 2 = 0")))[1].select("id", "decision", "investigated")


@query("agg_stored_evidence", sql("SELECT count(*) AS stored, count(DISTINCT id) AS ids FROM evidence"))
def stored_evidence(spark, folder):
    """A replay of rows that are stored, and of rows offered twice, stores each once."""
    evidence, findings = _tables(spark, folder, "evidence", "findings")
    rows = O.ingest(evidence.filter("line_id % 3 = 0"), findings, evidence.union(evidence))[0]
    return rows.agg(F.count("*").alias("stored"), F.countDistinct("id").alias("ids"))


_CANONICAL = """known_rows AS (SELECT * FROM evidence WHERE line_id % 2 = 0),
 newest AS (SELECT gid, arg_max({'k': canonical_key}, {'a': ts, 'b': id}).k AS canonical_key FROM known_rows GROUP BY gid),
 per_key AS (SELECT canonical_key, count(DISTINCT coalesce(decision, '')) AS decisions,
   arg_max(f.id, {'d': CAST(lane_a_done AS INT) + CAST(lane_b_done AS INT), 'r': coalesce(reviewed_at, 0), 'i': f.id}) AS best
   FROM newest n JOIN findings f ON f.id = n.gid WHERE canonical_key IS NOT NULL GROUP BY canonical_key)"""


@query("join_alias_findings", sql("""SELECT r.id, CASE WHEN r.canonical_key IS NULL THEN r.gid WHEN p.decisions = 1 THEN p.best WHEN p.decisions IS NULL THEN left(r.canonical_key, 20) ELSE r.gid END AS gid,
    r.canonical_key IS NOT NULL AS recurring FROM evidence r LEFT JOIN per_key p USING (canonical_key)""", _CANONICAL))
def alias_findings(spark, folder):
    evidence, findings = _tables(spark, folder, "evidence", "findings")
    known = EV.canonical_findings(evidence.filter("line_id % 2 = 0"), findings)
    # All evidence is offered; the half that an earlier version stored is what the ledger knows.
    return O.alias(evidence.select("id", "gid", "canonical_key"), known).select("id", "gid", F.col("canonical_key").isNotNull().alias("recurring"))


@query("win_cooldown_reopen", sql(f"""SELECT f.id, due AS reopened, CASE WHEN NOT due THEN decision END AS decision FROM
    (SELECT f.*, coalesce(l.gid IS NOT NULL AND {NOW_S} - f.reviewed_at >= 3600, false) AND NOT (lane_a_done OR lane_b_done OR coalesce(decision = 'rca', false)) AS due
     FROM findings f LEFT JOIN (SELECT DISTINCT gid FROM evidence WHERE line_id % 3 = 1) l ON l.gid = f.id) f"""))
def cooldown_reopen(spark, folder):
    evidence, findings = _tables(spark, folder, "evidence", "findings")
    return O.reopen(findings, evidence.filter("line_id % 3 = 1"), F.lit(NOW_S)).select("id", "reopened", "decision")


_LABEL = f"CASE WHEN {d.has('bare', P.SERIOUS[0][1])} THEN '{P.SERIOUS[0][0]}' WHEN {d.has('bare', P.SERIOUS[1][1])} THEN '{P.SERIOUS[1][0]}' END"
_SERIOUS = f"""bared AS (SELECT *, {d.sub('text', P.QUOTED_SPAN, ' ')} AS bare FROM evidence),
 labelled AS (SELECT *, CASE WHEN NOT {d.has('bare', P.ADAPTER_RECONNECT)} THEN {_LABEL} END AS label FROM bared),
 first_serious AS (SELECT gid, arg_max(label, {{'a': ts, 'b': id}}) AS serious, min(ts) AS first_seen FROM labelled
   WHERE label IS NOT NULL AND severity <> 'ignore' AND record_role <> 'continuation'
     AND NOT ({d.has('profile', P.HEALTH_PROFILE)} AND coalesce(event IN ({', '.join(d.q(e) for e in P.HEALTH_EVENTS)}), false)) GROUP BY gid)"""


@query("win_review_priority", sql("""SELECT l.gid AS id, l.label IS NOT NULL AS serious, l.ts AS last, row_number() OVER (ORDER BY l.label IS NOT NULL DESC, l.ts DESC, l.gid) AS position
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY ts DESC, id DESC) AS rn FROM labelled) WHERE rn = 1) l""", _SERIOUS))
def review_priority(spark, folder):
    newest = O.latest(read(spark, folder, "evidence").select("gid", "ts", "id", "text"))
    items = newest.select(F.col("gid").alias("id"), Z.serious_label(F.col("text")).isNotNull().alias("serious"), F.col("ts").alias("last"))
    return O.prioritise(items)



# --- batches and results ----------------------------------------------------------------------------
_OUTCOME = """expected AS (SELECT DISTINCT batch_id, id FROM members WHERE kind = 'triage' AND bucket % 2 = 0),
 answered AS (SELECT batch_id, id, count(*) AS n, bool_and(decision IN ('watch', 'rca', 'informational', 'tracked') AND length(trim(reason)) >= 12) AS valid FROM results GROUP BY ALL),
 outcomes AS (SELECT coalesce(e.batch_id, a.batch_id) AS batch_id, coalesce(e.id, a.id) AS id, CASE WHEN a.n IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'extra'
   WHEN a.n > 1 THEN 'duplicate' WHEN NOT a.valid THEN 'invalid' ELSE 'ok' END AS outcome FROM expected e FULL JOIN answered a ON a.batch_id = e.batch_id AND a.id = e.id),
 checked AS (SELECT batch_id, count(*) FILTER (WHERE outcome = 'missing') AS missing, count(*) FILTER (WHERE outcome = 'extra') AS extra,
   count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate, count(*) FILTER (WHERE outcome = 'invalid') AS invalid, bool_and(outcome = 'ok') AS accepted FROM outcomes GROUP BY batch_id)"""


def expected(spark, folder):
    return read(spark, folder, "members").filter("kind = 'triage' AND bucket % 2 = 0").select("batch_id", "id")


@query("join_membership_check", sql("SELECT * FROM checked", _OUTCOME))
def membership_check(spark, folder):
    return O.check_results(expected(spark, folder), read(spark, folder, "results"))


@query("join_apply_decisions", sql(f"""SELECT f.id, coalesce(r.decision, f.decision) AS decision, coalesce(r.reason, f.reason) AS reason,
    CASE WHEN r.id IS NOT NULL THEN {NOW_S} ELSE f.reviewed_at END AS reviewed_at FROM findings f
    LEFT JOIN (SELECT * FROM results WHERE batch_id IN (SELECT batch_id FROM checked WHERE accepted)) r ON r.id = f.id""", _OUTCOME))
def apply_decisions(spark, folder):
    return O.apply_decisions(read(spark, folder, "findings"), expected(spark, folder), read(spark, folder, "results"), now()).select(
        "id", "decision", "reason", "reviewed_at")


@query("set_missing_extra", sql("""SELECT batch_id, id, 'missing' AS side FROM (SELECT batch_id, id FROM expected EXCEPT SELECT batch_id, id FROM results)
    UNION ALL SELECT batch_id, id, 'extra' FROM (SELECT batch_id, id FROM results EXCEPT SELECT batch_id, id FROM expected)""", _OUTCOME))
def missing_extra(spark, folder):
    return O.missing_extra(expected(spark, folder), read(spark, folder, "results"), ["batch_id", "id"])


@query("join_recoverable", sql(f"""SELECT m.batch_id, m.id, CASE WHEN pending AND alive THEN 'eligible' WHEN pending THEN 'expired' ELSE 'retained' END AS state,
    CASE WHEN NOT alive THEN 'evidence missing/expired' WHEN NOT pending THEN 'already decided/completed' END AS reason FROM
    (SELECT m.batch_id, m.id, coalesce(CASE WHEN m.kind = 'triage' THEN f.decision IS NULL ELSE f.decision = 'rca' AND NOT (CASE WHEN m.kind = 'rca-b' THEN f.lane_b_done ELSE f.lane_a_done END) END, false) AS pending,
       coalesce((SELECT max(ts) FROM evidence e WHERE e.gid = m.id) >= {NOW_S - 72 * 3600}, false) AS alive
     FROM members m LEFT JOIN findings f ON f.id = m.id WHERE m.status = 'blocked') m"""))
def recoverable(spark, folder):
    evidence, findings = _tables(spark, folder, "evidence", "findings")
    return O.recoverable(batches(spark, folder), findings, evidence, now())


_EXPIRED = f"""aged AS (SELECT f.*, coalesce((SELECT max(ts) FROM evidence e WHERE e.gid = f.id) < {NOW_S - 72 * 3600}, false)
   AND (decision IS NULL OR (decision = 'rca' AND NOT (lane_a_done AND lane_b_done))) AS gone FROM findings f)"""


@query("ret_expire_evidence", sql(f"""SELECT 'finding' AS kind, id, CASE WHEN gone THEN 'evidence_expired' ELSE decision END AS state FROM aged
    UNION ALL SELECT 'batch', batch_id, CASE WHEN any_value(status) = 'running' AND bool_or(id IN (SELECT id FROM aged WHERE gone)) THEN 'blocked' ELSE any_value(status) END FROM members GROUP BY batch_id
    UNION ALL SELECT 'evidence', id, NULL FROM evidence WHERE ts >= {NOW_S - 72 * 3600}""", _EXPIRED))
def expire_evidence(spark, folder):
    evidence, findings = _tables(spark, folder, "evidence", "findings")
    kept, updated, blocked = O.expire(evidence, findings, batches(spark, folder), now())
    return updated.select(F.lit("finding").alias("kind"), "id", F.col("decision").alias("state")).union(
        blocked.select(F.lit("batch"), "id", "status")).union(kept.select(F.lit("evidence"), "id", F.lit(None).cast("string")))


# --- coverage ---------------------------------------------------------------------------------------
COVERED = LATEST + """, cutoffs AS (SELECT finding_id, max(history_id) AS cutoff FROM coverage WHERE reopened_at IS NOT NULL GROUP BY finding_id),
 basis AS (SELECT l.gid AS id, l.id AS evidence_id, l.signature, l.scope_key, l.impact, l.text FROM latest l JOIN findings f ON f.id = l.gid
   WHERE f.decision IS NULL OR f.decision = 'rca' OR f.id IN (SELECT finding_id FROM coverage)),
 covered AS (SELECT b.id, arg_min(c.history_id, {'a': c.completed_at, 'b': c.history_id}) AS history_id FROM basis b LEFT JOIN cutoffs x ON x.finding_id = b.id
   JOIN coverage c ON c.signature = b.signature AND c.reopened_at IS NULL AND c.history_id > coalesce(x.cutoff, -1) GROUP BY b.id),
 own AS (SELECT finding_id, arg_min({'s': scope_key, 'i': impact, 'h': history_id}, {'a': completed_at, 'b': history_id}) AS prior, list_sort(list(DISTINCT history_id))[1:3] AS ids FROM coverage GROUP BY finding_id),
 shared AS (SELECT scope_key, arg_min({'s': scope_key, 'i': impact, 'h': history_id}, {'a': completed_at, 'b': history_id}) AS prior, list_sort(list(DISTINCT history_id))[1:3] AS ids FROM coverage WHERE concrete GROUP BY scope_key),
 doubtful AS (SELECT b.id, CASE WHEN b.scope_key = coalesce(o.prior, s.prior).s AND b.impact IS NOT DISTINCT FROM coalesce(o.prior, s.prior).i THEN 'uncertain' ELSE 'reopen' END AS state,
   coalesce(o.ids, s.ids) AS ids, coalesce(o.prior, s.prior).h AS prior_id FROM basis b JOIN findings f ON f.id = b.id AND (f.decision IS NULL OR f.decision = 'rca')
   LEFT JOIN own o ON o.finding_id = b.id LEFT JOIN shared s ON s.scope_key = b.scope_key
   WHERE b.id NOT IN (SELECT id FROM covered) AND b.id NOT IN (SELECT finding_id FROM cutoffs) AND coalesce(o.prior, s.prior) IS NOT NULL),
 held AS (SELECT DISTINCT id FROM members WHERE status IN ('running', 'blocked')),
 busy AS (SELECT id FROM held UNION SELECT id FROM basis WHERE signature IN (SELECT signature FROM basis WHERE id IN (SELECT id FROM held)))"""


def ledger(spark, folder):
    """Findings, coverage and the current evidence of the findings that matter."""
    evidence, findings, coverage = _tables(spark, folder, "evidence", "findings", "coverage")
    return findings, coverage, C.basis(evidence, findings, coverage)


@query("join_coverage_exact", sql("SELECT id, history_id FROM covered", COVERED))
def coverage_exact(spark, folder):
    _, coverage, current = ledger(spark, folder)
    return C.covered(current, coverage)


@query("join_coverage_uncertain", sql(f"SELECT id, state, {d.join('ids')} AS history_ids, prior_id FROM doubtful", COVERED))
def coverage_uncertain(spark, folder):
    findings, coverage, current = ledger(spark, folder)
    rows = C.uncertain(current, findings, coverage, C.covered(current, coverage))
    return rows.select("id", "state", F.array_join("history_ids", "|").alias("history_ids"), "prior_id")


@query("join_busy_aliases", sql("SELECT id FROM busy", COVERED))
def busy_aliases(spark, folder):
    return C.busy(C.held(batches(spark, folder)), ledger(spark, folder)[2])


@query("ledger_promote_serious", sql("""SELECT s.gid AS id, s.serious, s.first_seen,
    'Deterministic urgent observation; cause unverified: ' || s.serious || ' observed in unreviewed finding ' || s.gid AS reason
    FROM first_serious s JOIN findings f ON f.id = s.gid WHERE f.decision IS NULL AND s.gid NOT IN (SELECT id FROM worked_on)
      AND s.gid NOT IN (SELECT id FROM basis WHERE signature IN (SELECT signature FROM basis WHERE id IN (SELECT id FROM worked_on)))""", COVERED, _SERIOUS,
    "worked_on AS (SELECT id FROM covered UNION SELECT id FROM doubtful WHERE state = 'uncertain' UNION SELECT id FROM held)"))
def promote_serious(spark, folder):
    findings, coverage, current = ledger(spark, folder)
    done = C.covered(current, coverage)
    doubt = C.uncertain(current, findings, coverage, done).filter("state = 'uncertain'")
    worked_on = done.select("id").union(doubt.select("id")).union(C.held(batches(spark, folder)))
    return O.promote(findings, read(spark, folder, "evidence"), C.busy(worked_on, current))


_ELIGIBLE = """SELECT id, '{kind}' AS kind FROM findings f WHERE (decision IS NULL OR decision = 'rca') AND id NOT IN (SELECT id FROM covered) AND id NOT IN (SELECT id FROM busy)
    AND id IN (SELECT gid FROM evidence) AND {test}"""
_UNC = "id IN (SELECT id FROM doubtful WHERE state = 'uncertain')"


@query("join_eligible", sql(_ELIGIBLE.format(kind="triage", test=f"(decision IS NULL OR {_UNC})") + " UNION ALL "
                            + _ELIGIBLE.format(kind="rca-a", test=f"(decision = 'rca' AND NOT {_UNC})"), COVERED))
def eligible(spark, folder):
    findings, coverage, current = ledger(spark, folder)
    done = C.covered(current, coverage)
    doubt = C.uncertain(current, findings, coverage, done).filter("state = 'uncertain'")
    held = C.busy(C.held(batches(spark, folder)), current)
    evidence = read(spark, folder, "evidence")
    parts = [O.eligible(findings, evidence, done, doubt, held, kind).select("id", F.lit(kind).alias("kind")) for kind in ("triage", "rca-a")]
    return parts[0].union(parts[1])


_ITEM_FIELDS = {
    "agent": "l.profile", "evidence": "l.id", "evidence_rows": "t.n", "first": "t.first", "id": "l.gid", "last": "t.last",
    "prior_status": "{'decision': f.decision, 'lane_a_done': f.lane_a_done, 'lane_b_done': f.lane_b_done, 'reason': f.reason, 'reviewed_at': f.reviewed_at}",
    "sample": "substr(l.text, 1, 240)", "sample_original_chars": "length(l.text)", "sample_truncated": "length(l.text) > 240",
    **{n: f"l.{n}" for n in ("host", "function", "event", "cause", "provider", "model", "component", "severity")}}
_ITEM_STRUCT = "{" + ", ".join(f"'{n}': {_ITEM_FIELDS[n]}" for n in sorted(_ITEM_FIELDS)) + "}"
PACKET_BYTES = 12_000
_ITEMS = f"""triage AS ({_ELIGIBLE.format(kind="triage", test=f"(decision IS NULL OR {_UNC})")}),
 items AS (SELECT l.gid AS id, CAST(to_json({_ITEM_STRUCT}) AS STRING) AS json, b.label IS NOT NULL AS serious, t.last FROM latest l JOIN findings f ON f.id = l.gid
   JOIN (SELECT gid, count(*) AS n, min(ts) AS first, max(ts) AS last FROM evidence GROUP BY gid) t ON t.gid = l.gid JOIN labelled b ON b.id = l.id
   WHERE l.gid IN (SELECT id FROM triage))"""


@query("pack_budget_prefix", sql(f"""SELECT id, item_md5, used_bytes FROM (SELECT id, md5(json) AS item_md5, CAST(sum(strlen(json) + 1) OVER (ORDER BY serious DESC, last DESC, id ROWS UNBOUNDED PRECEDING) - 1
      + strlen('{{"batch":"bbbbbbbbbbbbbbbbbbbb","items":[],"kind":"triage","pending_findings":' || (SELECT count(*) FROM triage) || ',"wakeAgent":true}}') AS BIGINT) AS used_bytes FROM items)
    WHERE used_bytes <= {PACKET_BYTES}""", COVERED, _SERIOUS, _ITEMS))
def budget_prefix(spark, folder):
    findings, coverage, current = ledger(spark, folder)
    evidence = read(spark, folder, "evidence")
    done = C.covered(current, coverage)
    doubt = C.uncertain(current, findings, coverage, done).filter("state = 'uncertain'")
    wanted = O.eligible(findings, evidence, done, doubt, C.busy(C.held(batches(spark, folder)), current), "triage").select("id")
    items = O.review_items(evidence, findings).join(wanted, "id", "left_semi").withColumn("serious", Z.serious_label(F.col("text")).isNotNull())
    packet = K.packet_prefix(items, [F.col("serious").desc(), F.col("last").desc(), F.col("id").asc()], "triage", PACKET_BYTES)
    return packet.select("id", F.md5(F.to_json("item", {"ignoreNullFields": "false"})).alias("item_md5"), "used_bytes")


@query("set_subset_covered", sql("SELECT batch_id FROM members GROUP BY batch_id HAVING bool_and(id IN (SELECT id FROM findings WHERE seq % 8 <> 3))"))
def subset_covered(spark, folder):
    return O.fully_covered(batches(spark, folder), read(spark, folder, "findings").filter("seq % 8 <> 3").select("id"))


_CLAIMS = """claims AS (SELECT c.finding_id AS history_finding, c.scope_key AS history_scope_key, f.id AS finding_id, c.history_id AS relationship_history_id, c.concrete,
   CASE WHEN c.history_id % 4 = 0 THEN md5('other') ELSE c.scope_key END AS scope_key,
   CASE WHEN c.history_id % 6 = 0 THEN concat(f.id, ' was seen again; same mechanism as ', f.id, ' was shown by the second check')
        WHEN c.history_id % 3 = 0 THEN concat('same mechanism as ', f.id, ' was shown by the second check') WHEN c.history_id % 3 = 1 THEN concat('possibly the same problem as ', f.id)
        ELSE concat('same mechanism as ', c.finding_id, ' was shown by the second check') END AS quote
  FROM coverage c JOIN findings f ON f.seq = c.history_id)"""


@query("join_relation_citation", sql(f"""SELECT relationship_history_id, coalesce(scope_key = history_scope_key AND concrete AND h.finding_id IN (c.finding_id, history_finding)
    AND length(quote) BETWEEN 30 AND 3000 AND contains(h.report_text, quote) AND contains(quote, other) AND NOT {d.has('quote', P.RELATION_HEDGE)}
    AND regexp_matches(quote, {d.q(P.RELATION_CLAIM + '[^' + chr(92) + 'n]{0,250}')} || other), false) AS holds
    FROM (SELECT c.*, CASE WHEN h.finding_id = history_finding THEN c.finding_id ELSE history_finding END AS other FROM claims c LEFT JOIN history h ON h.id = c.relationship_history_id) c
    LEFT JOIN history h ON h.id = c.relationship_history_id""", _CLAIMS))
def relation_citation(spark, folder):
    for name in ("coverage", "findings"):
        read(spark, folder, name).createOrReplaceTempView(name)
    claims = spark.sql(f"WITH {_CLAIMS} SELECT * FROM claims")
    return C.relations(claims, read(spark, folder, "history")).select("relationship_history_id", "holds")


_REOPEN = """reopen_claims AS (SELECT concat('c', CAST(b.line_id AS STRING)) AS claim_id, b.gid AS finding_id, CASE WHEN b.line_id % 5 = 0 THEN 'old' ELSE b.id END AS evidence_id,
   CASE WHEN b.line_id % 7 = 0 THEN 'short' ELSE substr(b.text, 1, 40) END AS quote, 'a concrete reason for a second look' AS reason,
   CASE WHEN b.line_id % 11 = 0 THEN 'owner' WHEN b.line_id % 13 = 0 THEN 'owner ticket 1234' END AS owner_authorization
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY ts DESC, id DESC) AS rn FROM evidence) z WHERE rn = 1) b)"""


@query("join_reopen_evidence", sql("""SELECT claim_id, coalesce(length(reason) BETWEEN 20 AND 1000 AND CASE WHEN coalesce(owner_authorization, '') <> '' THEN length(owner_authorization) >= 12
    ELSE l.id = evidence_id AND length(quote) BETWEEN 20 AND 3000 AND contains(l.text, quote)
      AND NOT EXISTS (SELECT 1 FROM coverage v WHERE v.finding_id = c.finding_id AND contains(v.evidence_text, c.quote)) END, false) AS accepted
    FROM reopen_claims c LEFT JOIN latest l ON l.gid = c.finding_id""", LATEST, _REOPEN))
def reopen_evidence(spark, folder):
    evidence, coverage = _tables(spark, folder, "evidence", "coverage")
    evidence.createOrReplaceTempView("evidence")
    claims = spark.sql(f"WITH {_REOPEN} SELECT * FROM reopen_claims")
    return C.reopenings(claims, evidence, coverage).select("claim_id", "accepted")


# --- status -----------------------------------------------------------------------------------------
@query("agg_review_status", sql(f"""SELECT name, CAST(value AS BIGINT) AS value FROM (
    SELECT 'pending_triage' AS name, (SELECT count(*) FROM findings WHERE (decision IS NULL AND id NOT IN (SELECT id FROM covered)) OR (decision = 'rca' AND {_UNC})) AS value
    UNION ALL SELECT 'pending_investigation', (SELECT count(*) FROM findings WHERE decision = 'rca' AND id NOT IN (SELECT id FROM covered) AND NOT {_UNC})
    UNION ALL SELECT 'covered', (SELECT count(*) FROM covered) UNION ALL SELECT 'uncertain', (SELECT count(*) FROM doubtful WHERE state = 'uncertain')
    UNION ALL SELECT 'reopened', (SELECT count(*) FROM cutoffs WHERE finding_id IN (SELECT id FROM findings)) UNION ALL SELECT 'findings', (SELECT count(*) FROM findings)
    UNION ALL SELECT 'evidence_expired', 0 UNION ALL SELECT 'evidence', (SELECT count(*) FROM evidence)
    UNION ALL SELECT 'active_leases', (SELECT count(DISTINCT batch_id) FROM members WHERE status = 'running' AND lease_until > {NOW_S})
    UNION ALL SELECT 'retry_eligible', (SELECT count(DISTINCT batch_id) FROM members WHERE status = 'running' AND lease_until <= {NOW_S})
    UNION ALL SELECT 'blocked_batches', (SELECT count(DISTINCT batch_id) FROM members WHERE status = 'blocked'))""", COVERED))
def review_status(spark, folder):
    findings, coverage, current = ledger(spark, folder)
    evidence = read(spark, folder, "evidence")
    done = C.covered(current, coverage)
    doubt = C.uncertain(current, findings, coverage, done).filter("state = 'uncertain'")
    reopened = coverage.filter("reopened_at IS NOT NULL").select(F.col("finding_id").alias("id"))
    return O.review_status(findings, evidence, batches(spark, folder), done, doubt, reopened, now())


_DELIVERY_SQL = """SELECT name, CAST(value AS BIGINT) AS value FROM (
    SELECT 'pending_repairs' AS name, (SELECT count(*) FROM incidents WHERE status IN ('open', 'repair assigned', 'repairing')) AS value
    UNION ALL SELECT 'deferred_incidents', (SELECT count(*) FROM incidents WHERE status = 'deferred')
    UNION ALL SELECT 'delivery_pending', (SELECT count(*) FROM deliveries WHERE publication_state <> 'published')
    UNION ALL SELECT 'unregistered_history', (SELECT count(*) FROM history h WHERE NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.batch_id = h.batch_id))
    UNION ALL SELECT 'pending_answers', (SELECT count(*) FROM delivery_events a WHERE kind = 'answer' AND NOT EXISTS (SELECT 1 FROM delivery_events b WHERE b.event_id = 'ack:' || a.event_id)))"""


def _delivery(spark, folder):
    return O.delivery_status(*_tables(spark, folder, "history", "deliveries", "incidents", "delivery_events"))


@query("agg_delivery_status", sql(_DELIVERY_SQL))
def delivery_status(spark, folder):
    return _delivery(spark, folder)


@query("agg_daily_balance", sql("""SELECT '{' || string_agg('"' || name || '":' || CAST(value AS STRING), ',' ORDER BY name) || '}' AS packet, true AS changed,
    sha256('{' || string_agg('"' || name || '":' || CAST(value AS STRING), ',' ORDER BY name) || '}') AS digest FROM (
    SELECT name, value FROM delivered UNION ALL (SELECT 'history:' || CAST(id AS STRING), completed_at FROM history ORDER BY completed_at DESC, id DESC LIMIT 5))""",
                                  f"delivered AS ({_DELIVERY_SQL})"))
def daily_balance(spark, folder):
    return O.daily_balance(_delivery(spark, folder), read(spark, folder, "history"))


@query("top_history", sql("""(SELECT 'report' AS kind, CAST(id AS STRING) AS id, completed_at AS at FROM history ORDER BY completed_at DESC, history.id DESC LIMIT 20)
    UNION ALL (SELECT 'decision', id, reviewed_at FROM findings WHERE decision IS NOT NULL ORDER BY reviewed_at DESC, id DESC LIMIT 20)"""))
def top_history(spark, folder):
    return O.top_history(*_tables(spark, folder, "history", "findings"))


@query("join_unacked", sql("""SELECT 'answer' AS kind, event_id AS id FROM delivery_events a WHERE kind = 'answer' AND NOT EXISTS (SELECT 1 FROM delivery_events b WHERE b.event_id = 'ack:' || a.event_id)
    UNION ALL SELECT 'history', CAST(id AS STRING) FROM history h WHERE NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.batch_id = h.batch_id)"""))
def unacked(spark, folder):
    events, history, deliveries = _tables(spark, folder, "delivery_events", "history", "deliveries")
    answers = O.unacknowledged(events).select(F.lit("answer").alias("kind"), F.col("event_id").alias("id"))
    return answers.union(O.undelivered(history, deliveries).select(F.lit("history"), F.col("id").cast("string")))


_DISK = """files AS (SELECT source_path AS name, count(*) AS modified, max(byte_end) AS size FROM lines GROUP BY source_path),
 disk AS (SELECT * FROM files WHERE size % 5 <> 1), stamps AS (SELECT name, modified + CASE WHEN size % 7 = 2 THEN 1 ELSE 0 END AS modified, size FROM files WHERE size % 3 <> 1),
 archived AS (SELECT name FROM files WHERE size % 2 = 0)"""


@query("join_retention_gap", sql("""SELECT d.name, 'unsynced' AS gap FROM disk d LEFT JOIN stamps s USING (name) WHERE s.name IS NULL OR s.modified <> d.modified OR s.size <> d.size
    UNION ALL SELECT name, 'missing' FROM stamps WHERE name NOT IN (SELECT name FROM disk) AND name NOT IN (SELECT name FROM archived)""", _DISK))
def retention_gap(spark, folder):
    adapters.lines(spark, folder).createOrReplaceTempView("lines")
    disk, stamps, archived = [spark.sql(f"WITH {_DISK} SELECT * FROM {n}") for n in ("disk", "stamps", "archived")]
    return O.retention_gaps(disk, stamps, archived)


@query("stream_notice_dedupe", sql("SELECT DISTINCT md5(text) AS notice_key, CAST(1 AS BIGINT) AS times FROM evidence"))
def notice_dedupe(spark, folder):
    rows = read(spark, folder, "evidence").select(F.md5("text").alias("notice_key"), F.col("text").alias("message"))
    notices = adapters.stage(spark, folder, "notices", lambda: rows.repartition(6))
    path = Q._fresh(spark, "notices")

    def send(new, batch):
        new.select("notice_key").write.mode("append").parquet(f"{path}/sent")

    # The second run has lost its checkpoint: every micro-batch comes again.
    for attempt in ("one", "two"):
        stream = ST._stream(spark, notices)
        ST._finish(jobs.send_new_notices(stream, f"{path}/ledger", f"{path}/checkpoint-{attempt}", send))
    return spark.read.parquet(f"{path}/sent").groupBy("notice_key").agg(F.count("*").alias("times"))


# --- reports and repairs ------------------------------------------------------------------------------
@query("fn_report_sections", sql(f"""SELECT id, {d.join(d.compact([f"CASE WHEN NOT {d.has('report_text', p)} THEN {d.q(n)} END" for n, p in P.REPORT_SECTIONS]))} AS missing,
    length(trim(report_text)) >= 100 AND {' AND '.join(d.has('report_text', p) for _, p in P.REPORT_SECTIONS)} AS valid FROM history"""))
def report_sections(spark, folder):
    return C.validate_reports(read(spark, folder, "history")).select("id", F.array_join("missing_sections", "|").alias("missing"), "valid")


@query("fn_report_outcome", sql("""SELECT id, CASE seq % 3 WHEN 0 THEN 'inconclusive' WHEN 1 THEN 'diagnosed' ELSE 'investigated' END AS outcome,
    7 + CAST(seq % 5 <> 0 AS BIGINT) + CAST(seq % 4 <> 0 AS BIGINT) AS headings,
    CASE seq % 3 WHEN 0 THEN 'The mechanism is undetermined.' WHEN 1 THEN 'The root cause was identified as a full disk.' ELSE 'A disk was full.' END AS excerpt FROM history"""))
def report_outcome(spark, folder):
    return C.report_outcome(read(spark, folder, "history")).select(
        "id", "outcome", F.size("headings").cast("bigint").alias("headings"), F.trim("cause_excerpt").alias("excerpt"))


def repairs(spark, folder):
    listed = F.when(F.col("attempt_list") == "", F.array().cast("array<string>")).otherwise(F.split("attempt_list", ","))
    return read(spark, folder, "repairs").withColumn("attempts", listed).withColumn("revision", F.col("revision").cast("bigint"))


_PAIRS = ", ".join(f"({d.q(a)}, {d.q(b)})" for a, b in P.REPAIR_TRANSITIONS)
_LINKED = f"""linked AS (SELECT r.*, p.status AS before, p.attempt_list AS before_list, p.report_id IS NOT NULL AS has_before FROM repairs r
   LEFT JOIN repairs p ON p.report_id = r.report_id AND p.revision = r.revision - 1),
 ruled AS (SELECT report_id, revision, 'revision gap' AS rule FROM linked WHERE revision > 1 AND NOT has_before
   UNION ALL SELECT report_id, revision, 'transition' FROM linked WHERE has_before AND before <> status AND (before, status) NOT IN ({_PAIRS})
   UNION ALL SELECT report_id, revision, 'assignee' FROM linked WHERE status IN ('repair assigned', 'repairing') AND assigned_agent IS NULL
   UNION ALL SELECT report_id, revision, 'checks' FROM linked WHERE status = 'fixed' AND NOT (coalesce(checks_passed, false) AND attempt_list <> '')
   UNION ALL SELECT report_id, revision, 'owner confirmation' FROM linked WHERE status = 'verified by owner' AND owner_confirmation IS NULL
   UNION ALL SELECT report_id, revision, 'reason' FROM linked WHERE status IN ('deferred', 'won''t fix') AND reason IS NULL)"""


@query("win_transition_audit", sql("SELECT report_id, CAST(revision AS BIGINT) AS revision, rule FROM ruled", _LINKED))
def transition_audit(spark, folder):
    return RP.transition_audit(repairs(spark, folder))


@query("win_append_only_audit", sql("""SELECT report_id, CAST(revision AS BIGINT) AS revision FROM linked WHERE has_before AND before_list <> ''
    AND attempt_list <> before_list AND NOT starts_with(attempt_list, before_list || ',')""", _LINKED))
def append_only_audit(spark, folder):
    return RP.append_only_audit(repairs(spark, folder))


@query("join_sibling_sync", sql("""SELECT r.report_id, CAST(r.revision AS BIGINT) AS revision, n.status, n.report_id AS synced_from, n.attempt_list AS attempts, n.assigned_agent,
    n.checks_passed, n.reason, n.owner_confirmation FROM repairs r JOIN
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id, episode ORDER BY revision DESC, report_id DESC) AS rn FROM repairs) WHERE rn = 1) n
    ON n.finding_id = r.finding_id AND n.episode = r.episode"""))
def sibling_sync(spark, folder):
    return RP.sync_siblings(repairs(spark, folder)).select(
        "report_id", "revision", "status", "synced_from", F.array_join("attempts", ",").alias("attempts"), "assigned_agent", "checks_passed", "reason", "owner_confirmation")


@query("join_recurrence_episode", sql("""SELECT finding_id, CASE WHEN again THEN 'open' ELSE status END AS status, CAST(episode + CASE WHEN again THEN 1 ELSE 0 END AS BIGINT) AS episode, again AS recurred FROM
    (SELECT i.*, coalesce(closed_at IS NOT NULL AND m.created > closed_at AND l.last_ts > greatest(coalesce(evidence_cutoff, 0), closed_at), false) AS again FROM incidents i
     LEFT JOIN (SELECT gid, max(ts) AS last_ts FROM evidence GROUP BY gid) l ON l.gid = i.finding_id LEFT JOIN (SELECT id, max(created) AS created FROM members GROUP BY id) m ON m.id = i.finding_id)"""))
def recurrence_episode(spark, folder):
    incidents, evidence, members = _tables(spark, folder, "incidents", "evidence", "members")
    rows = RP.episodes(incidents, evidence, members.select(F.col("id").alias("finding_id"), "created"))
    return rows.select("finding_id", "status", F.col("episode").cast("bigint").alias("episode"), "recurred")
