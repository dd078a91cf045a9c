"""The ledger of the enriched records, and ledger tables that no record can give.

Evidence comes from the enriched store by the library's own identities; the oracle derives it from its own store. Human
decisions, batches, reports and repairs follow modulo rules on the first record of a finding, so every case occurs at every
scale; their SQL text is read by both engines. Times are epoch seconds.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import identity as I
from tracewell.functions import regex as rx
from tracewell.operators import evidence as EV
from tracewell.queries import adapters, duck as d, groups as Q, rules as R
from tracewell.queries.streams import _BARE, _STEPS
from tracewell.queries.text import HOST_ALIASES

NOW_S = 1704067200 + 29 * 86400 + 12 * 3600

# An earlier version did not collapse runs and cooldown times: what it stored has keys of its own.
_MARK = f"coalesce({d.first('text', P.SCHEDULED_RUN)}, {d.first('text', P.COOLDOWN_EXPIRY)})"
_EVIDENCE = f"""
  SELECT {d.digest('host', 'profile', 'source_path', 'line_id', 'byte_start', 'byte_end', 'NULL', d.iso('event_at'), 'text')} AS id,
    left({d.digest("CASE WHEN line_id % 2 = 0 AND mark IS NOT NULL THEN " + d.digest('fingerprint', 'mark') + " ELSE fingerprint END", 'severity')}, 20) AS gid,
    CASE WHEN {d.has('text', P.SCHEDULED_RUN)} OR {d.has('text', P.COOLDOWN_EXPIRY)} THEN {d.digest('fingerprint', 'severity')} END AS canonical_key,
    CAST(epoch(event_at) AS BIGINT) AS ts, event, cause, provider, model, component, {R.SLOT} AS function, severity, record_role, scope_key, concrete, impact,
    {d.digest('scope_key', 'covered_text', 'severity', 'impact')} AS signature, host, profile, text, line_id
  FROM (SELECT *, {d.digest("CASE WHEN lower(trim(host)) = 'node-b' THEN 'beta' ELSE trim(host) END", 'profile', 'provider', 'model', 'target', d.packed_list('paths'), d.packed_list('jobs'))} AS scope_key,
      len(paths) > 0 OR len(jobs) > 0 OR (provider IS NOT NULL AND model IS NOT NULL) AS concrete, trim({d.subs('text', _STEPS)}) AS covered_text
    FROM (SELECT *, list_sort(list_distinct(list_concat({d.every(_BARE, P.POSIX_PATH, 2)}, {d.every(_BARE, P.WINDOWS_PATH)}))) AS paths,
        list_sort({d.distinct(d.every('text', P.SCHEDULED_RUN, 1))}) AS jobs, {_MARK} AS mark, CASE WHEN line_id % 13 = 0 THEN 'outage' END AS impact,
        CASE WHEN kind = 'continuation' THEN 'continuation' ELSE 'parent' END AS record_role
      FROM stored) a) b
"""
_FINDINGS = """
  SELECT gid AS id, seq, CASE seq % 7 WHEN 2 THEN 'rca' WHEN 3 THEN 'watch' WHEN 4 THEN 'informational' WHEN 5 THEN 'tracked' WHEN 6 THEN 'rca' END AS decision,
    CASE WHEN seq % 7 > 1 THEN concat('decided by rule ', CAST(seq % 7 AS STRING)) END AS reason,
    CASE WHEN seq % 7 > 1 THEN first_ts + (seq % 48) * 3600 END AS reviewed_at,
    seq % 4 = 0 AS lane_a_done, seq % 6 = 0 AS lane_b_done, first_ts
  FROM (SELECT gid, min(line_id) AS seq, min(ts) AS first_ts FROM evidence GROUP BY gid) f
"""
_MEMBERS = """
  SELECT concat('b', CAST(bucket AS STRING)) AS batch_id, id, seq, bucket,
    CASE bucket % 3 WHEN 0 THEN 'triage' WHEN 1 THEN 'rca-a' ELSE 'rca-b' END AS kind,
    CASE bucket % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'blocked' WHEN 2 THEN 'done' WHEN 3 THEN 'covered' ELSE 'running' END AS status,
    bucket % 3 AS attempts, {now} + (bucket % 7 - 3) * 600 AS lease_until, {now} - bucket % 400 * 3600 AS created
  FROM (SELECT id, seq, CAST(floor(seq / 37) AS BIGINT) AS bucket FROM findings) x WHERE seq % 3 <> 1
"""
_HISTORY = """
  SELECT f.seq AS id, f.id AS finding_id, concat('b', CAST(CAST(floor(f.seq / 37) AS BIGINT) AS STRING)) AS batch_id,
    CASE WHEN f.seq % 2 = 0 THEN 'a' ELSE 'b' END AS lane, f.first_ts + 172800 + f.seq % 1000 AS completed_at,
    concat('# Incident ', CAST(f.seq AS STRING), chr(10), '## Observed impact', chr(10), 'Requests were lost in this window.', chr(10),
      '## Timeline', chr(10), 'Seen first at noon.', chr(10), '## Facts', chr(10), 'The log says so.', chr(10), CASE WHEN f.seq % 5 = 0 THEN '' ELSE concat('## Checks', chr(10), 'Two checks were run.', chr(10)) END,
      '## Root cause', chr(10), CASE f.seq % 3 WHEN 0 THEN 'The mechanism is undetermined.' WHEN 1 THEN 'The root cause was identified as a full disk.' ELSE 'A disk was full.' END, chr(10),
      '## Proposed fix', chr(10), 'Free the disk.', chr(10), '## Risks', chr(10), 'None known.', chr(10), CASE WHEN f.seq % 4 = 0 THEN '' ELSE concat('## Rollback', chr(10), 'Restore.', chr(10)) END,
      '## Verification', chr(10), f.id, ' was seen again; same mechanism as ', f.id, ' was shown by the second check of this report') AS report_text, f.seq AS seq
  FROM findings f WHERE f.seq % 7 IN (2, 3, 6) AND f.seq % 2 = 0
"""
_COVERAGE = """
  SELECT h.finding_id, h.id AS history_id, h.completed_at, e.signature, e.scope_key, e.concrete, e.impact, e.id AS evidence_id, e.text AS evidence_text,
    CASE WHEN h.seq % 11 = 0 THEN h.completed_at + 60 END AS reopened_at
  FROM history h JOIN evidence e ON e.line_id = h.seq
"""
_RESULTS = """
  SELECT batch_id, CASE WHEN seq % 23 = 7 THEN concat('x', id) ELSE id END AS id,
    CASE seq % 29 WHEN 5 THEN 'unknown' ELSE CASE seq % 4 WHEN 0 THEN 'watch' WHEN 1 THEN 'rca' WHEN 2 THEN 'informational' ELSE 'tracked' END END AS decision,
    CASE WHEN seq % 31 = 3 THEN 'short' ELSE concat('reviewed with care, case ', CAST(seq AS STRING)) END AS reason
  FROM members WHERE kind = 'triage' AND bucket % 2 = 0 AND (bucket % 4 <> 0 OR seq % 17 <> 3)
  UNION ALL
  SELECT batch_id, id, 'watch', 'a second answer for the same id' FROM members WHERE kind = 'triage' AND bucket % 2 = 0 AND seq % 41 = 6
"""
_REPAIRS = """
  SELECT concat('r', CAST(id AS STRING)) AS report_id, finding_id, seq % 3 AS episode, revision + CASE WHEN seq % 7 = 2 AND revision = 4 THEN 1 ELSE 0 END AS revision, seq,
    CASE revision WHEN 1 THEN 'open' WHEN 2 THEN 'repair assigned' WHEN 3 THEN CASE WHEN seq % 5 = 0 THEN 'verified by owner' ELSE 'repairing' END
      ELSE CASE WHEN seq % 13 = 0 THEN 'deferred' ELSE 'fixed' END END AS status,
    CASE WHEN revision > 1 AND seq % 8 <> 0 THEN 'team' END AS assigned_agent, CASE WHEN seq % 26 = 0 THEN 'on hold' END AS reason,
    CASE WHEN seq % 9 = 0 THEN 'owner note' END AS owner_confirmation, seq % 10 <> 2 AS checks_passed,
    CASE revision WHEN 1 THEN '' WHEN 2 THEN 'a1' WHEN 3 THEN CASE WHEN seq % 6 = 0 THEN 'changed,a2' ELSE 'a1,a2' END ELSE 'a1,a2,a3' END AS attempt_list
  FROM (SELECT id, finding_id, seq, 1 AS revision FROM history UNION ALL SELECT id, finding_id, seq, 2 FROM history
        UNION ALL SELECT id, finding_id, seq, 3 FROM history UNION ALL SELECT id, finding_id, seq, 4 FROM history) v
"""
_EVENTS = """
  SELECT concat('ans', CAST(seq AS STRING)) AS event_id, id AS finding_id, 'answer' AS kind FROM findings WHERE seq % 5 = 1
  UNION ALL SELECT concat('ack:ans', CAST(seq AS STRING)), id, 'ack' FROM findings WHERE seq % 10 = 1
"""
_INCIDENTS = """
  SELECT finding_id, CASE seq % 6 WHEN 0 THEN 'open' WHEN 1 THEN 'repairing' WHEN 2 THEN 'fixed' WHEN 3 THEN 'deferred' WHEN 4 THEN 'repair assigned' ELSE 'verified by owner' END AS status,
    CASE WHEN seq % 6 IN (2, 5) THEN completed_at + 86400 END AS closed_at, completed_at + seq % 3 * 90000 AS evidence_cutoff, 1 + seq % 2 AS episode, seq
  FROM history
"""
_DELIVERIES = """
  SELECT concat('r', CAST(id AS STRING)) AS report_id, batch_id, finding_id, CASE WHEN seq % 4 = 0 THEN 'pending' ELSE 'published' END AS publication_state FROM history WHERE seq % 5 <> 0
"""

TABLES = [("findings", _FINDINGS), ("members", _MEMBERS.replace("{now}", str(NOW_S))), ("history", _HISTORY),
          ("coverage", _COVERAGE), ("results", _RESULTS), ("repairs", _REPAIRS), ("delivery_events", _EVENTS),
          ("incidents", _INCIDENTS), ("deliveries", _DELIVERIES)]
LEDGER = ", ".join(f"{name} AS ({text})" for name, text in TABLES)


def evidence(spark, folder):
    """Evidence of all enriched records; every second recurring one was stored by an earlier version."""
    def build():
        mark = F.coalesce(rx.first(F.col("text"), P.SCHEDULED_RUN), rx.first(F.col("text"), P.COOLDOWN_EXPIRY))
        key = F.col("fingerprint.key")
        rows = Q.store(spark, folder).withColumns({
            "known_key": F.when((F.col("line_id") % 2 == 0) & mark.isNotNull(), I.digest(key, mark)),
            "impact": F.when(F.col("line_id") % 13 == 0, "outage"),
            "record_role": F.when(F.col("classification.kind") == "continuation", "continuation").otherwise("parent")})
        return EV.evidence_rows(rows, HOST_ALIASES, keep=("line_id",))
    return adapters.stage(spark, folder, "ledger_evidence", build)


def read(spark, folder, name):
    """One ledger table, stored like a ledger would be."""
    if name == "evidence":
        return evidence(spark, folder)

    def build():
        evidence(spark, folder).createOrReplaceTempView("evidence")
        return spark.sql(f"WITH {LEDGER} SELECT * FROM {name}")
    return adapters.stage(spark, folder, f"ledger_{name}", build)


def sql(select: str, *ctes: str) -> str:
    return Q.with_store(select, f"evidence AS MATERIALIZED ({_EVIDENCE})", LEDGER, *ctes)
