"""Sources, filters and folding over log lines."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import patterns as P, session
from tracewell.functions import text as T
from tracewell.operators import lines as L
from tracewell.queries import adapters, duck as d
from tracewell.queries.registry import query
from tracewell.queries.text import LEADING_CTE
from tracewell.sources import files as S, ranges as R

def now():
    return F.lit(adapters.NOW).cast("timestamp")

CHUNK = adapters.CHUNK_BYTES

_LEVEL = f"upper({d.first('text', P.LEVEL_GATE, 1)})"
_KEPT = ", ".join(d.q(x) for x in P.KEPT_LEVELS)
_PATH_WINDOW = "OVER (PARTITION BY source_path ORDER BY byte_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
KEEP = f"""decided AS (SELECT *, CASE WHEN {_LEVEL} IS NOT NULL THEN {_LEVEL} IN ({_KEPT})
     WHEN {d.has('text', P.CONTEXT_LINE)} THEN true END AS decision FROM staged),
 kept AS (SELECT *, CASE WHEN source_name LIKE 'errors.log%' THEN text <> ''
     ELSE coalesce(last_value(decision IGNORE NULLS) {_PATH_WINDOW}, false) END AS keep FROM decided)"""
ROLES = LEADING_CTE + ", " + KEEP + f""", heads AS (SELECT *, status <> 'ok' AND {d.has('text', P.CONTEXT_LINE)} AS child,
     coalesce(instant BETWEEN {d.NOW_TS} - INTERVAL 72 HOUR AND {d.NOW_TS}, false) AS fresh FROM kept),
 marked AS (SELECT *, keep AND NOT child AND fresh AS head, CASE WHEN keep AND NOT child AND fresh THEN byte_start
     WHEN NOT keep OR NOT child THEN -1 END AS marker FROM heads),
 opened AS (SELECT *, last_value(marker IGNORE NULLS) {_PATH_WINDOW} AS open_start FROM marked),
 roles AS (SELECT *, CASE WHEN head THEN 'parent' WHEN keep AND child AND coalesce(open_start, -1) >= 0 THEN 'continuation' END AS role FROM opened),
 records AS (SELECT *, CASE WHEN role IS NOT NULL THEN open_start END AS parent_start,
     CASE WHEN NOT keep THEN 'filtered' WHEN role IS NOT NULL THEN NULL WHEN child THEN 'missing'
          WHEN status = 'ok' THEN 'old' ELSE status END AS dropped FROM roles)"""


def kept(spark, folder):
    return L.keep_lines(adapters.lines(spark, folder), CHUNK)


def staged(spark, folder):
    return L.stage_lines(kept(spark, folder), now(), chunk_bytes=CHUNK)


def in_root(path="source_path"):
    """The part of an exported file's path that does not depend on the run."""
    return F.regexp_replace(path, r"^.*/files-(logs|jsonl)-[^/]+/", "")


def read_logs(spark, folder):
    root = adapters.log_files(spark, folder)
    per_host = [S.read_raw_logs(spark, f"{root}/{host}", host) for host in ("alpha", "Node-B", "gamma")]
    return per_host[0].unionByName(per_host[1]).unionByName(per_host[2])


@query("src_raw_logs", d.with_lines("""SELECT host, rel_path, path_profile AS profile, CASE WHEN source_name LIKE 'errors.log%' THEN 'errors.log' ELSE source_name END AS kind,
    first_byte AS byte_start, end_byte AS byte_end, md5(text) AS text_md5 FROM found""", adapters.EXPORTED))
def raw_logs(spark, folder):
    return read_logs(spark, folder).select("host", in_root().alias("rel_path"), "profile", "kind", "byte_start", "byte_end", F.md5("text").alias("text_md5"))


@query("src_line_capture", d.with_lines("""SELECT line_id, substr(text, 1, 800) AS text, length(text) > 800 AS text_truncated,
    length(text) + 1 AS original_text_bytes, sha256(text) AS content_hash FROM lines"""))
def line_capture(spark, folder):
    return adapters.lines(spark, folder).select("line_id", *[c.alias(n) for n, c in T.capture(F.col("text")).items()])


@query("src_malformed_boundary", d.with_lines("""SELECT m.line_id, coalesce(m.byte_start = f.first_bad, false) AS is_error FROM lines m JOIN
    (SELECT source_path, min(CASE WHEN line_id % 97 = 13 THEN byte_start END) AS first_bad FROM lines GROUP BY source_path) f
    USING (source_path) WHERE f.first_bad IS NULL OR m.byte_start <= f.first_bad"""))
def malformed_boundary(spark, folder):
    # One line in 97 is cut short before it is read as JSON.
    rows = adapters.lines(spark, folder).withColumn("raw", F.to_json(F.struct("text", "host")))
    rows = rows.withColumn("raw", F.when(F.col("line_id") % 97 == 13, F.lit('{"text": ')).otherwise(F.col("raw")))
    good, errors = L.split_at_first_bad(rows, "source_path", "byte_start", ~S.is_json_object(F.col("raw")))
    return good.select("line_id", F.lit(False).alias("is_error")).union(errors.select("line_id", F.lit(True).alias("is_error")))


@query("src_row_guard", d.with_lines("""SELECT source_path, count(*) FILTER (WHERE line_id % 211 <> 5) AS good_rows,
    count(*) FILTER (WHERE line_id % 211 = 5) AS rejected, NOT bool_or(line_id % 211 = 5) AS accepted FROM lines GROUP BY source_path"""))
def row_guard(spark, folder):
    bad = F.when(F.col("line_id") % 422 == 5, F.lit("[1, 2]")).when(F.col("line_id") % 422 == 216, F.lit("{broken"))
    rows = adapters.lines(spark, folder).select("source_path", F.coalesce(bad, F.to_json(F.struct("text"))).alias("row"))
    clean, rejects = S.guard(rows, "source_path", "row")
    counts = rows.groupBy("source_path").agg(F.count("*").alias("n"))
    rejected = rejects.groupBy("source_path").agg(F.count("*").alias("rejected"))
    accepted = clean.select("source_path").distinct().withColumn("accepted", F.lit(True))
    return counts.join(rejected, "source_path", "left").join(accepted, "source_path", "left").select(
        "source_path", (F.col("n") - F.coalesce("rejected", F.lit(0))).alias("good_rows"),
        F.coalesce("rejected", F.lit(0)).alias("rejected"), F.coalesce("accepted", F.lit(False)).alias("accepted"))


_TAILS = """physical AS (SELECT rel_path, first_byte, end_byte, 1 AS texts FROM found
   UNION ALL SELECT rel_path, end_byte, end_byte + 1, 0 FROM found WHERE line_id % 50 = 7),
 committed AS (SELECT rel_path, CASE WHEN size % 5 = 0 THEN size + 10 ELSE (SELECT max(end_byte) FROM found p WHERE p.rel_path = s.rel_path AND p.end_byte <= s.size / 2) END AS prior,
   size % 3 <> 0 AS same FROM sizes s WHERE size % 4 <> 0),
 state AS (SELECT s.*, coalesce(c.same AND s.size >= c.prior, false) AS known, coalesce(NOT c.same, false) AS rotated, coalesce(c.same AND s.size < c.prior, false) AS shrunk, c.prior
   FROM sizes s LEFT JOIN committed c USING (rel_path)),
 based AS (SELECT *, CASE WHEN known THEN prior ELSE greatest(0, size - 200000) END AS base FROM state),
 behind AS (SELECT b.*, p.first_byte, p.end_byte, p.texts FROM based b JOIN physical p ON p.rel_path = b.rel_path
   AND CASE WHEN known OR base = 0 THEN first_byte >= base ELSE first_byte > base END),
 begun AS (SELECT *, CASE WHEN known OR base = 0 THEN base ELSE min(first_byte) OVER (PARTITION BY rel_path) END AS start FROM behind)"""


@query("src_incremental_tail", d.with_lines("""SELECT b.rel_path, coalesce(n, 0) AS new_lines, first_start, coalesce(consumed, CASE WHEN known OR base = 0 THEN base ELSE size END) AS consumed,
    size - coalesce(consumed, CASE WHEN known OR base = 0 THEN base ELSE size END) AS backlog_bytes, rotated, shrunk FROM based b LEFT JOIN
    (SELECT rel_path, CAST(sum(texts) AS BIGINT) AS n, min(CASE WHEN texts = 1 THEN first_byte END) AS first_start, max(end_byte) AS consumed
     FROM begun WHERE first_byte - start < 50000 GROUP BY rel_path) l USING (rel_path)""", adapters.EXPORTED, _TAILS))
def incremental_tail(spark, folder):
    c = F.col
    root = adapters.log_files(spark, folder)
    listed = S.list_files(spark, [f"{root}/*/logs/*.log*", f"{root}/*/profiles/*/logs/*.log*"])
    files = session.cut_lineage(R.with_identity(listed.select(c("path").alias("source_path"), "size"), "source_path"))
    # The earlier run committed half of a file, up to the end of a line; some files were replaced or cut short since.
    halves = read_logs(spark, folder).join(files.select("source_path", "size"), "source_path").filter(c("byte_end") <= c("size") / 2)
    offsets = halves.groupBy("source_path").agg(F.max("byte_end").alias("offset"))
    committed = files.join(offsets, "source_path", "left").filter("size % 4 <> 0").select(
        "source_path", F.when(c("size") % 5 == 0, c("size") + 10).otherwise(c("offset")).alias("offset"),
        F.when(c("size") % 3 == 0, c("inode") + 1).otherwise(c("inode")).alias("inode"), "dev")
    state = R.starts(files, committed)
    new = session.cut_lineage(R.read_tail(state, ceiling=50_000))
    seen = R.captured(new).groupBy("source_path").agg(F.count("*").alias("new_lines"), F.min("byte_start").alias("first_start"))
    return R.progress(state, new).join(state.select("source_path", "rotated", "shrunk"), "source_path").join(seen, "source_path", "left").select(
        in_root().alias("rel_path"), F.coalesce("new_lines", F.lit(0)).alias("new_lines"), "first_start", c("offset").alias("consumed"), "backlog_bytes", "rotated", "shrunk")


_GATED = """gated AS (SELECT __CURSOR, min({'a': coalesce(PRIORITY, ''), 'id': line_id, 'm': MESSAGE, 'r': __REALTIME_TIMESTAMP}) AS e
  FROM journal WHERE coalesce(TRY_CAST(PRIORITY AS INT), 99) <= 4 GROUP BY __CURSOR)"""


@query("src_journal", f"""WITH {adapters.JOURNAL_CTE} SELECT __CURSOR AS cursor, min(line_id) AS line_id, min(TRY_CAST(PRIORITY AS BIGINT)) AS priority
    FROM journal WHERE coalesce(TRY_CAST(PRIORITY AS INT), 99) <= 4
    AND line_id = (SELECT min(j.line_id) FROM journal j WHERE j.__CURSOR = journal.__CURSOR AND coalesce(TRY_CAST(j.PRIORITY AS INT), 99) <= 4) GROUP BY __CURSOR""")
def journal(spark, folder):
    return S.gate_journal(adapters.journal(spark, folder)).select(
        F.col("__CURSOR").alias("cursor"), "line_id", F.col("PRIORITY").cast("bigint").alias("priority"))


@query("src_journal_window", f"""WITH {adapters.JOURNAL_CTE}, timed AS (SELECT *, make_timestamp(TRY_CAST(__REALTIME_TIMESTAMP AS BIGINT)) AS event_ts FROM journal)
    SELECT line_id, {d.iso('event_ts')} AS event_ts FROM timed WHERE event_ts >= {d.NOW_TS} - INTERVAL 24 HOUR
    ORDER BY timed.event_ts, __CURSOR, line_id LIMIT 10000""")
def journal_window(spark, folder):
    return S.recent_journal(adapters.journal(spark, folder), now()).select("line_id", T.canonical_text(F.col("event_ts")).alias("event_ts"))


@query("src_union_sources", f"""WITH {adapters.JOURNAL_CTE}, {LEADING_CTE} SELECT host, profile, source_name AS file, 'log' AS source_type, md5(substr(text, 1, 800)) AS text_md5,
      length(text) > 800 AS text_truncated, length(text) + 1 AS original_text_bytes, coalesce({d.iso('instant')}, 'UNKNOWN') AS ts FROM staged
    UNION ALL SELECT _HOSTNAME, 'system:' || coalesce(_SYSTEMD_UNIT, _SYSTEMD_USER_UNIT, SYSLOG_IDENTIFIER, _COMM, 'kernel-or-unknown'),
      'journald(p' || PRIORITY || ')', 'journald', md5(substr(coalesce(MESSAGE, ''), 1, 800)), length(coalesce(MESSAGE, '')) > 800, length(coalesce(MESSAGE, '')),
      coalesce({d.iso("make_timestamp(TRY_CAST(__REALTIME_TIMESTAMP AS BIGINT))")}, 'UNKNOWN') FROM journal""")
def union_sources(spark, folder):
    rows = S.unify(adapters.lines(spark, folder), adapters.journal(spark, folder))
    return rows.select("host", "profile", "file", "source_type", F.md5("text").alias("text_md5"), "text_truncated", "original_text_bytes", "ts")


_JSONL = f"""jsoned AS (SELECT *, CAST(sum(length(json) + 1) OVER (PARTITION BY host ORDER BY line_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_byte
   FROM (SELECT *, CAST({adapters.EVENT_JSON} AS STRING) AS json FROM lines))"""


@query("src_jsonl_events", d.with_lines("""SELECT host || '.jsonl' AS file_name, end_byte - length(json) - 1 AS byte_start, end_byte AS byte_end, stamp AS ts, host, profile,
    md5(text) AS text_md5, md5(json) AS raw_md5, true AS is_object FROM jsoned""", _JSONL))
def jsonl_events(spark, folder):
    root = adapters.log_files(spark, folder, "jsonl")
    # Overlapping globs: every file is still read once.
    events = S.read_events(spark, [f"{root}/*.jsonl", f"{root}/[aN]*.jsonl"], positions=True)
    return events.select(in_root().alias("file_name"), "byte_start", "byte_end", "ts", "host", "profile", F.md5("text").alias("text_md5"), F.md5("raw").alias("raw_md5"), "is_object")


@query("src_changed_files", d.with_lines("SELECT host || '.jsonl' AS file_name, max(end_byte) AS size FROM jsoned WHERE host <> 'alpha' GROUP BY host", _JSONL))
def changed_files(spark, folder):
    files = S.list_files(spark, [adapters.log_files(spark, folder, "jsonl") + "/*.jsonl"])
    # One file grew since its stamp was taken, one has none.
    grown = F.when(in_root("path") == "Node-B.jsonl", F.col("size") - 1).otherwise(F.col("size"))
    stamps = files.filter(in_root("path") != "gamma.jsonl").withColumn("size", grown)
    return S.changed_files(files, stamps).select(in_root("path").alias("file_name"), "size")


@query("flt_level_context", d.with_lines("SELECT line_id, keep FROM kept", LEADING_CTE, KEEP))
def level_context(spark, folder):
    return kept(spark, folder).select("line_id", "keep")


@query("flt_record_roles", d.with_lines(f"""SELECT line_id, role, dropped, parent_start, CASE WHEN role = 'parent' THEN {d.iso('instant')}
    WHEN role = 'continuation' THEN (SELECT {d.iso('p.instant')} FROM records p WHERE p.source_path = records.source_path AND p.byte_start = records.parent_start) END AS event_ts
    FROM records""", ROLES))
def record_roles(spark, folder):
    return staged(spark, folder).select("line_id", "role", "dropped", "parent_start", T.canonical_text(F.col("event_ts")).alias("event_ts"))


@query("win_fold_continuations", d.with_lines("""SELECT source_path, parent_start AS byte_start, max(byte_end) AS byte_end,
    md5(substr(string_agg(substr(text, 1, 800), chr(10) ORDER BY byte_start), 1, 8000)) AS text_md5,
    CASE WHEN count(*) = 1 THEN max(length(text)) > 800 ELSE length(string_agg(substr(text, 1, 800), chr(10))) > 8000 END AS text_truncated,
    CAST(sum(byte_end - byte_start) AS BIGINT) AS original_text_bytes, count(*) - 1 AS children, max(CASE WHEN role = 'parent' THEN line_id END) AS line_id
    FROM records WHERE role IS NOT NULL GROUP BY source_path, parent_start""", ROLES))
def fold_continuations(spark, folder):
    return L.fold(staged(spark, folder), chunk_bytes=CHUNK).select(
        "source_path", "byte_start", "byte_end", F.md5("text").alias("text_md5"), "text_truncated", "original_text_bytes", "children", "line_id")


@query("win_fold_conversations", """SELECT CAST(conv_id AS STRING) AS source_path, min(turn) AS first_turn, count(*) - 1 AS children,
    md5(substr(string_agg(text, chr(10) ORDER BY turn), 1, 8000)) AS text_md5, length(string_agg(text, chr(10))) > 8000 AS text_truncated
    FROM conversations GROUP BY conv_id""")
def fold_conversations(spark, folder):
    # Every conversation is one record: its first turn is the parent, later turns continue it.
    turns = adapters.table(spark, folder, "conversations")
    firsts = turns.groupBy("conv_id").agg(F.min("turn").alias("parent_start"))
    rows = turns.join(firsts, "conv_id").select(
        F.col("conv_id").cast("string").alias("source_path"), F.col("turn").alias("byte_start"), (F.col("turn") + 1).alias("byte_end"),
        "text", "parent_start", F.col("turn").alias("line_id"), F.lit(None).cast("timestamp").alias("event_ts"), F.lit("text").alias("timestamp_basis"),
        F.when(F.col("turn") == F.col("parent_start"), "parent").otherwise("continuation").alias("role"))
    return L.fold(rows, chunk_bytes=2, line_limit=None).select(
        "source_path", F.col("byte_start").alias("first_turn"), "children", F.md5("text").alias("text_md5"), "text_truncated")


@query("agg_run_counters", d.with_lines("""SELECT count(*) FILTER (WHERE role = 'parent') AS kept, CAST(0 AS BIGINT) AS new_append,
    count(*) FILTER (WHERE role = 'continuation') AS inherited, count(*) FILTER (WHERE dropped = 'old') AS dropped_old,
    count(*) FILTER (WHERE dropped = 'missing') AS dropped_missing, count(*) FILTER (WHERE dropped = 'malformed') AS dropped_malformed,
    count(*) FILTER (WHERE dropped = 'filtered') AS filtered FROM records""", ROLES))
def run_counters(spark, folder):
    return L.run_counters(staged(spark, folder))


@query("fn_parse_escalate", """SELECT conv_id, turn, CASE WHEN contains(t, 'escalate: no') OR contains(t, 'escalate no') OR contains(t, 'escalate:no') THEN false
    WHEN contains(t, 'escalate: yes') OR contains(t, 'escalate yes') OR contains(t, 'escalate:yes') THEN true ELSE attention > 0 END AS escalate
    FROM (SELECT conv_id, turn, turn % 2 AS attention, lower(text || CASE conv_id % 5 WHEN 0 THEN ' Escalate: yes' WHEN 1 THEN ' escalate:NO' ELSE '' END) AS t FROM conversations)""")
def parse_escalate(spark, folder):
    from tracewell.operators.alarms import parse_escalate as parse
    ending = F.when(F.col("conv_id") % 5 == 0, " Escalate: yes").when(F.col("conv_id") % 5 == 1, " escalate:NO").otherwise("")
    return adapters.table(spark, folder, "conversations").select(
        "conv_id", "turn", parse(F.concat("text", ending), F.col("turn") % 2).alias("escalate"))
