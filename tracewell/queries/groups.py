"""Groups, batches, feed, notices and retention over the enriched store."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell import patterns as P, session
from tracewell.functions import identity as I
from tracewell.functions import text as T
from tracewell.operators import alarms, feed as X, groups as G, packing as K, serious as Z
from tracewell.plans import policy as S
from tracewell.queries import adapters, duck as d
from tracewell.queries import rules as R
from tracewell.queries.registry import query
from tracewell.sinks import stores


def now():
    return F.lit(adapters.NOW).cast("timestamp")


def store(spark, folder):
    """The enriched store: classified lines with their event instant and a record id."""
    def build():
        rows = R.enriched(spark, folder)
        at = F.coalesce(T.leading_ts(F.col("text")), F.date_trunc("second", F.col("stored_at")))
        kept = rows.select("line_id", "host", "profile", "source_name", "source_path", "byte_start", "byte_end", "text",
                           "classification", "severity", "fingerprint", "provenance", at.alias("event_at"), F.col("line_id").alias("record_id"))
        return kept

    return adapters.stage(spark, folder, "enriched", build)


_MORE = ("domain", "provider", "model", "platform", "component", "tool", "target", "operation", "http_status", "provider_code", "rpc_code", "errno",
         "exit_code", "signal", "exceptions")
# The oracle's side of the store.
STORED = R.FINGERPRINTED + f""", stored AS (SELECT *, coalesce(CASE WHEN {d.has('text', P.LEADING_PARTS)} THEN {d.instant('text', P.LEADING_PARTS)} END,
   date_trunc('second', ts)) AS event_at FROM enriched),
 inside AS (SELECT * FROM stored WHERE event_at BETWEEN {d.NOW_TS} - INTERVAL 72 HOUR AND {d.NOW_TS}),
 grouped AS (SELECT fingerprint, count(*) AS n, min(event_at) AS first_at, max(event_at) AS last_at,
   arg_min({{'host': fp_host, 'profile': profile, 'event': event, 'cause': cause, 'kind': kind, 'severity': severity, 'events': events, 'causes': causes,
     {", ".join(f"'{n}': {n}" for n in _MORE)}, 'normalized_text': normalized_text, 'text': substr(text, 1, 128), 'text_truncated': length(text) > 128}}, {{'a': event_at, 'b': line_id}}) AS s,
   arg_max({{'latest_text': substr(text, 1, 250), 'ref': source_path || ':' || CAST(byte_start AS STRING) || '-' || CAST(byte_end AS STRING)}}, {{'a': event_at, 'b': line_id}}) AS l,
   list_sort(list(DISTINCT source_path)) AS source_files FROM inside GROUP BY fingerprint),
 flat AS (SELECT fingerprint, n, first_at, last_at, unnest(s), unnest(l), source_files FROM grouped)"""
_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in P.SEVERITY_RANK) + " ELSE 1 END"
_ORDER = f"{_RANK}, last_at DESC, n DESC, fingerprint"


def with_store(select: str, *ctes: str) -> str:
    return R.with_parsed(select, STORED, *ctes)


def windowed(spark, folder):
    return G.window_groups(store(spark, folder), now())


def flat(spark, folder):
    return G.flat(windowed(spark, folder))


def _iso(name):
    return T.canonical_text(F.col(name)).alias(name)


_SHOWN = ("fingerprint", "n", "host", "profile", "event", "cause", "kind", "severity", "text", "text_truncated", "latest_text")
_GROUP_SQL = f"""SELECT fingerprint, n, host, profile, event, cause, kind, severity, text, text_truncated, latest_text,
    {d.iso('first_at')} AS first_at, {d.iso('last_at')} AS last_at, ref AS latest_source_ref, {d.join('source_files')} AS source_files FROM flat"""


def _show(rows):
    return rows.select(*_SHOWN, _iso("first_at"), _iso("last_at"), "latest_source_ref", F.array_join("source_files", "|").alias("source_files"))


@query("grp_window_groups", with_store(_GROUP_SQL))
def window_groups(spark, folder):
    return _show(flat(spark, folder))


@query("grp_merge_increment", with_store(_GROUP_SQL))
def merge_increment(spark, folder):
    # Half of the records two days ago, the other half now: the merge must equal one pass over all.
    rows = store(spark, folder)
    cut = F.lit("2024-01-29 00:00:00").cast("timestamp")
    prior = G.window_groups(rows.filter(F.col("event_at") <= cut), cut, hours=36)
    late = rows.filter(F.col("event_at") > cut)
    return _show(G.flat(G.merge_increment(prior, late, now())))


@query("grp_exact_duplicates", d.with_lines("""SELECT host, profile, source_path, text, count(*) AS occurrence_count, arg_min(stamp, byte_start) AS first_seen, arg_max(stamp, byte_start) AS last_seen
    FROM lines GROUP BY host, profile, source_path, text"""))
def exact_duplicates(spark, folder):
    return G.compact(adapters.lines(spark, folder), ["host", "profile", "source_path", "text"], "stamp", "byte_start")


@query("agg_severity_totals", with_store("SELECT host, severity, count(*) AS n FROM flat GROUP BY host, severity"))
def severity_totals(spark, folder):
    totals = G.severity_totals(flat(spark, folder), ["host"])
    return totals.select("host", F.explode("severity_totals").alias("severity", "n"))


@query("sink_groups_json", with_store("""SELECT fingerprint, CASE WHEN len(events) > 1 OR (len(events) = 1 AND events[1] IS DISTINCT FROM event) THEN array_to_string(events, '|') END AS events,
    CASE WHEN len(causes) > 1 OR (len(causes) = 1 AND causes[1] IS DISTINCT FROM cause) THEN array_to_string(causes, '|') END AS causes, event, CAST(n AS STRING) AS n,
    event IS NULL AS event_left_out FROM flat"""))
def groups_json(spark, folder):
    document = F.col("json")
    parsed = F.from_json(document, "events array<string>, causes array<string>, event string, n string")
    return G.groups_json(windowed(spark, folder)).select("fingerprint", parsed.alias("p"), "json").select(
        "fingerprint", F.array_join("p.events", "|").alias("events"), F.array_join("p.causes", "|").alias("causes"), "p.event", "p.n",
        (~document.contains('"event":')).alias("event_left_out"))


@query("ord_batch_order", with_store(f"SELECT fingerprint, host, severity, n, event, {d.iso('last_at')} AS last_at, row_number() OVER (ORDER BY {_ORDER}) AS position FROM flat"))
def batch_order(spark, folder):
    rows = flat(spark, folder).select("fingerprint", "host", "severity", "n", "event", "last_at")
    return K.order_groups(rows).withColumn("last_at", T.canonical_text(F.col("last_at")))


_SHOWN_SQL = {"first_ts": d.iso("first_at"), "last_ts": d.iso("last_at"), "window_start": d.iso(f"{d.NOW_TS} - INTERVAL 72 HOUR"), "window_end": d.iso(d.NOW_TS)}
_GROUP_STRUCT = "{" + ", ".join(f"'{n}': {_SHOWN_SQL.get(n, n)}" for n in K.BATCH_FIELDS) + "}"
_SPACES = " + ".join([str(2 * len(K.BATCH_FIELDS) - 1), *[f"greatest(coalesce(len({n}), 0) - 1, 0)" for n in K.BATCH_LISTS]])
_OVER = f"w.items + 1 > {K.MAX_GROUPS} OR w.bytes + s.size > {K.MAX_BYTES}"
_PACKED = f"""shown AS (SELECT *, CAST(to_json({_GROUP_STRUCT}) AS STRING) AS json FROM flat),
 sized AS (SELECT fingerprint, host, severity, n, json, length(json) + {_SPACES} AS size, row_number() OVER (PARTITION BY host ORDER BY {_ORDER}) AS position FROM shown),
 walk AS (SELECT host, position, fingerprint, severity, n, json, size, 1 AS batch_index, 1 AS items, size AS bytes FROM sized WHERE position = 1
   UNION ALL SELECT s.host, s.position, s.fingerprint, s.severity, s.n, s.json, s.size, CASE WHEN {_OVER} THEN w.batch_index + 1 ELSE w.batch_index END,
     CASE WHEN {_OVER} THEN 1 ELSE w.items + 1 END, CASE WHEN {_OVER} THEN s.size ELSE w.bytes + s.size END
   FROM walk w JOIN sized s ON s.host = w.host AND s.position = w.position + 1),
 labels AS (SELECT host, batch_index, string_agg(severity || '=' || k, '|' ORDER BY severity) AS totals FROM
   (SELECT host, batch_index, severity, count(*) AS k FROM walk GROUP BY ALL) GROUP BY ALL),
 window_labels AS (SELECT host, string_agg(severity || '=' || k, '|' ORDER BY severity) AS window_totals FROM (SELECT host, severity, count(*) AS k FROM walk GROUP BY ALL) GROUP BY ALL),
 headers AS (SELECT host, CAST(batch_index AS BIGINT) AS batch_index, count(*) AS group_count, CAST(sum(n) AS BIGINT) AS occurrence_count, any_value(totals) AS severity_totals,
   CAST(sum(count(*)) OVER (PARTITION BY host) AS BIGINT) AS window_group_count, CAST(sum(sum(n)) OVER (PARTITION BY host) AS BIGINT) AS window_occurrence_count,
   any_value(window_totals) AS window_severity_totals, count(*) OVER (PARTITION BY host) AS batch_count,
   md5(string_agg(json, chr(10) ORDER BY position)) AS groups_md5
   FROM walk JOIN labels USING (host, batch_index) JOIN window_labels USING (host) GROUP BY host, batch_index)"""


def with_packed(select):
    return with_store(select, _PACKED).replace("WITH ", "WITH RECURSIVE ", 1)


def packed(spark, folder):
    rows = K.compact(flat(spark, folder)).select("fingerprint", "host", "severity", "n", "last_at", "window_start", "window_end", "group", "size")
    return K.pack(K.key_positions(K.order_groups(rows), ["host"]), "size", ["host"])


def _totals(name):
    pairs = F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(pairs, "|").alias(name)


@query("pack_batches", with_packed("SELECT host, position, fingerprint, CAST(size AS BIGINT) AS size, CAST(batch_index AS BIGINT) AS batch_index FROM walk"))
def pack_batches(spark, folder):
    return packed(spark, folder).select("host", "position", "fingerprint", "size", "batch_index")


@query("agg_batch_headers", with_packed("SELECT * EXCLUDE (groups_md5) FROM headers"))
def batch_headers(spark, folder):
    rows = K.batch_headers(packed(spark, folder), ["host"])
    return rows.select("host", "batch_index", "group_count", "occurrence_count", _totals("severity_totals"), "window_group_count", "window_occurrence_count",
                       _totals("window_severity_totals"), "batch_count")


@query("policy_reapply", with_store(f"""SELECT line_id, {R.severity_sql(R.OTHER_POLICY)[0]} AS severity, {R.severity_sql(R.OTHER_POLICY)[1]} AS rule_id FROM stored"""))
def policy_reapply(spark, folder):
    rows = S.reapply(store(spark, folder), S.validate(R.OTHER_POLICY))
    return rows.select("line_id", F.col("severity.label").alias("severity"), "severity.rule_id")


@query("flt_attention", with_store("SELECT line_id, event, cause FROM stored WHERE severity = 'needs-attention'"))
def attention(spark, folder):
    return alarms.attention(store(spark, folder), "severity.label").select("line_id", "classification.event", "classification.cause")


@query("flt_serious_observation", with_store(f"""SELECT line_id, CASE WHEN {d.has('bare', P.SERIOUS[0][1])} THEN '{P.SERIOUS[0][0]}' ELSE '{P.SERIOUS[1][0]}' END AS serious
    FROM (SELECT *, {d.sub('text', P.QUOTED_SPAN, ' ')} AS bare FROM stored) WHERE severity <> 'ignore' AND NOT {d.has('bare', P.ADAPTER_RECONNECT)}
    AND NOT ({d.has('profile', P.HEALTH_PROFILE)} AND coalesce(event IN ({', '.join(d.q(e) for e in P.HEALTH_EVENTS)}), false))
    AND ({d.has('bare', P.SERIOUS[0][1])} OR {d.has('bare', P.SERIOUS[1][1])})"""))
def serious_observation(spark, folder):
    rows = store(spark, folder).select("line_id", "text", "profile", F.col("classification.event").alias("event"), F.col("severity.label").alias("severity"))
    return Z.serious(rows).select("line_id", "serious")


# --- feed -------------------------------------------------------------------------------------------
_FEED = """feed AS (SELECT line_id, event_at AS ts, host, profile, coalesce(domain, 'system') AS domain, coalesce(kind, 'incident') AS kind, event, cause, severity,
   source_path, byte_start, substr(text, 1, 300) AS text, component, tool FROM stored WHERE severity <> 'ignore' AND event_at IS NOT NULL)"""


@query("flt_feed_noise", with_store(f"SELECT {d.iso('ts')} AS ts, host, profile, domain, kind, event, cause, severity, source_path, byte_start, text, component, tool FROM feed", _FEED))
def feed_noise(spark, folder):
    return X.feed_rows(store(spark, folder)).select(
        _iso("ts"), "host", "profile", "domain", "kind", "event", "cause", "severity", "source_path", "byte_start", "text", "component", "tool")


@query("src_feed_tail", with_store(f"""SELECT {d.iso('ts')} AS ts, source_path, byte_start FROM (SELECT *, sum(length(text) + 61) OVER (ORDER BY ts DESC, source_path DESC, byte_start DESC ROWS UNBOUNDED PRECEDING) AS used
    FROM feed) WHERE used <= 500000 AND ts >= {d.NOW_TS} - INTERVAL 600 MINUTE""", _FEED))
def feed_tail(spark, folder):
    rows = X.feed_rows(store(spark, folder))
    tail = X.feed_tail(rows, ["ts", "source_path", "byte_start"], F.octet_length("text") + 60, minutes=600, now=now())
    return tail.select(_iso("ts"), "source_path", "byte_start")


@query("sink_feed", with_store("SELECT count(*) AS rows, count(DISTINCT source_path) AS paths, CAST(sum(byte_start) AS BIGINT) AS starts FROM feed", _FEED))
def sink_feed(spark, folder):
    path = _fresh(spark, "feed")
    stores.write_feed(store(spark, folder), path)
    return spark.read.schema("source_path string, byte_start bigint").json(path).agg(
        F.count("*").alias("rows"), F.countDistinct("source_path").alias("paths"), F.sum("byte_start").alias("starts"))


_COUNTER = [0]


def _fresh(spark, name):
    _COUNTER[0] += 1
    return f"{session.shared_dir(spark)}/{name}-{spark.sparkContext.applicationId}-{_COUNTER[0]}"


_BUCKETS = """bucketed AS (SELECT *, strftime(event_at + INTERVAL 4 HOUR, '%Y%m%d') AS bucket_day,
   CASE WHEN hour(event_at + INTERVAL 4 HOUR) < 12 THEN '00' ELSE '12' END AS bucket_half FROM stored)"""


@query("sink_half_day_buckets", with_store("SELECT bucket_day, bucket_half, count(*) AS rows, min(line_id) AS first_line, max(line_id) AS last_line, CAST(0 AS BIGINT) AS out_of_order FROM bucketed GROUP BY ALL", _BUCKETS))
def half_day_buckets(spark, folder):
    path = _fresh(spark, "buckets")
    rows = store(spark, folder).select("line_id", "record_id", "event_at", "source_path", "byte_start", "text")
    stores.write_buckets(rows.filter("line_id % 2 = 0"), path, "Asia/Dubai")
    # The second increment brings the other half, and repeats a part of the first.
    stores.write_buckets(rows.filter("line_id % 2 = 1 OR line_id % 10 = 0"), path, "Asia/Dubai")
    # Rows of one file are read in the order in which they were written: by time, then source and position.
    placed = stores.read_buckets(spark, path).withColumns({"_file": F.col("_metadata.file_path"), "_place": F.monotonically_increasing_id()})
    before = F.lag(F.struct("event_at", "source_path", "byte_start")).over(Window.partitionBy("_file").orderBy("_place"))
    checked = placed.withColumn("_late", before > F.struct("event_at", "source_path", "byte_start"))
    return checked.groupBy("bucket_day", "bucket_half").agg(
        F.count("*").alias("rows"), F.min("line_id").alias("first_line"), F.max("line_id").alias("last_line"), F.count_if(F.coalesce("_late", F.lit(False))).alias("out_of_order"))


@query("sink_archive_gzip", with_store(f"SELECT count(*) AS archived, CAST(sum(line_id) AS BIGINT) AS ids FROM stored WHERE event_at < {d.NOW_TS} - INTERVAL 144 HOUR"))
def archive_gzip(spark, folder):
    path = _fresh(spark, "archive")
    old = store(spark, folder).filter(F.col("event_at") < now() - F.expr("INTERVAL 144 HOURS")).select(
        "line_id", "text", F.date_format("event_at", "yyyyMMdd").alias("day"))
    archived = stores.archive(old, path, "day")
    return spark.read.schema("line_id bigint").json(path).agg(F.lit(archived).cast("bigint").alias("archived"), F.sum("line_id").alias("ids"))


@query("sink_batches", with_packed(f"""SELECT host, batch_index, batch_count, group_count, occurrence_count, severity_totals, window_group_count, window_occurrence_count, window_severity_totals, groups_md5,
    {_SHOWN_SQL['window_start']} AS window_start, {_SHOWN_SQL['window_end']} AS window_end FROM headers"""))
def sink_batches(spark, folder):
    path = _fresh(spark, "batches")
    rows = packed(spark, folder)
    stores.write_batches(rows, path, ["host"], F.lit("20240130"))
    group = rows.schema["group"].dataType.simpleString()
    back = spark.read.schema(
        f"""group_count bigint, occurrence_count bigint, severity_totals map<string,bigint>, window_group_count bigint, window_occurrence_count bigint,
        window_severity_totals map<string,bigint>, batch_count bigint, window_start string, window_end string, groups array<{group}>, host string, batch_index bigint""").json(path)
    documents = F.transform("groups", lambda g: F.to_json(g, {"ignoreNullFields": "false"}))
    return back.select("host", "batch_index", "batch_count", "group_count", "occurrence_count", _totals("severity_totals"), "window_group_count", "window_occurrence_count",
                       _totals("window_severity_totals"), F.md5(F.array_join(documents, "\n")).alias("groups_md5"), "window_start", "window_end")


@query("ret_archive_split", with_store(f"""SELECT bucket_day, bucket_half, rows, expired_rows, CASE WHEN closed_old THEN 'archive' WHEN competing AND used > 30000 THEN 'displace'
    WHEN expired_rows = rows THEN 'archive rows' WHEN expired_rows > 0 THEN 'split' ELSE 'keep' END AS action
    FROM (SELECT *, sum(CASE WHEN competing THEN kept_bytes ELSE 0 END) OVER (ORDER BY bucket_day DESC, bucket_half DESC ROWS UNBOUNDED PRECEDING) AS used
      FROM (SELECT *, NOT active AND NOT closed_old AND rows > expired_rows AS competing FROM (SELECT *, bucket_day = '20240130' AS active,
          bucket_day <> '20240130' AND strptime(bucket_day, '%Y%m%d') + INTERVAL 1 DAY <= {d.NOW_TS} - INTERVAL 72 HOUR AS closed_old
        FROM (SELECT strftime(event_at, '%Y%m%d') AS bucket_day, CASE WHEN hour(event_at) < 12 THEN '00' ELSE '12' END AS bucket_half, count(*) AS rows,
          count(*) FILTER (WHERE event_at < {d.NOW_TS} - INTERVAL 72 HOUR) AS expired_rows,
          sum(CASE WHEN event_at >= {d.NOW_TS} - INTERVAL 72 HOUR THEN length(text) ELSE 0 END) AS kept_bytes FROM stored GROUP BY 1, 2))))"""))
def archive_split(spark, folder):
    rows = stores.with_buckets(store(spark, folder)).withColumn("size", F.length("text").cast("bigint"))
    plan = X.retention_plan(rows, "size", now(), max_bytes=30_000)
    return plan.select("bucket_day", "bucket_half", "rows", "expired_rows", "action")


@query("ret_feed_rotate", with_store(f"SELECT ts < {d.NOW_TS} - INTERVAL 144 HOUR AS archived, count(*) AS rows FROM feed GROUP BY 1", _FEED))
def feed_rotate(spark, folder):
    kept, archived = X.rotate_feed(X.feed_rows(store(spark, folder)), now())
    both = kept.select(F.lit(False).alias("archived")).union(archived.select(F.lit(True).alias("archived")))
    return both.groupBy("archived").agg(F.count("*").alias("rows"))


# --- notices ----------------------------------------------------------------------------------------
def notices(spark, folder):
    c = F.col
    return alarms.attention(store(spark, folder).select(
        "line_id", "host", "profile", "text", "source_path", "byte_start", "byte_end", c("severity.label").alias("severity"),
        _iso("event_at").alias("ts"), *[c(f"classification.{n}").alias(n) for n in ("event", "cause", "tool", "operation", "component", "provider", "model")]))


_EVENT_KEY = "host || '|' || profile || '|' || coalesce(event, '') || '|' || coalesce(cause, '') || '|' || source_path || '|' || CAST(byte_start AS STRING)"


@query("join_unseen", with_store(f"SELECT line_id, {_EVENT_KEY} AS event_key FROM stored WHERE severity = 'needs-attention' AND line_id % 3 <> 0"))
def join_unseen(spark, folder):
    c = F.col
    rows = notices(spark, folder).withColumn("event_key", I.event_key(
        c("host"), c("profile"), c("event"), c("cause"), c("source_path"), c("byte_start")))
    return alarms.unseen(rows, rows.filter("line_id % 3 = 0"), "event_key").select("line_id", "event_key")


_SLOT = R.SLOT
_ENTRY = f"""'- `' || coalesce(nullif(event, ''), 'unclassified') || '` agent=`' || profile || '` function=`' || {_SLOT} || '` cause=`' || coalesce(nullif(cause, ''), '?') || '` ts=`' || {d.iso('event_at')} || '`'
   || CASE WHEN provider IS NOT NULL OR model IS NOT NULL THEN ' provider=`' || coalesce(provider, '?') || '` model=`' || coalesce(model, '?') || '`' ELSE '' END
   || chr(10) || '  ptr `' || source_path || ':' || CAST(byte_start AS STRING) || '-' || CAST(byte_end AS STRING) || '`' || chr(10) || '  ' || substr(replace(text, chr(10), ' '), 1, 180)"""


@query("fn_format_alarm", with_store(f"""SELECT host, any_value(total) AS n, '**ALARM ' || host || '**' || chr(10) || CAST(any_value(total) AS STRING) || ' new needs-attention event(s)' || chr(10)
    || string_agg(entry, chr(10) ORDER BY rn) || CASE WHEN any_value(total) > 8 THEN chr(10) || '- … ' || CAST(any_value(total) - 8 AS STRING) || ' more' ELSE '' END || chr(10) AS alarm
    FROM (SELECT host, {_ENTRY} AS entry, row_number() OVER (PARTITION BY host ORDER BY event_at, line_id) AS rn, count(*) OVER (PARTITION BY host) AS total
      FROM stored WHERE severity = 'needs-attention') WHERE rn <= 8 GROUP BY host"""))
def format_alarm(spark, folder):
    return alarms.format_alarm(notices(spark, folder), ["ts", "line_id"])


@query("fn_job_error", with_store(f"""SELECT line_id, {d.iso('event_at')} || ' agent=' || profile || ' function=' || {_SLOT} || ' host=' || host ||
    CASE WHEN provider IS NOT NULL THEN ' provider=' || provider ELSE '' END || CASE WHEN model IS NOT NULL THEN ' model=' || model ELSE '' END || ' ' || text AS line FROM stored WHERE severity = 'needs-attention'"""))
def job_error(spark, folder):
    from tracewell.functions.attributes import function_slot
    c = F.col
    slot = function_slot(c("tool"), c("operation"), c("component"))
    line = alarms.job_error(c("ts"), alarms.agent(c("profile")), slot, c("text"), host=c("host"), provider=c("provider"), model=c("model"))
    return notices(spark, folder).select("line_id", line.alias("line"))


@query("top_pointers", with_store(f"""SELECT line_id, source_path, {_SLOT} AS function, profile AS agent FROM
    (SELECT * FROM (SELECT * REPLACE (CASE WHEN line_id % 4 <> 0 THEN source_path END AS source_path) FROM stored WHERE severity = 'needs-attention') ORDER BY event_at DESC, line_id DESC LIMIT 12)
    WHERE source_path IS NOT NULL"""))
def top_pointers(spark, folder):
    rows = notices(spark, folder).withColumn("source_path", F.when(F.col("line_id") % 4 != 0, F.col("source_path")))
    return alarms.pointers(rows, [F.col("ts").desc(), F.col("line_id").desc()]).select("line_id", "source_path", "function", "agent")


@query("top_seen_keys", d.with_lines("SELECT key FROM (SELECT DISTINCT sha256(text) AS key FROM lines) ORDER BY key DESC LIMIT 4000"))
def top_seen_keys(spark, folder):
    return alarms.cap_seen(adapters.lines(spark, folder).select(I.notice_key(F.col("text")).alias("key")), "key")


@query("set_merge_file_lists", d.with_lines("""SELECT host, array_to_string(list_sort(list(DISTINCT source_path)), '|') AS files FROM lines GROUP BY host"""))
def merge_file_lists(spark, folder):
    rows = adapters.lines(spark, folder)

    def lists(test, name):
        return rows.filter(test).select("host", "source_path").distinct().groupBy("host").agg(F.collect_list("source_path").alias(name))

    both = lists("line_id % 2 = 0", "a").join(lists("line_id % 2 = 1", "b"), "host", "full")
    return both.select("host", F.array_join(F.array_sort(F.array_union("a", "b")), "|").alias("files"))
