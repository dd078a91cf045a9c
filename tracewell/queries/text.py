"""Queries over log text: one per scalar operator."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import attributes as A
from tracewell.functions import identity as I
from tracewell.functions import regex as rx
from tracewell.functions import text as T
from tracewell.queries import adapters, duck as d
from tracewell.queries.registry import query


def parsed(spark, folder):
    return T.parse_prefix(adapters.lines(spark, folder))


def with_parsed(select: str, *ctes: str) -> str:
    return d.with_lines(select, d.PARSED, *ctes)


@query("fn_parse_prefix", with_parsed("SELECT line_id, text_stamp, log_level, session, component, body FROM parsed"))
def parse_prefix(spark, folder):
    return parsed(spark, folder).select("line_id", "text_stamp", "log_level", "session", "component", "body")


CONTINUATION_SQL = f"(NOT {d.has('text', P.PREFIX)} AND ({d.has('text', P.FRAME)} OR {d.has('text', P.CODE_LINE)}))"


@query("fn_is_continuation", d.with_lines(f"SELECT line_id, {CONTINUATION_SQL} AS is_continuation FROM lines"))
def is_continuation(spark, folder):
    return adapters.lines(spark, folder).select("line_id", T.is_continuation(F.col("text")).alias("is_continuation"))


LEADING_CTE = f"""led AS (SELECT *, CASE WHEN {d.has('text', P.LEADING_PARTS)} THEN {d.instant('text', P.LEADING_PARTS)} END AS instant FROM lines),
 staged AS (SELECT *, CASE WHEN instant IS NOT NULL THEN 'ok' WHEN {d.has('text', P.ANY_STAMP)} THEN 'malformed' ELSE 'missing' END AS status FROM led)"""


@query("fn_leading_ts", d.with_lines(f"SELECT line_id, {d.iso('instant')} AS leading_ts, status FROM staged", LEADING_CTE))
def leading_ts(spark, folder):
    instant = T.leading_ts(F.col("text"))
    return (
        adapters.lines(spark, folder).withColumn("instant", instant)
        .select("line_id", T.canonical_text(F.col("instant")).alias("leading_ts"),
                T.leading_status(F.col("text"), F.col("instant")).alias("status"))
    )


@query("fn_canonical_ts", d.with_lines(f"""
    SELECT line_id, {d.iso(d.instant('stamp_text', P.ISO_INSTANT))} AS utc_text,
           strftime({d.instant('stamp_text', P.ISO_INSTANT)} + INTERVAL 4 HOUR, '%Y-%m-%dT%H:%M:%S') || '+04:00' AS local_text
    FROM (SELECT line_id, {d.first('text', P.TEXT_STAMP)} AS stamp_text FROM lines)"""))
def canonical_ts(spark, folder):
    instant = F.col("instant")
    return (
        adapters.lines(spark, folder)
        .select("line_id", T.parse_instant(rx.first(F.col("text"), P.TEXT_STAMP)).alias("instant"))
        .select("line_id", T.canonical_text(instant).alias("utc_text"),
                T.canonical_text(instant, "Asia/Dubai").alias("local_text"))
    )


@query("fn_journal_ts", f"""WITH {adapters.JOURNAL_CTE}
    SELECT line_id, {d.iso("make_timestamp(TRY_CAST(__REALTIME_TIMESTAMP AS BIGINT))")} AS event_ts,
      CASE WHEN __REALTIME_TIMESTAMP IS NULL OR __REALTIME_TIMESTAMP = '' THEN 'missing'
           WHEN TRY_CAST(__REALTIME_TIMESTAMP AS BIGINT) IS NULL THEN 'malformed' ELSE 'ok' END AS status
    FROM journal""")
def journal_ts(spark, folder):
    micros = F.col("__REALTIME_TIMESTAMP")
    return adapters.journal(spark, folder).select(
        "line_id", T.canonical_text(T.journal_ts(micros)).alias("event_ts"), T.journal_status(micros).alias("status"))


@query("fn_event_ts_basis", d.with_lines(f"""
    SELECT line_id, coalesce(translate({d.first('text', P.TEXT_STAMP)}, ' ,', 'T.'), stored) AS event_ts,
      CASE WHEN {d.has('text', P.TEXT_STAMP)} THEN 'text' WHEN stored IS NOT NULL THEN 'stored_unverified' END AS event_ts_basis,
      CASE WHEN {d.has('text', P.TEXT_STAMP)} THEN 'explicit' WHEN stored IS NOT NULL THEN 'derived' END AS event_ts_certainty
    FROM (SELECT line_id, text, CASE WHEN line_id % 2 = 0 THEN stamp END AS stored FROM lines)"""))
def event_ts_basis(spark, folder):
    stored = F.when(F.col("line_id") % 2 == 0, F.col("stamp")).otherwise("UNKNOWN")
    return adapters.lines(spark, folder).select("line_id", *[
        c.alias(n) for n, c in T.event_time(F.col("text"), stored).items()])


# --- attributes: the DuckDB side mirrors the same rules over RE2 ------------------------------
_AT = f"strpos(body, {d.first('body', P.FALLBACK)})"
SPLIT = f"""split AS (SELECT *,
    CASE WHEN {d.has('body', P.FALLBACK)} THEN substr(body, 1, {_AT} - 1) ELSE body END AS head,
    CASE WHEN {d.has('body', P.FALLBACK)} THEN substr(body, {_AT}) END AS tail FROM parsed)"""


def _strip(items: str) -> str:
    return d.distinct(items)


ATTRS = SPLIT + f""", attr_lists AS (SELECT *,
    {_strip(d.every('head', P.PROVIDER_PARAM, 2))} AS named,
    {d.compact([f"CASE WHEN {d.has('head', p)} THEN {d.q(n)} END" for n, p in P.ROUTES])} AS all_routes,
    {d.first('head', P.REFERENCE_MODEL, 1)} AS ref_provider, {d.first('head', P.REFERENCE_MODEL, 2)} AS ref_model,
    {d.first('head', P.COOLDOWN_PROVIDER, 1)} AS marked,
    {_strip(f"list_concat({d.every('head', P.MODEL_PARAM, 1)}, {d.every('head', P.MODEL_QUOTED, 1)})")} AS model_params,
    {d.distinct(d.every('head', P.MODEL_NAME, 1))} AS model_names,
    {d.distinct(d.every('body', P.EXCEPTION, 1))} AS exceptions,
    {d.distinct(f"list_transform({d.every('body', A.HTTP_EITHER)}, lambda m: regexp_extract(m, '[45][0-9][0-9]'))")} AS statuses,
    {d.distinct(f"list_concat({d.every('body', P.CODE_QUOTED, 1)}, {d.every('body', P.CODE_NUMBER, 1)})")} AS provider_codes,
    {d.first('body', P.MCP_SERVER, 1)} AS mcp_server,
    coalesce({d.first('body', P.TOOL_NAMED, 1)}, {d.first('body', P.TOOL_KEYED, 1)}, {d.first('body', P.TOOL_DEADLINE, 1)}) AS tool,
    {d.first('body', P.DATABASE_FILE, 1)} AS database
  FROM split),
 attr_pick AS (SELECT *,
    CASE WHEN len(named) = 0 THEN all_routes ELSE [] END AS routes,
    CASE WHEN len(model_params) > 0 THEN model_params ELSE model_names END AS models
  FROM attr_lists)"""
_CHOSEN = f"coalesce(({d.only('named')}), ({d.only('routes')}))"
_PREDICTED = f"contains(body, {d.q(P.PREDICTED)})"


def _platform_sql() -> str:
    low = "lower(coalesce(component, ''))"
    whens = []
    for name in P.PLATFORMS:
        phrase = rf"(?i)\[{name}\]|\b{name}{P.PLATFORM_AFTER}|{P.PLATFORM_BEFORE}{name}\b"
        whens.append(f"WHEN contains({low}, '{name}') OR {d.has('body', phrase)} THEN '{name}'")
    return "CASE " + " ".join(whens) + " END"


def _explicit(key: str) -> str:
    return d.first("body", rf"(?i)\b{key}=['\"]?([\w./:-]+)", 1)


_LLM_COMP = " OR ".join(f"starts_with(coalesce(component, ''), '{p}')" for p in P.LLM_COMPONENTS)
_PLAT_COMP = " OR ".join(f"starts_with(coalesce(component, ''), '{p}')" for p in P.PLATFORM_COMPONENTS)
ATTRIBUTES = ATTRS + f""", attrs0 AS (SELECT *,
    coalesce(ref_provider, {_CHOSEN}, marked) AS provider,
    CASE WHEN ref_provider IS NULL AND len(routes) = 1 THEN 'derived'
         WHEN coalesce(ref_provider, {_CHOSEN}, marked) IS NOT NULL THEN 'explicit' END AS provider_certainty,
    CASE WHEN len(named) > 1 THEN named WHEN len(routes) > 1 THEN routes END AS provider_conflict,
    coalesce(ref_model, ({d.only('models')})) AS model,
    CASE WHEN len(models) > 1 THEN models END AS model_conflict,
    coalesce({_explicit('fallback_provider')}, {d.first('tail', P.PROVIDER_PARAM, 2)}) AS fallback_provider,
    coalesce({_explicit('fallback_model')}, {d.first('tail', P.MODEL_PARAM, 1)}, {d.first('tail', P.MODEL_QUOTED, 1)}, {d.first('tail', P.MODEL_NAME, 1)}) AS fallback_model,
    {_platform_sql()} AS platform,
    coalesce({d.first('body', P.CHECK_FUNCTION, 1)}, 'mcp:' || mcp_server, 'tool:' || tool, {d.first('body', P.ENDPOINT, 1)}, database) AS target,
    CASE WHEN len(exceptions) > 0 THEN coalesce({d.first('body', P.ERROR_TYPE, 1)}, exceptions[-1]) END AS exception,
    CASE WHEN NOT {_PREDICTED} THEN CAST(({d.only('statuses')}) AS BIGINT) END AS http_status,
    CASE WHEN len(statuses) > 1 THEN statuses END AS http_conflict,
    CASE WHEN {_PREDICTED} THEN NULL WHEN len(provider_codes) > 0 THEN list_filter(provider_codes, lambda c: c NOT IN ('error', 'message'))[1]
         ELSE CASE {' '.join(f"WHEN contains(body, '{c}') THEN '{c}'" for c in P.LITERAL_CODES)} END END AS provider_code,
    TRY_CAST({d.first('body', P.RPC_CODE, 1)} AS BIGINT) AS rpc_code,
    TRY_CAST({d.first('body', P.ERRNO, 1)} AS BIGINT) AS errno,
    TRY_CAST(coalesce({d.first('body', P.EXIT_LABELLED, 1)}, {d.first('body', P.EXIT_SYSTEMD, 1)}, {d.first('body', P.EXIT_PHRASED, 1)}) AS BIGINT) AS exit_code,
    TRY_CAST(coalesce({d.first('body', P.ATTEMPT, 1)}, {d.first('body', P.POLL_ATTEMPT, 1)}) AS BIGINT) AS attempt,
    TRY_CAST(CASE WHEN {d.has('body', P.ATTEMPT)} THEN {d.first('body', P.ATTEMPT, 2)} ELSE {d.first('body', P.POLL_ATTEMPT, 2)} END AS BIGINT) AS max_attempts,
    coalesce({d.first('body', P.SIGNAL_NAME, 1)}, {d.first('body', P.SIGNAL_KILLED, 1)}) AS signal,
    CASE WHEN {d.has('body', P.STREAM_BEFORE)} THEN 'before_delivery' WHEN {d.has('body', P.STREAM_AFTER)} THEN 'after_delivery' END AS stream_stage,
    (starts_with(profile, 'system:') OR {d.has('text', P.CLEAR_SYSTEM)}) AS is_system,
    ({d.has('body', P.TUNING)} OR {d.has('body', P.OBSERVATION)}) AS is_observation,
    {CONTINUATION_SQL} AS is_continuation
  FROM attr_pick),
 attrs AS (SELECT *, {d.compact([
     f"CASE WHEN tool IS NOT NULL OR mcp_server IS NOT NULL OR starts_with(coalesce(component, ''), 'tools.') OR component = 'agent.tool_executor' THEN 'tool' END",
     f"CASE WHEN platform IS NOT NULL OR {_PLAT_COMP} OR {d.has('body', P.PLATFORM_SCOPE_TEXT)} THEN 'platform' END",
     f"CASE WHEN NOT is_system AND (provider IS NOT NULL OR {_LLM_COMP} OR {d.has('body', P.LLM_SCOPE_TEXT)}) THEN 'llm' END"])} AS scopes
  FROM attrs0)"""


def attributes(spark, folder):
    return A.add_attributes(parsed(spark, folder))


def _joined(name: str):
    return F.array_join(name, "|").alias(name)


_EVIDENCE = "CASE WHEN ref_provider IS NOT NULL THEN " + d.first("head", P.REFERENCE_MODEL) + \
    " WHEN len(named) = 1 THEN " + d.first("head", P.PROVIDER_PARAM, 1) + " WHEN len(routes) = 1 THEN CASE routes[1] " + \
    " ".join(f"WHEN {d.q(n)} THEN {d.first('head', p)}" for n, p in P.ROUTES) + " END WHEN marked IS NOT NULL THEN " + \
    d.first("head", P.COOLDOWN_PROVIDER) + " END"


@query("fn_provider", with_parsed(f"""SELECT line_id, provider, provider_certainty, {_EVIDENCE} AS provider_evidence,
    {d.join('provider_conflict')} AS provider_conflict FROM attrs""", ATTRIBUTES))
def provider(spark, folder):
    return A.add_provider(parsed(spark, folder)).select(
        "line_id", "provider", "provider_certainty", "provider_evidence", _joined("provider_conflict"))


@query("fn_model", with_parsed(f"SELECT line_id, model, {d.join('model_conflict')} AS model_conflict FROM attrs", ATTRIBUTES))
def model(spark, folder):
    return A.add_model(parsed(spark, folder)).select("line_id", "model", _joined("model_conflict"))


@query("fn_fallback_route", with_parsed("SELECT line_id, fallback_provider, fallback_model FROM attrs", ATTRIBUTES))
def fallback_route(spark, folder):
    return A.add_fallback_route(parsed(spark, folder)).select(
        "line_id", "fallback_provider", "fallback_model")


@query("fn_platform", with_parsed("SELECT line_id, platform FROM attrs", ATTRIBUTES))
def platform(spark, folder):
    return parsed(spark, folder).select("line_id", A.platform(F.col("component"), F.col("body")).alias("platform"))


@query("fn_tool_target", with_parsed("SELECT line_id, tool, target, database FROM attrs", ATTRIBUTES))
def tool_target(spark, folder):
    return A.add_tool_target(parsed(spark, folder)).select("line_id", "tool", "target", "database")


@query("fn_path_basename", with_parsed(f"SELECT line_id, {d.first('body', P.FILE_BASENAME, 1)} AS path_basename FROM parsed"))
def path_basename(spark, folder):
    return parsed(spark, folder).select("line_id", A.path_basename(F.col("body")).alias("path_basename"))


@query("fn_exceptions", with_parsed(f"SELECT line_id, exception, {d.join('exceptions')} AS exceptions FROM attrs", ATTRIBUTES))
def exceptions(spark, folder):
    return A.add_exceptions(parsed(spark, folder)).select("line_id", "exception", _joined("exceptions"))


@query("fn_http_status", with_parsed(f"SELECT line_id, http_status, {d.join('http_conflict')} AS http_conflict FROM attrs", ATTRIBUTES))
def http_status(spark, folder):
    return A.add_http_status(parsed(spark, folder)).select("line_id", "http_status", _joined("http_conflict"))


@query("fn_provider_codes", with_parsed(f"SELECT line_id, provider_code, {d.join('provider_codes')} AS provider_codes FROM attrs", ATTRIBUTES))
def provider_codes(spark, folder):
    return A.add_provider_codes(parsed(spark, folder)).select("line_id", "provider_code", _joined("provider_codes"))


@query("fn_numeric_codes", with_parsed("SELECT line_id, rpc_code, errno, exit_code, attempt, max_attempts FROM attrs", ATTRIBUTES))
def numeric_codes(spark, folder):
    return parsed(spark, folder).select("line_id", *[c.alias(n) for n, c in A.numeric_codes(F.col("body")).items()])


@query("fn_signal", with_parsed("SELECT line_id, signal FROM attrs", ATTRIBUTES))
def signal(spark, folder):
    return parsed(spark, folder).select("line_id", A.signal(F.col("body")).alias("signal"))


@query("fn_stream_stage", with_parsed("SELECT line_id, stream_stage FROM attrs", ATTRIBUTES))
def stream_stage(spark, folder):
    return parsed(spark, folder).select("line_id", A.stream_stage(F.col("body")).alias("stream_stage"))


@query("fn_scopes", with_parsed(f"SELECT line_id, {d.join('scopes')} AS scopes, is_system FROM attrs", ATTRIBUTES))
def scopes(spark, folder):
    return attributes(spark, folder).select("line_id", _joined("scopes"), "is_system")


@query("fn_observation", with_parsed("""SELECT line_id, is_observation,
    CASE WHEN NOT is_observation THEN http_status END AS http_status,
    CASE WHEN NOT is_observation THEN exception END AS exception FROM attrs""", ATTRIBUTES))
def observation(spark, folder):
    rows = A.add_exceptions(A.add_http_status(parsed(spark, folder))).withColumn("is_observation", A.is_observation(F.col("body")))
    return rows.select("line_id", "is_observation", *[
        F.when(~F.col("is_observation"), F.col(c)).alias(c) for c in ("http_status", "exception")])


# --- redaction, templates, resources, samples ---------------------------------------------------
REDACT_STEPS = [*T.REDACTIONS, (P.KEYED_SECRET, "$1=<REDACTED>")]


@query("fn_redact_secrets", f"""SELECT doc_id, md5({d.subs('text', REDACT_STEPS)}) AS redacted_md5,
    CAST(len(regexp_extract_all({d.subs('text', REDACT_STEPS)}, '<REDACTED>')) AS BIGINT) AS hits FROM documents""")
def redact_secrets(spark, folder):
    safe = adapters.spread(adapters.table(spark, folder, "documents"), "doc_id").select("doc_id", T.redact(F.col("text")).alias("safe"))
    return safe.select("doc_id", F.md5("safe").alias("redacted_md5"),
                       F.size(F.regexp_extract_all("safe", F.lit("<REDACTED>"), F.lit(0))).cast("bigint").alias("hits"))


def template_sql(text: str, is_system: str) -> str:
    """CTE body computing _safe, _urls, _plain and the template of ``text``."""
    steps = T.TEMPLATE_STEPS
    return f"""tmpl0 AS (SELECT *, {d.subs(f"coalesce({text}, '')", REDACT_STEPS)} AS t_safe FROM tmpl_in),
 tmpl1 AS (SELECT *, regexp_extract_all(t_safe, {d.q(P.URL)}) AS t_urls,
   {d.subs('t_safe', [(P.URL, P.URL_MARK), (P.LEADING_STAMP, ''), (P.FRAME_REFERENCE, 'File "<F>", line')])} AS t_plain0 FROM tmpl0),
 tmpl2 AS (SELECT *, CASE WHEN {is_system} THEN {d.subs('t_plain0', T.SHORTEN_PATHS)} ELSE {d.subs('t_plain0', T.DROP_PATHS)} END AS t_plain1 FROM tmpl1),
 tmpl3 AS (SELECT *, {d.subs('t_plain1', steps)} AS t_plain FROM tmpl2),
 templated AS (SELECT *, trim(regexp_replace(
   array_to_string(list_transform(string_split(t_plain, {d.q(P.URL_MARK)}), lambda p, i: p || coalesce(t_urls[i], '')), ''), '\\s+', ' ', 'g')) AS normalized_text FROM tmpl3)"""


@query("fn_normalize_template", d.with_lines(
    "SELECT line_id, normalized_text FROM templated",
    "tmpl_in AS (SELECT * FROM lines)", template_sql("text", f"starts_with(profile, 'system:')")))
def normalize_template(spark, folder):
    return T.add_template(adapters.lines(spark, folder), F.col("text"), F.col("profile").startswith("system:")).select(
        "line_id", "normalized_text")


@query("fn_normalize_documents", "WITH tmpl_in AS (SELECT * FROM documents), " + template_sql("text", "doc_id % 2 = 0")
       + " SELECT doc_id, md5(normalized_text) AS template_md5 FROM templated")
def normalize_documents(spark, folder):
    rows = T.add_template(adapters.spread(adapters.table(spark, folder, "documents"), "doc_id"), F.col("text"), F.col("doc_id") % 2 == 0)
    return rows.select("doc_id", F.md5("normalized_text").alias("template_md5"))


RESOURCE_STEPS = [(P.FRAME_REFERENCE, ""), *T.REDACTIONS, (P.KEYED_SECRET, "<REDACTED>")]


def resources_sql(text: str) -> str:
    clean = d.subs(text, RESOURCE_STEPS)
    return f"list_sort(list_distinct(list_concat({d.every(clean, P.WINDOWS_PATH)}, {d.every(clean, P.POSIX_PATH, 2)})))"


@query("fn_resources", d.with_lines(f"SELECT line_id, {d.join(resources_sql('text'))} AS resources FROM lines"))
def resources(spark, folder):
    return adapters.lines(spark, folder).select("line_id", F.array_join(T.resources(F.col("text")), "|").alias("resources"))


HOST_ALIASES = {"node-b": "beta"}


@query("fn_canonical_host", d.with_lines("""SELECT line_id, CASE WHEN raw IS NULL OR raw = '' THEN 'UNKNOWN'
    WHEN lower(trim(raw)) = 'node-b' THEN 'beta' ELSE trim(raw) END AS host
    FROM (SELECT line_id, CASE WHEN line_id % 10 = 0 THEN '' WHEN line_id % 10 = 1 THEN ' NODE-B ' ELSE host END AS raw FROM lines)"""))
def canonical_host(spark, folder):
    raw = F.when(F.col("line_id") % 10 == 0, "").when(F.col("line_id") % 10 == 1, " NODE-B ").otherwise(F.col("host"))
    return adapters.lines(spark, folder).select("line_id", T.canonical_host(raw, HOST_ALIASES).alias("host"))


@query("fn_clip_samples", d.with_lines("""SELECT line_id, substr(text, 1, 128) AS sample_128, length(text) > 128 AS truncated_128,
    substr(text, 1, 240) AS sample_240, length(text) > 240 AS truncated_240 FROM lines"""))
def clip_samples(spark, folder):
    short, long = T.clip(F.col("text"), 128), T.clip(F.col("text"), 240)
    return adapters.lines(spark, folder).select(
        "line_id", short["sample"].alias("sample_128"), short["sample_truncated"].alias("truncated_128"),
        long["sample"].alias("sample_240"), long["sample_truncated"].alias("truncated_240"))


# --- filters over scalar functions ----------------------------------------------------------------
@query("flt_fresh_72h", d.with_lines(f"""SELECT line_id, {d.iso('instant')} AS event_ts FROM staged
    WHERE instant BETWEEN {d.NOW_TS} - INTERVAL 72 HOUR AND {d.NOW_TS}""", LEADING_CTE))
def fresh_72h(spark, folder):
    rows = adapters.lines(spark, folder).withColumn("instant", T.leading_ts(F.col("text")))
    return rows.filter(T.is_fresh(F.col("instant"), F.lit(adapters.NOW).cast("timestamp"))).select(
        "line_id", T.canonical_text(F.col("instant")).alias("event_ts"))


@query("flt_journal_priority", f"""WITH {adapters.JOURNAL_CTE}
    SELECT line_id, PRIORITY AS priority FROM journal WHERE coalesce(TRY_CAST(PRIORITY AS INT), 99) <= 4""")
def journal_priority(spark, folder):
    return adapters.journal(spark, folder).filter(T.journal_priority(F.col("PRIORITY")) <= 4).select(
        "line_id", F.col("PRIORITY").alias("priority"))


# --- identities -------------------------------------------------------------------------------------
@query("fn_identity_ids", d.with_lines(f"""SELECT line_id,
    {d.digest("source_path", "byte_start", "byte_end", "text", "NULL", "stamp")} AS record_id,
    substr({d.digest("text", "'watch'")}, 1, 20) AS finding_id,
    host || '|' || profile || '|' || '' || '|' || event_type || '|' || source_path || '|' || CAST(byte_start AS STRING) AS event_key,
    CASE WHEN line_id % 9 = 0 THEN source_path ELSE source_path || ':' || CAST(byte_start AS STRING) || '-' || CAST(byte_end AS STRING) END AS pointer,
    sha256(text) AS notice_key FROM lines"""))
def identity_ids(spark, folder):
    c = F.col
    end = F.when(c("line_id") % 9 != 0, c("byte_end"))
    return adapters.lines(spark, folder).select(
        "line_id",
        I.record_id(c("source_path"), c("byte_start"), c("byte_end"), c("text"), F.lit(None), c("stamp")).alias("record_id"),
        I.finding_id(c("text"), F.lit("watch")).alias("finding_id"),
        I.event_key(c("host"), c("profile"), F.lit(None), c("event_type"), c("source_path"), c("byte_start")).alias("event_key"),
        I.source_pointer(c("source_path"), c("byte_start"), end).alias("pointer"),
        I.notice_key(c("text")).alias("notice_key"))
