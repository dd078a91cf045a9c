"""Rule classification, severity policy, fingerprints and enrichment."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import attributes as A
from tracewell.functions import identity as I
from tracewell.plans import enrich as E
from tracewell.plans import policy as S
from tracewell.plans import rules as R
from tracewell.queries import adapters, duck as d
from tracewell.queries.registry import query
from tracewell.queries.text import ATTRIBUTES, HOST_ALIASES, attributes, resources_sql, template_sql, with_parsed

BOOK = R.load()
POLICY = S.load()
BASIC_POLICY = S.load(basic=True)
# A second policy with other labels, a rule without id and an ill-formed rule.
OTHER_POLICY = {"version": "strict", "default": "ignore", "rules": [
    {"when": {"causes_any": ["timeout", "missing_access"], "log_level": ["ERROR", "CRITICAL"]}, "label": "needs-attention"},
    {"id": "broken", "when": "not an object", "label": "needs-attention"},
    {"id": "families", "when": {"domain": ["llm", "system"]}, "label": "watch"},
]}


# --- the same catalogue as DuckDB SQL, without the substring guards ----------------------------
def _pat(rule):
    return d.q(rule["pattern"])


def _match(rule, text, extra=""):
    scope = f"list_contains(scopes, '{rule['scope']}') AND " if rule.get("scope") else ""
    return f"{scope}{extra}regexp_matches({text}, {_pat(rule)})"


def _pairs(items):
    """List of 'id=matched' strings for the rules that fire."""
    return d.compact([f"CASE WHEN {cond} THEN '{rid}' || '=' || regexp_extract({text}, {pat}) END" for cond, rid, text, pat in items])


def _codes(column, table):
    return f"CASE {column} " + " ".join(f"WHEN {n} THEN '{name}'" for n, name in table) + " END"


_PRED = f"contains(body, {d.q(P.PREDICTED)})"
_CAUSE_ITEMS = [(_match(r, "body", f"NOT {_PRED} AND " if r["id"] in R.PREDICTED_CAUSES else ""), r["id"], "body", _pat(r)) for r in BOOK["causes"]]
_EVENT_ITEMS = []
for _r in BOOK["events"]:
    _extra = "" if _r.get("telemetry") else "NOT is_observation AND "
    if _r.get("requires"):
        _extra += "list_has_any(causes0, [" + ", ".join(f"'{c}'" for c in _r["requires"]) + "]) AND "
    if _r["id"] in R.PREDICTED_EVENTS:
        _extra += f"NOT {_PRED} AND "
    _EVENT_ITEMS.append((_match(_r, "body", _extra), _r["id"], "body", _pat(_r)))
_IDS = "list_transform({}, lambda x: split_part(x, '=', 1))"
_EXIT_TEXT, _HTTP_TEXT = (d.first("body", p) for p in (A.either(P.EXIT_LABELLED, P.EXIT_SYSTEMD, P.EXIT_PHRASED), A.HTTP_EITHER))
_OPERATION = "CASE " + " ".join(f"WHEN {c} THEN '{r['operation']}'" for (c, *_), r in zip(_EVENT_ITEMS, BOOK["events"])) + " END"
MATCHED = ATTRIBUTES + f""", c1 AS (SELECT *, CASE WHEN is_observation OR is_continuation THEN [] ELSE {_pairs(_CAUSE_ITEMS)} END AS cause_hits FROM attrs),
 c2 AS (SELECT *, CASE WHEN NOT is_observation AND NOT is_continuation AND list_contains(scopes, 'tool')
     THEN {d.compact([_codes('exit_code', R.EXIT_CAUSES)])} ELSE [] END AS by_exit FROM c1),
 c2b AS (SELECT *, list_concat({_IDS.format('cause_hits')}, by_exit) AS causes_a FROM c2),
 c2c AS (SELECT *, CASE WHEN NOT is_observation AND NOT is_continuation AND len(causes_a) = 0
     THEN {d.compact([_codes('http_status', R.HTTP_CAUSES)])} ELSE [] END AS by_status FROM c2b),
 c3 AS (SELECT *, list_concat(causes_a, by_status) AS causes0,
     list_concat(cause_hits, list_transform(by_exit, lambda x: x || '.exit_status=' || {_EXIT_TEXT}),
       list_transform(by_status, lambda x: 'http_status=' || {_HTTP_TEXT})) AS cause_pairs FROM c2c),
 e1 AS (SELECT *, CASE WHEN is_continuation THEN [] ELSE {_pairs(_EVENT_ITEMS)} END AS event_pairs,
     CASE WHEN NOT is_continuation THEN {_OPERATION} END AS first_op FROM c3),
 e2 AS (SELECT *, {_IDS.format('event_pairs')} AS events0 FROM e1)"""


def _emit(template, rule):
    import re

    def group(n):
        return f"regexp_extract(text, {_pat(rule)}, {n})"

    if isinstance(template, str):
        return " || ".join(group(int(p[1:])) if re.fullmatch(r"\$\d", p) else d.q(p) for p in re.split(r"(\$\d)", template) if p)
    if "lower" in template:
        return f"lower({_emit(template['lower'], rule)})"
    if "within" in template:
        inner = ", ".join(f"nullif(regexp_extract({group(0)}, {d.q(p)}, 1), '')" for p in template["within"])
        return f"coalesce({inner}, {d.q(template['else'])})"
    if "map" in template:
        return f"CASE {group(template['group'])} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in template["map"].items()) + f" ELSE '{template['else']}' END"
    return f"coalesce(nullif({group(template['group'])}, ''), {d.q(template['else'])})"


_SYS = BOOK["system"]
_RANKED = sorted(range(len(_SYS)), key=lambda i: (-_SYS[i]["specificity"], i))


def _sys_attr(attribute):
    whens = " ".join(f"WHEN hits[{i + 1}] THEN {_emit(_SYS[i]['emits'][attribute], _SYS[i])}" for i in _RANKED if attribute in _SYS[i]["emits"])
    value = f"CASE {whens} END"
    if attribute in R.SYSTEM_NUMBERS:
        value = f"TRY_CAST({value} AS BIGINT)"
    return f"CASE WHEN is_system THEN {value} END AS sys_{attribute}"


def _sys_list(attribute):
    return "CASE WHEN is_system THEN " + d.compact(
        [f"CASE WHEN hits[{i + 1}] THEN {_emit(r['emits'][attribute], r)} END" for i, r in enumerate(_SYS) if attribute in r["emits"]]) + " ELSE [] END"


SYSTEM = f"""s1 AS (SELECT *, [{', '.join(f"is_system AND regexp_matches(text, {_pat(r)})" for r in _SYS)}] AS hits FROM e2),
 s2 AS (SELECT *, {', '.join(_sys_attr(a) for a in R.SYSTEM_ATTRIBUTES)}, {_sys_list('event')} AS sys_events, {_sys_list('cause')} AS sys_causes,
   {d.compact([f"CASE WHEN hits[{i + 1}] THEN '{r['id']}=' || regexp_extract(text, {_pat(r)}) END" for i, r in enumerate(_SYS)])} AS system_pairs FROM s1)"""
_TUNE = d.has("body", P.TUNING)
_DOMAIN = "CASE split_part(event, '.', 1) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.DOMAINS) + " END"
FINAL = MATCHED + ", " + SYSTEM + f""", f1 AS (SELECT * REPLACE (
     CASE WHEN {_TUNE} THEN ['api.watchdog_tuned'] ELSE events0 END AS events0,
     CASE WHEN {_TUNE} THEN ['watchdog_tuning'] ELSE causes0 END AS causes0),
   CASE WHEN {_TUNE} THEN 'watchdog_tuning' ELSE first_op END AS op0, {_TUNE} AS tuned, is_continuation AS traced FROM s2),
 f2 AS (SELECT * REPLACE (
     list_concat(CASE WHEN {_PRED} THEN ['token_exchange_degraded'] ELSE [] END,
       CASE WHEN list_contains(events0, 'platform.operation_rate_limited') THEN ['typing_rate_limited'] ELSE [] END, causes0) AS causes0,
     CASE WHEN is_continuation THEN ['runtime.traceback_continuation'] ELSE events0 END AS events0) FROM f1),
 f3 AS (SELECT *, len(events0) = 0 AND len(exceptions) > 0 AND NOT is_system AND NOT is_observation AS raised FROM f2),
 f3b AS (SELECT * REPLACE (
     CASE WHEN raised THEN ['runtime.exception'] ELSE events0 END AS events0,
     CASE WHEN tool IS NOT NULL AND (op0 IS NULL OR op0 = 'execute')
       THEN CASE tool WHEN 'terminal' THEN 'command_exec' WHEN 'delegate_task' THEN 'subagent_delegate' ELSE tool END ELSE op0 END AS op0) FROM f3),
 f4 AS (SELECT * REPLACE (
     CASE WHEN NOT is_observation THEN http_status END AS http_status, CASE WHEN NOT is_observation THEN provider_code END AS provider_code,
     CASE WHEN NOT is_observation THEN rpc_code END AS rpc_code, CASE WHEN NOT is_observation THEN exception END AS exception,
     coalesce(sys_errno, CASE WHEN NOT is_observation THEN errno END) AS errno,
     CASE WHEN is_observation THEN [] ELSE exceptions END AS exceptions,
     coalesce(sys_target, target) AS target, coalesce(sys_component, component) AS component, coalesce(sys_platform, platform) AS platform,
     coalesce(sys_signal, signal) AS signal, coalesce(sys_exit_code, exit_code) AS exit_code),
   component AS app_component, coalesce(sys_operation, op0) AS operation, sys_service_result AS service_result, sys_device AS device,
   list_concat({d.compact(['sys_event'])}, sys_events, events0) AS events1, list_concat({d.compact(['sys_cause'])}, sys_causes, causes0) AS causes1 FROM f3b),
 f5 AS (SELECT * REPLACE ((is_continuation OR coalesce(sys_kind = 'continuation', false)) AS is_continuation),
   {d.distinct('events1')} AS events, {d.distinct('causes1')} AS causes FROM f4),
 f6 AS (SELECT *, events[1] AS event, causes[1] AS cause,
   list_concat(list_transform(cause_pairs, lambda x: 'cause.' || x), list_transform(event_pairs, lambda x: 'event.' || x),
     {d.compact([f"CASE WHEN tuned THEN 'event.api.watchdog_tuned=' || {d.first('body', P.TUNING)} END",
                 "CASE WHEN traced THEN 'evidence.traceback=' || substr(body, 1, 100) END",
                 f"CASE WHEN raised THEN 'event.runtime.exception=' || coalesce({d.first('body', P.ERROR_TYPE)}, exception) END"])},
     system_pairs) AS matched_rules FROM f5),
 classified AS (SELECT *, coalesce({_DOMAIN}, CASE WHEN is_system THEN 'system' END) AS domain,
   CASE WHEN is_continuation THEN 'continuation'
        WHEN is_observation OR coalesce(event IN ('platform.discovery', 'runtime.gateway_exit'), false) THEN 'observation'
        ELSE coalesce(sys_kind, 'incident') END AS kind FROM f6)"""


def severity_sql(policy):
    whens, labels = [], []
    for index, rule in enumerate(policy["rules"]):
        if not isinstance(rule.get("when"), dict):
            continue
        tests = []
        for key, values in rule["when"].items():
            quoted = ", ".join(d.q(v) for v in values)
            tests.append(f"(list_has_any(causes, [{quoted}]) OR coalesce(cause IN ({quoted}), false))" if key == "causes_any"
                         else f"coalesce({key} IN ({quoted}), false)")
        whens.append((" AND ".join(tests), rule["label"], rule.get("id") or f"rule-{index}"))
    label = "CASE " + " ".join(f"WHEN {t} THEN '{lab}'" for t, lab, _ in whens) + f" ELSE '{policy['default']}' END"
    rid = "CASE " + " ".join(f"WHEN {t} THEN '{r}'" for t, _, r in whens) + " ELSE 'default' END"
    return label, rid


LABEL, RULE_ID = severity_sql(POLICY)
BASIC_LABEL, BASIC_RULE_ID = severity_sql(BASIC_POLICY)
SEVERE = FINAL + f", graded AS (SELECT *, {LABEL} AS severity, {RULE_ID} AS severity_rule_id FROM classified)"
_KEY_PARTS = []
for _f in E.SEMANTIC_FIELDS:
    _KEY_PARTS.append(d.packed_list(_f) if _f in E.LIST_FIELDS else _f)
_SYS_PROFILE = "(coalesce(domain = 'system', false) OR coalesce(starts_with(profile, 'system:'), false))"
_HOST = "CASE WHEN host IS NULL OR host = '' THEN 'UNKNOWN' WHEN lower(trim(host)) = 'node-b' THEN 'beta' ELSE trim(host) END"
FINGERPRINTED = SEVERE + ", tmpl_in AS (SELECT * FROM graded), " + template_sql("text", _SYS_PROFILE) + f""",
 keyed AS (SELECT *, {_HOST} AS fp_host, {resources_sql('text')} AS resources FROM templated),
 enriched AS (SELECT *, {d.digest(d.packed_list('resources'), 'fp_host', 'profile', 'normalized_text', *_KEY_PARTS)} AS fingerprint FROM keyed)"""


def classified(spark, folder):
    return R.classify(adapters.lines(spark, folder), BOOK)


def enriched(spark, folder):
    """Lines enriched with the shipped rules and policy; record ids give a total order."""
    rows = adapters.balanced(adapters.lines(spark, folder)).drop("ts").withColumnRenamed("stamp", "ts")
    return E.enrich(rows, POLICY, BOOK, HOST_ALIASES)


def _list(column, name=None):
    return F.array_join(column, "|").alias(name or column)


def _pair_list(column, name, family=""):
    return F.regexp_replace(F.array_join(column, "|"), r"(^|\|)" + family.replace(".", r"\."), "$1").alias(name)


def _prepared(spark, folder):
    return attributes(spark, folder)


@query("rule_causes", with_parsed(f"SELECT line_id, {d.join('causes0')} AS causes, {d.join('cause_pairs')} AS matched FROM c3", MATCHED))
def rule_causes(spark, folder):
    return R.match_causes(_prepared(spark, folder), BOOK["causes"]).select(
        "line_id", _list("_causes", "causes"), _pair_list("cause_matches", "matched", "cause."))


@query("rule_events", with_parsed(f"SELECT line_id, {d.join('events0')} AS events, {d.join('event_pairs')} AS matched FROM e2", MATCHED))
def rule_events(spark, folder):
    staged = R.match_events(R.match_causes(_prepared(spark, folder), BOOK["causes"]), BOOK["events"])
    return staged.select("line_id", _list("_events", "events"), _pair_list("event_matches", "matched", "event."))


@query("rule_system", with_parsed(
    f"SELECT line_id, {', '.join(f'sys_{a} AS {a}' for a in R.SYSTEM_ATTRIBUTES)}, {d.join('system_pairs')} AS matched FROM s2 WHERE is_system",
    MATCHED, SYSTEM))
def rule_system(spark, folder):
    staged = R.match_system(attributes(spark, folder).filter("is_system"), BOOK["system"])
    return staged.select("line_id", *[F.col(f"sys_{a}").alias(a) for a in R.SYSTEM_ATTRIBUTES], _pair_list("system_matches", "matched"))


_FINAL_COLUMNS = ("event", "cause", "domain", "kind", "operation", "target", "component", "platform", "signal",
                  "http_status", "provider_code", "errno", "exit_code", "service_result", "device")


@query("rule_finalize", with_parsed(
    f"SELECT line_id, {', '.join(_FINAL_COLUMNS)}, {d.join('events')} AS events, {d.join('causes')} AS causes, {d.join('matched_rules')} AS matched_rules FROM classified", FINAL))
def rule_finalize(spark, folder):
    return classified(spark, folder).select("line_id", *_FINAL_COLUMNS, _list("events"), _list("causes"), _list("matched_rules"))


def _evidence_sql(family):
    """The matched text of the first rule of the family."""
    hit = f"list_filter(matched_rules, lambda m: starts_with(m, '{family}.'))[1]"
    return f"CASE WHEN {family} IS NOT NULL THEN substr({hit}, strpos({hit}, '=') + 1) END"


_EXPLICIT = [n for n, k in R.EVIDENCE_FIELDS if k is None]
_PRESENT = " + ".join(f"CAST({n} IS NOT NULL AS BIGINT)" for n in [*_EXPLICIT, "provider_certainty"])
_DERIVED = " + ".join(f"CAST({n} IS NOT NULL AS BIGINT)" for n in R.DERIVED_FIELDS)


@query("rule_field_evidence", with_parsed(f"""SELECT line_id, {_PRESENT} + {_DERIVED} AS confident_fields,
    {_DERIVED} + CAST(coalesce(provider_certainty = 'derived', false) AS BIGINT) AS derived_fields,
    CAST(provider_conflict IS NOT NULL AS BIGINT) + CAST(model_conflict IS NOT NULL AS BIGINT) + CAST(http_conflict IS NOT NULL AS BIGINT) AS conflicts,
    {_evidence_sql('cause')} AS cause_evidence, {_evidence_sql('event')} AS event_evidence,
    CASE WHEN exit_code IS NOT NULL THEN CASE WHEN sys_exit_code IS NOT NULL THEN 'system_rules' ELSE {_EXIT_TEXT} END END AS exit_evidence,
    CASE WHEN http_status IS NOT NULL THEN {_HTTP_TEXT} END AS http_evidence,
    CASE WHEN platform IS NOT NULL THEN CASE WHEN sys_platform IS NOT NULL THEN 'system_rules' ELSE coalesce(nullif(app_component, ''), substr(body, 1, 100)) END END AS platform_evidence FROM
    (SELECT *, {d.first('body', P.FILE_BASENAME, 1)} AS path_basename FROM classified)""", FINAL))
def rule_field_evidence(spark, folder):
    rows = R.field_evidence(classified(spark, folder))
    values = F.map_values("field_confidence")
    return rows.select(
        "line_id", F.size("field_confidence").cast("bigint").alias("confident_fields"),
        F.size(F.filter(values, lambda v: v == "derived")).cast("bigint").alias("derived_fields"),
        F.size("conflicts").cast("bigint").alias("conflicts"),
        *[F.try_element_at("field_evidence", F.lit(name)).alias(f"{alias}_evidence") for name, alias in (
            ("cause", "cause"), ("event", "event"), ("exit_code", "exit"), ("http_status", "http"), ("platform", "platform"))])


def _graded(spark, folder, policy):
    """A policy over the records that are classified and stored already."""
    from tracewell.queries import groups
    rows = S.reapply(groups.store(spark, folder), policy)
    return rows.select("line_id", F.col("severity.label").alias("severity"), F.col("severity.rule_id").alias("severity_rule_id"))


@query("policy_severity", with_parsed("SELECT line_id, severity, severity_rule_id FROM graded", SEVERE))
def policy_severity(spark, folder):
    return _graded(spark, folder, POLICY)


@query("policy_severity_basic", with_parsed(f"SELECT line_id, {BASIC_LABEL} AS severity, {BASIC_RULE_ID} AS severity_rule_id FROM classified", FINAL))
def policy_severity_basic(spark, folder):
    return _graded(spark, folder, BASIC_POLICY)


@query("fn_fingerprint", with_parsed("SELECT line_id, fingerprint, normalized_text, fp_host AS host FROM enriched", FINGERPRINTED))
def fingerprint(spark, folder):
    rows = enriched(spark, folder)
    return rows.select("line_id", F.col("fingerprint.key").alias("fingerprint"), "fingerprint.normalized_text", "fingerprint.host")


@query("fn_enrich_namespaced", with_parsed("""SELECT line_id, event_type AS classification, event, kind, severity AS severity_label,
    fingerprint AS fingerprint_key, source_path, byte_start FROM enriched""", FINGERPRINTED))
def enrich_namespaced(spark, folder):
    # The input already has a column called classification: it must survive.
    rows = adapters.lines(spark, folder).drop("ts").withColumn("classification", F.col("event_type"))
    out = E.enrich(rows, POLICY, BOOK, HOST_ALIASES)
    made = "generated.classification"
    return out.select("line_id", "classification", F.col(f"{made}.event").alias("event"), F.col(f"{made}.kind").alias("kind"),
                      F.col("severity.label").alias("severity_label"), F.col("fingerprint.key").alias("fingerprint_key"),
                      "provenance.source_path", "provenance.byte_start")


_SLOT_MAP = " ".join(f"WHEN component = '{a}' THEN '{b}'" for a, b in P.FUNCTION_SLOTS)
_SLOT_PREFIX = " ".join(f"WHEN starts_with(component, '{a}.') THEN '{b}'" for a, b in P.FUNCTION_SLOTS)
SLOT = f"""CASE WHEN tool = 'delegate_task' OR operation IN ('subagent_delegate', 'delegation') THEN 'delegation'
  WHEN operation = 'fallback' THEN 'fallback' WHEN operation IN ('title_generation', 'title') THEN 'title'
  WHEN operation IN ('aux', 'auxiliary') THEN 'aux' {_SLOT_MAP} {_SLOT_PREFIX} WHEN starts_with(component, 'gateway.') THEN 'gateway'
  WHEN operation <> '' THEN operation WHEN starts_with(component, 'agent.') THEN substr(component, 7)
  WHEN component <> '' THEN component ELSE 'unknown' END"""


@query("fn_function_slot", with_parsed(f"SELECT line_id, {SLOT} AS slot FROM classified", FINAL))
def function_slot(spark, folder):
    from tracewell.functions.attributes import function_slot as slot
    return classified(spark, folder).select("line_id", slot(F.col("tool"), F.col("operation"), F.col("component")).alias("slot"))


@query("fn_mechanism_key", with_parsed("""SELECT line_id, CASE WHEN coalesce(cause IN ('missing_access', 'websocket_unhealthy', 'adapter_error'), false) THEN NULL ELSE event END AS event,
    cause, CASE WHEN coalesce(cause IN ('missing_access', 'websocket_unhealthy', 'adapter_error'), false) THEN NULL ELSE component END AS component FROM classified""", FINAL))
def mechanism_key(spark, folder):
    key = I.mechanism_key(F.col("event"), F.col("cause"), F.col("component"))
    return classified(spark, folder).select("line_id", key.alias("k")).select("line_id", "k.event", "k.cause", "k.component")
