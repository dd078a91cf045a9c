"""Rule classification: an ordered bank of literal patterns, as one projection.

Rules come from a JSON catalogue (users may pass their own). Each rule is
guarded by its scope and by plain substrings it cannot match without, so most
lines never reach the regular expression. Patterns are literals, compiled once
per task. All matches are kept, in catalogue order.
"""
from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_
from typing import Any
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import attributes as A
from tracewell.functions import regex as rx
from tracewell.plans import catalogue

Rule = dict[str, Any]
SYSTEM_NUMBERS = ("errno", "exit_code")
SYSTEM_ATTRIBUTES = (
    "event", "cause", "operation", "target", "component", "kind", "platform", "signal",
    "service_result", "device", "errno", "exit_code",
)
EXIT_CAUSES = ((124, "command_timeout"), (127, "command_not_found"), (130, "command_interrupted"))
HTTP_CAUSES = ((429, "rate_limited"), (502, "bad_gateway"), (503, "service_unavailable"), (504, "gateway_timeout"))
# A predicted failure is not an observed one.
PREDICTED_CAUSES = ("model_not_available_for_integrator", "model_unsupported")
PREDICTED_EVENTS = ("api.model_resolution_failed",)


def load(path: str | None = None) -> dict[str, Any]:
    """The shipped catalogue, or a JSON file with the same layout: version, causes, events and system."""
    if path is not None:
        with open(path, encoding="utf-8") as handle:
            return json.load(handle)
    return catalogue.shipped()


# The banks are written as SQL text: one parsed expression per bank is built much
# faster than thousands of Column calls, and plans to the same expressions.
def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pattern(rule: Rule) -> str:
    return _q(rule["pattern"])


def _fires(rule: Rule, text: str, lowered: str) -> str:
    """Scope, then plain words the pattern implies, then the pattern itself."""
    mentions = " OR ".join(f"contains({lowered}, {_q(n)})" for n in rule["needles"])
    scope = f"array_contains(scopes, {_q(rule['scope'])}) AND " if rule.get("scope") else ""
    return f"{scope}{f'({mentions}) AND ' if mentions else ''}{text} RLIKE {_pattern(rule)}"


def _hit(family: str, rule: Rule, fires: str, text: str) -> str:
    """One string "family.id=matched text"; rule ids contain no equals sign."""
    return f"CASE WHEN {fires} THEN concat({_q(family + rule['id'] + '=')}, regexp_extract({text}, {_pattern(rule)}, 0)) END"


EMPTY = "CAST(array() AS array<string>)"


PARTS = 48  # of a bank, one bit each
SLOTS = 1024


def _parts(items: list[Any]) -> list[list[Any]]:
    size = -(-len(items) // PARTS) or 1
    return [items[at:at + size] for at in range(0, len(items), size)]


def _words(rules: list[Rule]) -> list[str]:
    return sorted({word for rule in rules for word in rule["needles"]} - {""})


def find_words(words: list[str], lowered: str) -> str:
    """One pass over the text: at each place where words begin the longest of them."""
    return f"regexp_extract_all({lowered}, {_q(catalogue.any_of(words))}, 1)"


def _named_parts(rules: list[Rule], lowered: str) -> Column:
    """The parts of a bank (bits) whose rules may fire, by the plain words found in one pass over the text."""
    words = _words(rules)
    return _found_parts(rules, find_words(words, lowered) if words else EMPTY, words)


def _found_parts(rules: list[Rule], found: str, words: list[str]) -> Column:
    """``_named_parts`` by what ``find_words`` of ``words`` has found; these may be more than the words of this bank.

    A word stands for its parts through the remainder of its checksum; words that share one only make more parts be tested.
    """
    always, own = 0, {}
    for bit, part in enumerate(_parts(rules)):
        for rule in part:
            if not rule["needles"] or "" in rule["needles"]:
                always |= 1 << bit
            for word in rule["needles"]:
                own[word] = own.get(word, 0) | 1 << bit
    own.pop("", None)
    if not own:
        return F.lit(always).cast("bigint")
    slots = [0] * SLOTS
    for word in words:
        # of the words that begin at one place only the longest is found
        slots[crc32(word.encode()) % SLOTS] |= reduce(or_, [bits for w, bits in own.items() if word.startswith(w)], 0)
    table = f"array({', '.join(f'{bits}L' for bits in slots)})"
    return F.expr(f"aggregate({found}, {always}L, (bits, word) -> bits | {table}[CAST(crc32(word) % {SLOTS} AS int)])")


def _bank(items: list[str], gate: str, named: str = "") -> Column:
    """The non-null items, in order. With ``named``, a column of ``_named_parts``, only of the parts it names.

    array_compact makes Spark evaluate the list as an expression tree. As one
    piece of generated code it would be a method too large for the JIT.
    """
    if not items:
        return F.expr(EMPTY)
    held = f"array_compact(array({', '.join(items)}))"
    if named:
        parts = [f"CASE WHEN {named} & {1 << bit}L <> 0 THEN array_compact(array({', '.join(part)})) END" for bit, part in enumerate(_parts(items))]
        eights = [f"CASE WHEN {named} & {255 << at}L <> 0 THEN flatten(array_compact(array({', '.join(parts[at:at + 8])}))) END" for at in range(0, len(parts), 8)]
        held = f"flatten(array_compact(array({', '.join(eights)})))"
    return F.expr(f"CASE WHEN {gate} THEN {held} ELSE {EMPTY} END")


def _ids(matches: str, family: str) -> Column:
    return F.expr(f"transform({matches}, m -> substr(substring_index(m, '=', 1), {len(family) + 1}))")


def matched_text(match: Column) -> Column:
    return F.substr(match, F.locate("=", match) + 1)


FOUND = "_found_words"


def _named(df: DataFrame, rules: list[Rule], gate: str, words: list[str] | None) -> DataFrame:
    """Adds _named. With ``words``, the pass over the text for these was made before and is in the column FOUND."""
    named = _named_parts(rules, "body_lower") if words is None else _found_parts(rules, FOUND, words)
    return df.withColumn("_named", F.when(F.expr(gate), named))


def match_causes(df: DataFrame, rules: list[Rule], words: list[str] | None = None) -> DataFrame:
    """cause_matches ("cause.id=matched text") and causes; observations and continuations have none."""
    predicted = f"contains(body, {_q(P.PREDICTED)})"

    def hit(rule: Rule) -> str:
        fires = _fires(rule, "body", "body_lower")
        return _hit("cause.", rule, f"NOT {predicted} AND {fires}" if rule["id"] in PREDICTED_CAUSES else fires, "body")

    gate = "NOT is_observation AND NOT is_continuation"
    staged = _named(df, rules, gate, words).withColumn("_cause_hits", _bank([hit(r) for r in rules], gate, "_named")).drop("_named")

    def by_code(code: str, table: tuple[tuple[int, str], ...]) -> str:
        return f"CASE {code} " + " ".join(f"WHEN {n} THEN '{name}'" for n, name in table) + " END"

    ended = _bank([by_code("exit_code", EXIT_CAUSES)], f"{gate} AND array_contains(scopes, 'tool')")
    staged = staged.withColumn("_ended", ended).withColumn("_found", F.concat(_ids("_cause_hits", "cause."), "_ended"))
    status = _bank([by_code("http_status", HTTP_CAUSES)], f"{gate} AND size(_found) = 0")
    staged = staged.withColumn("_status", status)
    return staged.withColumns({
        "_causes": F.concat("_found", "_status"),
        "cause_matches": F.concat(
            "_cause_hits",
            F.transform("_ended", lambda c: F.concat(F.lit("cause."), c, F.lit(".exit_status="), A.exit_text(F.col("body")))),
            F.transform("_status", lambda _: F.concat(F.lit("cause.http_status="), A.http_text(F.col("body"))))),
    }).drop("_cause_hits", "_ended", "_found", "_status")


def labels(rules: list[Rule]) -> list[str]:
    """Rule ids; where one id stands for several operations, later ones carry their number."""
    seen: dict[str, list[str]] = {}
    out = []
    for rule in rules:
        known = seen.setdefault(rule["id"], [])
        if rule["operation"] not in known:
            known.append(rule["operation"])
        number = known.index(rule["operation"])
        out.append(f"{rule['id']}#{number}" if number else rule["id"])
    return out


def match_events(df: DataFrame, rules: list[Rule], words: list[str] | None = None) -> DataFrame:
    """event_matches and events; an observation only reports telemetry events."""
    def hit(rule: Rule, label: str) -> str:
        fires = _fires(rule, "body", "body_lower")
        if rule.get("requires"):
            fires = f"arrays_overlap(_causes, array({', '.join(_q(c) for c in rule['requires'])})) AND {fires}"
        if not rule.get("telemetry"):
            fires = f"NOT is_observation AND {fires}"
        if rule["id"] in PREDICTED_EVENTS:
            fires = f"NOT contains(body, {_q(P.PREDICTED)}) AND {fires}"
        return _hit("event.", {**rule, "id": label}, fires, "body")

    names = labels(rules)
    operations = ", ".join(f"{_q(k)}, {_q(r['operation'])}" for k, r in {k: r for k, r in zip(names, rules)}.items())
    gate = "NOT is_continuation"
    staged = _named(df, rules, gate, words).withColumn("_event_hits", _bank([hit(r, n) for r, n in zip(rules, names)], gate, "_named")).drop("_named")
    return staged.withColumn("_labels", _ids("_event_hits", "event.")).withColumns({
        "_operation": F.expr(f"try_element_at(map({operations}), try_element_at(_labels, 1))") if rules else F.lit(None).cast("string"),
        "_events": F.expr("transform(_labels, l -> substring_index(l, '#', 1))"),
        "event_matches": F.expr("transform(_event_hits, m -> regexp_replace(m, '^([^=#]*)#[0-9]+=', '$1='))"),
    }).drop("_event_hits", "_labels")


def _emitted(template: str | dict[str, Any], rule: Rule) -> str:
    """A value of a system rule. Text has $n replaced by the n-th group. Other forms: a group looked up in a map, a
    group or else a text, text in lower case, and the first of some patterns inside the match or else a text."""
    def group(n: int) -> str:
        return f"regexp_extract(text, {_pattern(rule)}, {n})"

    if isinstance(template, str):
        parts = [group(int(p[1:])) if re.fullmatch(r"\$\d", p) else _q(p) for p in re.split(r"(\$\d)", template) if p]
        return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]
    if "lower" in template:
        return f"lower({_emitted(template['lower'], rule)})"
    if "within" in template:
        inner = ", ".join(f"nullif(regexp_extract({group(0)}, {_q(p)}, 1), '')" for p in template["within"])
        return f"coalesce({inner}, {_q(template['else'])})"
    if "map" in template:
        whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in template["map"].items())
        return f"CASE {group(template['group'])} {whens} ELSE {_q(template['else'])} END"
    return f"coalesce(nullif({group(template['group'])}, ''), {_q(template['else'])})"


def match_system(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """System rules emit attributes; per attribute the most specific, then earliest, rule wins.

    Specificity is static, so the winner is the first branch of a CASE over the
    rules in descending specificity: no grouping is needed.
    """
    tests = ", ".join(f"CASE WHEN {_fires(r, 'text', 'text_lower')} THEN {i} END" for i, r in enumerate(rules))
    # the numbers of the rules that fire: few, so what they emit is made for them alone
    staged = df.withColumn("_hits", F.expr(f"CASE WHEN is_system THEN array_compact(CAST(array({tests}) AS array<int>)) END"))
    ranked = sorted(range(len(rules)), key=lambda i: (-rules[i]["specificity"], i))

    def winner(attribute: str) -> Column:
        whens = [f"WHEN array_contains(_hits, {i}) THEN {_emitted(rules[i]['emits'][attribute], rules[i])}"
                 for i in ranked if attribute in rules[i]["emits"]]
        value = f"CASE WHEN size(_hits) > 0 THEN CASE {' '.join(whens)} END END" if whens else "CAST(NULL AS string)"
        return F.expr(f"try_cast({value} AS bigint)" if attribute in SYSTEM_NUMBERS else value)

    def listed(values: dict[int, str]) -> Column:
        """The non-null ones among the values of the rules that fire, in order."""
        whens = " ".join(f"WHEN {i} THEN {value}" for i, value in values.items())
        return F.expr(f"CASE WHEN size(_hits) > 0 THEN array_compact(transform(_hits, hit -> CASE hit {whens} END)) ELSE {EMPTY} END" if values else EMPTY)

    def named(attribute: str) -> Column:
        return listed({i: _emitted(r["emits"][attribute], r) for i, r in enumerate(rules) if attribute in r["emits"]})

    return staged.withColumns({
        **{f"sys_{a}": winner(a) for a in SYSTEM_ATTRIBUTES},
        "_sys_events": named("event"), "_sys_causes": named("cause"),
        "system_matches": listed({i: f"concat({_q(r['id'] + '=')}, regexp_extract(text, {_pattern(r)}, 0))" for i, r in enumerate(rules)}),
    }).drop("_hits")


def _single(value: Column) -> Column:
    return rx.listed(value)


def _single_list(values: list[Column]) -> Column:
    return rx.listed(*values)


def finalize(df: DataFrame) -> DataFrame:
    """Overrides, order, and the primary event, cause, domain and kind."""
    c = F.col
    body = c("body")
    tuning, predicted = A.is_tuning(body), A.is_predicted(body)
    observed = ~c("is_observation")

    # Application side: overrides in the order in which they may replace each other.
    staged = df.withColumns({
        "_tuning": tuning,
        "_traced": c("is_continuation"),
        "_events": F.when(tuning, F.array(F.lit("api.watchdog_tuned"))).otherwise(c("_events")),
        "_causes": F.when(tuning, F.array(F.lit("watchdog_tuning"))).otherwise(c("_causes")),
        "_operation": F.when(tuning, "watchdog_tuning").otherwise(c("_operation")),
    }).withColumns({
        "_causes": F.concat(
            _single(F.when(predicted, F.lit("token_exchange_degraded"))),
            _single(F.when(F.array_contains("_events", "platform.operation_rate_limited"), F.lit("typing_rate_limited"))),
            "_causes"),
        "_events": F.when(c("is_continuation"), F.array(F.lit("runtime.traceback_continuation"))).otherwise(c("_events")),
    }).withColumns({
        "_events": F.when(
            (F.size("_events") == 0) & (F.size("exceptions") > 0) & ~c("is_system") & observed,
            F.array(F.lit("runtime.exception"))).otherwise(c("_events")),
        "_raised": (F.size("_events") == 0) & (F.size("exceptions") > 0) & ~c("is_system") & observed,
        "_operation": F.when(
            c("tool").isNotNull() & F.coalesce(c("_operation") == "execute", F.lit(True)),
            F.when(c("tool") == "terminal", "command_exec").when(c("tool") == "delegate_task", "subagent_delegate")
            .otherwise(c("tool"))).otherwise(c("_operation")),
    })
    blanked = ("http_status", "provider_code", "rpc_code", "exception", "errno")
    staged = staged.withColumns({
        **{name: F.when(observed, c(name)) for name in blanked},
        "exceptions": F.when(observed, c("exceptions")).otherwise(F.array().cast("array<string>")),
        "provider_codes": F.when(observed, c("provider_codes")).otherwise(F.array().cast("array<string>")),
    })

    # System side: its values come first and replace application values.
    shared = ("target", "component", "platform", "signal", "errno", "exit_code")
    replaced = {a: F.coalesce(c(f"sys_{a}"), c(a)) for a in shared}
    staged = staged.withColumns({
        **replaced,
        "app_component": c("component"),
        "from_system": _single_list([F.when(c(f"sys_{a}").isNotNull(), F.lit(a)) for a in (*shared, "operation")]),
        "operation": F.coalesce(c("sys_operation"), c("_operation")),
        "service_result": c("sys_service_result"),
        "device": c("sys_device"),
        "events": F.array_distinct(F.concat(_single(c("sys_event")), "_sys_events", "_events")),
        "causes": F.array_distinct(F.concat(_single(c("sys_cause")), "_sys_causes", "_causes")),
        "is_continuation": c("is_continuation") | F.coalesce(c("sys_kind") == "continuation", F.lit(False)),
    }).withColumns({
        "event": F.try_element_at("events", F.lit(1)),
        "cause": F.try_element_at("causes", F.lit(1)),
    })
    family = F.substring_index(c("event"), ".", 1)
    domains = F.create_map(*[F.lit(v) for pair in P.DOMAINS for v in pair])
    quiet = F.coalesce(c("event").isin("platform.discovery", "runtime.gateway_exit"), F.lit(False))
    return staged.withColumns({
        "domain": F.coalesce(F.try_element_at(domains, family), F.when(c("is_system"), "system")),
        "kind": F.when(c("is_continuation"), "continuation").when(c("is_observation") | quiet, "observation")
        .otherwise(F.coalesce(c("sys_kind"), F.lit("incident"))),
        "matched_rules": F.concat(
            "cause_matches", "event_matches",
            _single(F.when(c("_tuning"), F.concat(F.lit("event.api.watchdog_tuned="), rx.first(body, P.TUNING)))),
            _single(F.when(c("_traced"), F.concat(F.lit("evidence.traceback="), F.substring(body, 1, 100)))),
            _single(F.when(c("_raised"), F.concat(F.lit("event.runtime.exception="), A.exception_text(body, c("exception"))))),
            "system_matches"),
    }).drop("_tuning", "_traced", "_raised", "_events", "_causes", "_operation", "_sys_events", "_sys_causes", "text_lower",
            *[f"sys_{a}" for a in SYSTEM_ATTRIBUTES])


EVIDENCE_FIELDS = (
    ("provider", "provider_certainty"), ("model", None), ("fallback_provider", None), ("fallback_model", None),
    ("tool", None), ("exception", None), ("http_status", None), ("provider_code", None), ("rpc_code", None),
    ("errno", None), ("exit_code", None), ("signal", None), ("attempt", None), ("max_attempts", None),
    ("log_level", None), ("component", None), ("database", None), ("path_basename", None), ("stream_stage", None),
)
DERIVED_FIELDS = ("platform", "target", "operation", "event", "cause", "domain")
SYSTEM_SOURCE = "system_rules"


@rx.once
def _evidence() -> dict[str, Column]:
    def entries(fields: list[tuple[str, Column]]) -> Column:
        return F.map_from_entries(F.array_compact(F.array(*[
            F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value"))) for name, value in fields])))

    c = F.col
    certainty = [(n, c(k) if k else F.when(c(n).isNotNull(), "explicit")) for n, k in EVIDENCE_FIELDS]
    certainty += [(n, F.when(c(n).isNotNull(), "derived")) for n in DERIVED_FIELDS]

    def first_of(family: str) -> Column:
        of_family = F.filter("matched_rules", lambda m: m.startswith(family))
        return matched_text(F.try_element_at(of_family, F.lit(1)))

    texts = A.evidence_texts(c("body"), c("app_component"), c("body_lower"))
    texts.update(log_level=F.lit("log_prefix"), component=F.lit("log_prefix"), provider=c("provider_evidence"), event=first_of("event."),
                 cause=first_of("cause."), domain=F.when(c("event").isNotNull(), "event_family").otherwise("profile"))
    texts["operation"] = F.when(F.coalesce(c("operation") == "watchdog_tuning", F.lit(False)), rx.first(c("body"), P.TUNING)).when(
        c("tool").isNotNull() & c("operation").isin(c("tool"), F.lit("command_exec"), F.lit("subagent_delegate")), texts["tool"]).otherwise(first_of("event."))

    def source(name: str) -> Column:
        value = c(name).cast("string")
        text = F.coalesce(texts[name], value) if name in texts else value
        return F.when(F.array_contains("from_system", name), SYSTEM_SOURCE).otherwise(text)

    names = [n for n, _ in EVIDENCE_FIELDS] + list(DERIVED_FIELDS)
    # a cause or event without a match of its own (a prediction, a typing limit) has no evidence
    own = {"cause": texts["cause"], "event": texts["event"]}
    evidence = [(n, F.when(c(n).isNotNull(), own[n] if n in own else source(n))) for n in names]
    conflict = "array<struct<field:string,candidates:array<string>>>"
    conflicts = F.array_compact(F.array(*[
        F.when(c(f"{name}_conflict").isNotNull(), F.struct(F.lit(field).alias("field"), c(f"{name}_conflict").alias("candidates")))
        for field, name in (("provider", "provider"), ("model", "model"), ("http_status", "http"))])).cast(conflict)
    return {"field_evidence": entries(evidence), "field_confidence": entries(certainty), "conflicts": conflicts}


def field_evidence(df: DataFrame) -> DataFrame:
    """field_evidence (the matched text, or where the value is from), field_confidence (explicit or derived), conflicts."""
    return df.withColumns(_evidence())


MATCHED = ("text", "text_lower", "body", "body_lower", "scopes", "is_system", "is_observation", "is_continuation", "http_status", "exit_code")
FINALIZED = ("tool", "target", "component", "platform", "signal", "errno", "exception", "exceptions", "provider_code", "provider_codes", "rpc_code")


def classify(df: DataFrame, book: dict[str, Any] | None = None) -> DataFrame:
    """Every classification column for records with text and profile."""
    from tracewell.functions.text import parse_prefix

    book = book or load()

    words = sorted({*_words(book["causes"]), *_words(book["events"])})

    def match(rows: DataFrame) -> DataFrame:
        found = F.expr(f"CASE WHEN NOT is_continuation THEN {find_words(words, 'body_lower') if words else EMPTY} END")
        rows = match_causes(rows.withColumn(FOUND, found), book["causes"], words)
        return match_system(match_events(rows, book["events"], words).drop(FOUND), book["system"])

    # most attributes have no part in the banks, whose many projections would copy them one by one
    staged = rx.aside(A.add_attributes(parse_prefix(df)), (*MATCHED, *FINALIZED), lambda rows: finalize(rx.aside(rows, MATCHED, match)))
    return staged.withColumn("rule_version", F.lit(book["version"]))
