"""Attributes read from the body of a record, all as built-in expressions.

``add_attributes`` expects the columns of ``parse_prefix`` plus ``profile``.
Intermediate lists are staged in their own projections so that no pattern is
evaluated twice.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import regex as rx


def _low(body: Column, lowered: Column | None) -> Column:
    """The staged lower-cased text where there is one; lower() in every test would run every time."""
    return F.lower(body) if lowered is None else lowered


LOW = "body_lower"
ROUTE_WORDS = ("codex", "openrouter", "googleapis", "geminiapi", "api.openai", "xai-oauth", "copilot")
MODEL_WORDS = ("gpt-", "o1", "o3", "o4", "gemini-", "claude-", "deepseek-", "grok-")
SYSTEM_WORDS = ("systemd", "kernel", "cifs:", "networkmanager", "xrdp", "pam_", "sshd", "oom-kill", "out of memory:",
                "failed with result", "searx.", "mds cpu", "vmscape", "firmware bug", "microcode")


HEAD, TAIL = "_head", "_tail"


def either(*patterns: str) -> str:
    """One pattern for the first match of any; all ignore case."""
    return "(?i)" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in patterns)


HTTP_EITHER = either(P.HTTP_LABELLED, P.HTTP_PHRASED)


def fallback_columns(body: Column) -> tuple[Column, Column]:
    """The text before a fallback clause, and the clause with the rest (null without one)."""
    at = F.regexp_instr(body, F.lit(P.FALLBACK))
    return F.when(at > 0, F.substr(body, F.lit(1), at - 1)).otherwise(body), F.when(at > 0, F.substr(body, at))


def fallback_split() -> rx.Steps:
    """_head: the part before a fallback clause, which describes the failing route; _tail: the rest."""
    at = F.col("_at")
    clause = F.when(rx.mentions(F.col(LOW), "fallback", "falling back"), F.regexp_instr("body", F.lit(P.FALLBACK))).otherwise(0)
    return [{"_at": clause}, {
        HEAD: F.when(at > 0, F.substr("body", F.lit(1), at - 1)).otherwise(F.col("body")),
        TAIL: F.when(at > 0, F.substr("body", at)),
    }]


@rx.once
def _provider() -> rx.Steps:
    """provider, its evidence and certainty, and the candidates when they disagree."""
    head, low = F.col(HEAD), F.col(LOW)
    routes = rx.listed(*[F.when(rx.has(head, p), F.lit(name)) for name, p in P.ROUTES])
    chosen = F.coalesce(rx.only(F.col("_named")), rx.only(F.col("_routes")))
    route_text = F.coalesce(*[F.when(chosen == name, rx.first(head, p)) for name, p in P.ROUTES])
    any_source = F.coalesce(F.col("_referred"), chosen, F.col("_marked"))
    return [*fallback_split(), {
        "_named": F.array_distinct(rx.every_if(low.contains("provider"), head, P.PROVIDER_PARAM, 2)),
        "_marked": rx.first_if(low.contains("marking"), head, P.COOLDOWN_PROVIDER, 1),
        "_referred": rx.first_if(low.contains("reference model"), head, P.REFERENCE_MODEL, 1),
    }, {
        "_routes": F.when((F.size("_named") == 0) & rx.mentions(low, *ROUTE_WORDS), routes)
        .otherwise(F.array().cast("array<string>")),
    }, {
        "provider": any_source,
        "provider_evidence": F.when(F.col("_referred").isNotNull(), rx.first(head, P.REFERENCE_MODEL))
        .when(F.size("_named") == 1, rx.first(head, P.PROVIDER_PARAM, 1))
        .when(F.size("_routes") == 1, route_text)
        .when(F.col("_marked").isNotNull(), rx.first(head, P.COOLDOWN_PROVIDER)),
        "provider_certainty": F.when(F.col("_referred").isNull() & (F.size("_routes") == 1), "derived")
        .when(any_source.isNotNull(), "explicit"),
        "provider_conflict": F.when(F.size("_named") > 1, F.col("_named")).when(F.size("_routes") > 1, F.col("_routes")),
    }]


@rx.once
def _model() -> rx.Steps:
    head, low = F.col(HEAD), F.col(LOW)
    said = low.contains("model")
    return [*fallback_split(), {
        "_params": F.array_distinct(F.concat(
            rx.every_if(said, head, P.MODEL_PARAM, 1), rx.every_if(said, head, P.MODEL_QUOTED, 1))),
        "_model_ref": rx.first_if(low.contains("reference model"), head, P.REFERENCE_MODEL, 2),
    }, {
        "_models": F.when(F.size("_params") > 0, F.col("_params")).otherwise(
            F.array_distinct(rx.every_if(rx.mentions(low, *MODEL_WORDS), head, P.MODEL_NAME, 1))),
    }, {
        "model": F.coalesce(F.col("_model_ref"), rx.only(F.col("_models"))),
        "model_conflict": F.when(F.size("_models") > 1, F.col("_models")),
    }]


@rx.once
def _fallback_route() -> rx.Steps:
    tail, body, low = F.col(TAIL), F.col("body"), F.col(LOW)
    explicit = r"(?i)\b{}=['\"]?([\w./:-]+)"

    def stated(key: str) -> Column:
        return rx.first_if(low.contains(key), body, explicit.format(key), 1)

    return [*fallback_split(), {
        "fallback_provider": F.coalesce(stated("fallback_provider"), rx.first_if(tail.isNotNull(), tail, P.PROVIDER_PARAM, 2)),
        "fallback_model": F.coalesce(stated("fallback_model"), F.when(tail.isNotNull(), F.coalesce(
            rx.first(tail, P.MODEL_PARAM, 1), rx.first(tail, P.MODEL_QUOTED, 1), rx.first(tail, P.MODEL_NAME, 1)))),
    }]


def add_provider(df: DataFrame) -> DataFrame:
    return rx.staged(df, _provider())


def add_model(df: DataFrame) -> DataFrame:
    return rx.staged(df, _model())


def add_fallback_route(df: DataFrame) -> DataFrame:
    return rx.staged(df, _fallback_route())


def platform(component: Column, body: Column, lowered: Column | None = None) -> Column:
    """First platform named by the component, a tag, or a phrase."""
    where = F.lower(F.coalesce(component, F.lit("")))
    low = _low(body, lowered)

    def named(name: str) -> Column:
        phrase = rf"(?i)\[{name}\]|\b{name}{P.PLATFORM_AFTER}|{P.PLATFORM_BEFORE}{name}\b"
        return where.contains(name) | (low.contains(name) & rx.has(body, phrase))

    return F.coalesce(*[F.when(named(name), F.lit(name)) for name in P.PLATFORMS])


def tool(body: Column, lowered: Column | None = None) -> Column:
    low = _low(body, lowered)
    return F.coalesce(
        F.when(low.contains("tool"), F.coalesce(rx.first(body, P.TOOL_NAMED, 1), rx.first(body, P.TOOL_KEYED, 1))),
        rx.first_if(low.contains("[deadline]"), body, P.TOOL_DEADLINE, 1))


@rx.once
def _tool_target() -> rx.Steps:
    """tool, target and database; later evidence for the target overrides weaker evidence."""
    body, low = F.col("body"), F.col(LOW)
    return [{
        "tool": tool(body, low),
        "database": rx.first_if(rx.mentions(low, ".db", ".sqlite"), body, P.DATABASE_FILE, 1),
        "mcp_server": rx.first_if(low.contains("mcp server"), body, P.MCP_SERVER, 1),
    }, {
        "target": F.coalesce(
            rx.first_if(low.contains("check_fn"), body, P.CHECK_FUNCTION, 1),
            F.concat(F.lit("mcp:"), F.col("mcp_server")),
            F.concat(F.lit("tool:"), F.col("tool")),
            rx.first_if(low.contains("host"), body, P.ENDPOINT, 1),
            F.col("database")),
    }]


def add_tool_target(df: DataFrame) -> DataFrame:
    return rx.staged(df, _tool_target())


def path_basename(body: Column, lowered: Column | None = None) -> Column:
    low = _low(body, lowered)
    return rx.first_if(rx.mentions(low, ".yaml", ".yml", ".json", ".md", ".py", ".txt"), body, P.FILE_BASENAME, 1)


@rx.once
def _exceptions() -> rx.Steps:
    body = F.col("body")
    named = rx.mentions(body, "Error", "Exception", "Timeout", "gaierror", "Forbidden", "NotFound", "BadRequest", "TimedOut")
    return [
        {"exceptions": F.array_distinct(rx.every_if(named, body, P.EXCEPTION, 1))},
        {"exception": F.when(F.size("exceptions") > 0, F.coalesce(
            rx.first_if(F.col(LOW).contains("error_type"), body, P.ERROR_TYPE, 1), F.element_at("exceptions", -1)))},
    ]


def add_exceptions(df: DataFrame) -> DataFrame:
    return rx.staged(df, _exceptions())


def is_predicted(body: Column) -> Column:
    """A warning about a future failure; its codes are not an observed failure."""
    return body.contains(P.PREDICTED)


@rx.once
def _http_status() -> rx.Steps:
    body, low = F.col("body"), F.col(LOW)
    # Both patterns need a three-digit status; few lines have one.
    numbered = body.rlike("[45][0-9][0-9]")
    found = F.array_distinct(rx.every(body, HTTP_EITHER, 0))  # in the order of the text
    found = F.array_distinct(F.transform(found, lambda m: F.regexp_extract(m, "[45][0-9][0-9]", 0)))
    return [
        {"_statuses": F.when(numbered, found).otherwise(F.array().cast("array<string>"))},
        {
            "http_status": F.when(~is_predicted(body), rx.integer(rx.only(F.col("_statuses")))),
            "http_conflict": F.when(F.size("_statuses") > 1, F.col("_statuses")),
        },
    ]


def http_text(body: Column) -> Column:
    """The first mention of an HTTP status."""
    return rx.first(body, HTTP_EITHER)


def exit_text(body: Column) -> Column:
    return rx.first(body, either(P.EXIT_LABELLED, P.EXIT_SYSTEMD, P.EXIT_PHRASED))


def exception_text(body: Column, name: Column) -> Column:
    return F.coalesce(rx.first_if(body.contains("error_type"), body, P.ERROR_TYPE), name)


def evidence_texts(body: Column, component: Column, low: Column) -> dict[str, Column]:
    """The piece of the record that each attribute was read from. ``low`` is the body in lower case."""
    falls = rx.mentions(low, "fallback", "falling back")
    head, tail = (F.when(falls, part).otherwise(rest) for part, rest in zip(fallback_columns(body), (body, F.lit(None).cast("string"))))
    stated = r"(?i)\b{}=['\"]?([\w./:-]+)"
    tool_text = F.when(low.contains("tool"), rx.first(body, either(P.TOOL_NAMED, P.TOOL_KEYED)))
    tool_text = F.coalesce(tool_text, rx.first_if(low.contains("[deadline]"), body, P.TOOL_DEADLINE))
    attempts = rx.first(body, either(P.ATTEMPT, P.POLL_ATTEMPT))
    where = F.coalesce(component, F.lit(""))
    return {
        "model": F.coalesce(rx.first_if(low.contains("reference model"), head, P.REFERENCE_MODEL),
                            rx.first_if(low.contains("model"), head, either(P.MODEL_PARAM, P.MODEL_QUOTED))),
        "fallback_provider": F.coalesce(rx.first(body, stated.format("fallback_provider")), rx.first(tail, P.PROVIDER_PARAM)),
        "fallback_model": F.coalesce(rx.first(body, stated.format("fallback_model")), rx.first(tail, either(P.MODEL_PARAM, P.MODEL_QUOTED))),
        "tool": tool_text, "database": rx.first(body, P.DATABASE_FILE), "path_basename": rx.first(body, P.FILE_BASENAME),
        "exception": rx.first_if(low.contains("error_type"), body, P.ERROR_TYPE), "http_status": http_text(body), "rpc_code": rx.first(body, P.RPC_CODE),
        "errno": rx.first(body, P.ERRNO), "exit_code": exit_text(body), "signal": rx.first(body, either(P.SIGNAL_NAME, P.SIGNAL_KILLED)),
        "attempt": attempts, "max_attempts": attempts,
        "stream_stage": F.coalesce(rx.first(body, P.STREAM_BEFORE), rx.first(body, P.STREAM_AFTER)),
        "platform": F.when(where != "", where).otherwise(F.substring(body, 1, 100)),
        "target": F.coalesce(rx.first_if(low.contains("check_fn"), body, P.CHECK_FUNCTION), rx.first_if(low.contains("mcp server"), body, P.MCP_SERVER), tool_text,
                             rx.first_if(low.contains("host"), body, P.ENDPOINT), rx.first_if(rx.mentions(low, ".db", ".sqlite"), body, P.DATABASE_FILE)),
    }


def add_http_status(df: DataFrame) -> DataFrame:
    return rx.staged(df, _http_status())


@rx.once
def _provider_codes() -> rx.Steps:
    body, low = F.col("body"), F.col(LOW)
    quoted = rx.every_if(rx.mentions(low, "code'", 'code"', "type'", 'type"'), body, P.CODE_QUOTED, 1)
    number = rx.every_if(low.contains("error code"), body, P.CODE_NUMBER, 1)
    literal = F.coalesce(*[F.when(body.contains(code), F.lit(code)) for code in P.LITERAL_CODES])
    telling = F.array_remove(F.array_remove("provider_codes", "error"), "message")
    return [
        {"provider_codes": F.array_union(quoted, number)},
        {"provider_code": F.when(~is_predicted(body), F.when(
            F.size("provider_codes") > 0, F.try_element_at(telling, F.lit(1))).otherwise(literal))},
    ]


def add_provider_codes(df: DataFrame) -> DataFrame:
    return rx.staged(df, _provider_codes())


def numeric_codes(body: Column, lowered: Column | None = None) -> dict[str, Column]:
    low = _low(body, lowered)
    tried = low.contains("attempt")
    polled = low.contains("polling conflict")
    exits = F.coalesce(rx.first(body, P.EXIT_LABELLED, 1), rx.first(body, P.EXIT_SYSTEMD, 1), rx.first(body, P.EXIT_PHRASED, 1))
    return {
        "rpc_code": rx.integer(rx.first_if(low.contains("-32"), body, P.RPC_CODE, 1)),
        "errno": rx.integer(rx.first_if(low.contains("errno"), body, P.ERRNO, 1)),
        "exit_code": rx.integer(F.when(low.contains("exit"), exits)),
        "attempt": rx.integer(F.coalesce(rx.first_if(tried, body, P.ATTEMPT, 1), rx.first_if(polled, body, P.POLL_ATTEMPT, 1))),
        "max_attempts": rx.integer(F.when(rx.has_if(tried, body, P.ATTEMPT), rx.first(body, P.ATTEMPT, 2))
                                   .otherwise(rx.first_if(polled, body, P.POLL_ATTEMPT, 2))),
    }


def signal(body: Column, lowered: Column | None = None) -> Column:
    low = _low(body, lowered)
    return F.coalesce(rx.first_if(low.contains("sig"), body, P.SIGNAL_NAME, 1),
                      rx.first_if(low.contains("code=killed"), body, P.SIGNAL_KILLED, 1))


def stream_stage(body: Column, lowered: Column | None = None) -> Column:
    said = _low(body, lowered).contains("streaming failed")
    return F.when(rx.has_if(said, body, P.STREAM_BEFORE), "before_delivery").when(
        rx.has_if(said, body, P.STREAM_AFTER), "after_delivery")


def is_system(profile: Column, text: Column, lowered: Column | None = None) -> Column:
    named = F.coalesce(profile.startswith("system:"), F.lit(False))
    return named | rx.has_if(rx.mentions(_low(text, lowered), *SYSTEM_WORDS), text, P.CLEAR_SYSTEM)


def scopes(has_server: Column, tool_name: Column, platform_name: Column, provider: Column,
           component: Column, body: Column, low: Column, system: Column) -> Column:
    """Which families of rules may fire: tool, platform, llm."""
    where = F.coalesce(component, F.lit(""))

    def under(prefixes: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [where.startswith(p) for p in prefixes])

    on_platform = rx.has_if(rx.mentions(low, "discord", "telegram", "api_server"), body, P.PLATFORM_SCOPE_TEXT)
    on_llm = rx.has_if(rx.mentions(low, "api call", "streaming failed", "codex stream", "geminiapi"), body, P.LLM_SCOPE_TEXT)
    return rx.listed(
        F.when(tool_name.isNotNull() | has_server | where.startswith("tools.") | (where == "agent.tool_executor"), F.lit("tool")),
        F.when(platform_name.isNotNull() | under(P.PLATFORM_COMPONENTS) | on_platform, F.lit("platform")),
        F.when(~system & (provider.isNotNull() | under(P.LLM_COMPONENTS) | on_llm), F.lit("llm")),
    )


def is_tuning(body: Column) -> Column:
    return rx.has_if(body.rlike("(?i)openai-codex"), body, P.TUNING)


def is_observation(body: Column, lowered: Column | None = None) -> Column:
    """The line reports success or telemetry; error words inside it are only quoted."""
    low = _low(body, lowered)
    told = rx.mentions(low, "api call #", "turn ended", "shell hook", "completed", "web search via", "[memory]", "registered /")
    return rx.has_if(low.contains("openai-codex"), body, P.TUNING) | rx.has_if(told, body, P.OBSERVATION)


def function_slot(tool_name: Column, operation: Column, component: Column) -> Column:
    """Which configurable slot of the application a record belongs to."""
    where = F.coalesce(component, F.lit(""))
    exact = F.create_map(*[F.lit(v) for pair in P.FUNCTION_SLOTS for v in pair])
    nested = F.coalesce(*[F.when(where.startswith(p + "."), F.lit(slot)) for p, slot in P.FUNCTION_SLOTS])
    return (
        F.when((tool_name == "delegate_task") | operation.isin("subagent_delegate", "delegation"), "delegation")
        .when(operation == "fallback", "fallback")
        .when(operation.isin("title_generation", "title"), "title")
        .when(operation.isin("aux", "auxiliary"), "aux")
        .otherwise(F.coalesce(
            F.try_element_at(exact, where), nested,
            F.when(where.startswith("gateway."), "gateway"),
            F.nullif(operation, F.lit("")),
            F.when(where.startswith("agent."), F.substr(where, F.lit(7))),
            F.nullif(where, F.lit("")), F.lit("unknown")))
    )


@rx.once
def _flat() -> rx.Steps:
    body, low = F.col("body"), F.col(LOW)
    return [{
        "platform": platform(F.col("component"), body, low),
        "path_basename": path_basename(body, low),
        **numeric_codes(body, low),
        "signal": signal(body, low),
        "stream_stage": stream_stage(body, low),
        "is_system": is_system(F.col("profile"), F.col("text"), F.col("text_lower")),
        "is_observation": is_observation(body, low),
        "is_continuation": F.col("log_level").isNull() & (rx.has(F.col("text"), P.FRAME) | rx.has(F.col("text"), P.CODE_LINE)),
    }]


@rx.once
def _scopes() -> rx.Steps:
    return [{"scopes": scopes(
        F.col("mcp_server").isNotNull(), F.col("tool"), F.col("platform"), F.col("provider"),
        F.col("component"), F.col("body"), F.col(LOW), F.col("is_system"))}]


def add_attributes(df: DataFrame) -> DataFrame:
    staged = rx.aside(rx.staged(df, _flat()), ("body", LOW), lambda rows: rx.staged(
        rows, _provider(), _model(), _fallback_route(), _tool_target(), _exceptions(), _http_status(), _provider_codes()))
    return rx.staged(staged, _scopes())
