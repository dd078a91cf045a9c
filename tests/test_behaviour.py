"""Behaviour on single records: what must and must not be told apart."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import alarms, lines as L
from tracewell.plans import enrich, policy, rules


@pytest.fixture(scope="module")
def classify(spark):
    def run(*records):
        rows = [(i, r["text"], r.get("host", "alpha"), r.get("profile", "blue")) for i, r in enumerate(records)]
        df = spark.createDataFrame(rows, "id int, text string, host string, profile string")
        return [r.asDict(recursive=True) for r in enrich.enrich(df, policy.load()).orderBy("id").collect()]
    return run


def one(classify, text, **kw):
    return classify({"text": text, **kw})[0]["classification"]


def test_tuning_notes_are_observations(classify):
    c = one(classify, "2031-03-05 07:08:09 INFO svc.stream: openai-codex watchdog for large request: TTFB relaxed, Disabling openai-codex no-byte TTFB watchdog")
    assert (c["provider"], c["kind"], c["cause"]) == ("openai-codex", "observation", "watchdog_tuning")


def test_a_stalled_stream_has_its_stage(classify):
    c = one(classify, "2031-03-05 07:08:09 ERROR agent.conversation_loop: Streaming failed before delivery, as the reply of job 7 produced no SSE events")
    assert (c["event"], c["cause"], c["stream_stage"]) == ("api.stream_stalled", "stream_stalled", "before_delivery")


def test_a_used_up_allowance_names_provider_model_and_status(classify):
    c = one(classify, "2031-03-05 07:08:09 ERROR svc.loop: usage_limit_reached, HTTP 429 from provider=openai-codex model=gpt-4.1-mini, giving up")
    assert (c["event"], c["cause"], c["provider"], c["model"], c["http_status"]) == ("api.quota_exhausted", "usage_quota_exhausted", "openai-codex", "gpt-4.1-mini", 429)


def test_unavailable_is_not_too_many(classify):
    c = one(classify, "2031-03-05 07:08:09 ERROR gateway.platforms.discord: hello packet answered with 503 Service Unavailable")
    assert (c["cause"], c["http_status"], c["platform"]) == ("service_unavailable", 503, "discord")


@pytest.mark.parametrize("level,words", [("INFO", "a critical error path was fatal in the drill"), ("ERROR", "INFO pages are served again")])
def test_the_level_is_the_prefix(classify, level, words):
    assert one(classify, f"2031-03-05 07:08:09 {level} svc.drill: {words}")["log_level"] == level


def test_a_frame_continues_a_record(classify):
    c = one(classify, '  File "/opt/bakery/oven.py", line 12, in heat')
    assert (c["kind"], c["event"]) == ("continuation", "runtime.traceback_continuation")


def test_tools_have_targets_and_codes(classify):
    a = one(classify, "ERROR svc.tools: Tool plumber returned error (127): sh: valve: command not found")
    assert (a["target"], a["cause"], a["event"]) == ("tool:plumber", "command_not_found", "tool.execution_failed")
    b = one(classify, "ERROR svc.tools: Tool reader returned error: [Errno 2] No such file or directory: 'menu.txt'")
    assert (b["target"], b["cause"], b["errno"]) == ("tool:reader", "file_not_found", 2)


def test_memory_pressure_on_a_system_profile(classify):
    c = one(classify, "brewd invoked oom-killer: order=3", profile="system:brewd")
    assert (c["event"], c["cause"], c["domain"]) == ("system.oom_invoked", "memory_exhausted", "system")


def test_one_line_may_name_handles_tokens_or_loops(classify):
    assert one(classify, "2031-03-05 07:08:09 WARNING svc.state: found 31 live SessionDB handles on shutdown")["cause"] == "handle_leak"
    assert one(classify, "2031-03-05 07:08:09 ERROR svc.auth: could not mint token for the bakery")["event"] == "api.auth_token_mint_failed"
    assert one(classify, "2031-03-05 07:08:09 CRITICAL svc.pulse: the event loop missed 9 consecutive liveness probes")["event"] == "runtime.event_loop_stalled"


def test_a_cooldown_for_money_is_not_exhausted_credit(classify):
    text = "WARNING svc.aux: Auxiliary: marking groq unhealthy for 30s (payment / credit error)."
    a, b = one(classify, text), one(classify, text + " It said RESOURCE_EXHAUSTED")
    assert a["event"] == "api.provider_cooldown" and "credit_balance_exhausted" not in a["causes"]
    assert "resource_exhausted" in b["causes"] and "credit_balance_exhausted" not in b["causes"]


def test_a_refusal_needs_its_policy(classify):
    a = one(classify, "ERROR svc.tools: Tool baker returned error: refusing to write a broken recipe")
    assert "curator_policy_refusal" not in a["causes"] and a["event"] == "tool.execution_failed"
    b = one(classify, "ERROR svc.tools: Tool baker returned error: the curator is refusing this recipe")
    assert "curator_policy_refusal" in b["causes"] and b["event"] == "tool.execution_blocked"


@pytest.mark.parametrize("family", ["causes", "events", "system"])
def test_every_rule_fires_on_its_example(classify, family):
    catalogue = rules.load()[family]
    prefix = {"causes": "cause.", "events": "event.", "system": ""}[family]
    found = classify(*[{"text": r["example"], "profile": "system:x" if family == "system" else "blue"} for r in catalogue])
    missed = [r["id"] for r, row in zip(catalogue, found)
              if not any(m.startswith(f"{prefix}{r['id']}=") for m in row["classification"]["matched_rules"])]
    assert missed == []


def keys(classify, *records):
    return [r["fingerprint"]["key"] for r in classify(*records)]


def test_fingerprints_keep_host_profile_model_and_resource_apart(classify):
    text = "ERROR svc.api: provider=openai-codex model=gpt-4.1-mini gave up after 3.5s"
    base, host, profile, duration, model = keys(
        classify, {"text": text}, {"text": text, "host": "other"}, {"text": text, "profile": "green"},
        {"text": text.replace("3.5s", "71.2s")}, {"text": text.replace("-mini", "-nano")})
    assert base == duration and len({base, host, profile, model}) == 4
    one_db, two_db = keys(classify, *[{"text": f"2031-03-05 07:08:09 ERROR svc.shelf: disk I/O error in /data/{x}/bread.db"} for x in ("rye", "oat")])
    assert one_db != two_db


def test_scheduled_runs_and_cooldowns_collapse(classify):
    run = "WARNING [cron_ovenheat_20310305_070809] svc.tools: Tool baker returned error (1.5s): too cold"
    a, b, other = keys(classify, {"text": run}, {"text": run.replace("20310305_070809", "20310306_101112").replace("1.5s", "2.5s")},
                       {"text": run.replace("ovenheat", "ovencool")})
    assert a == b != other
    cool = "WARNING svc.aux: Auxiliary: marking groq unhealthy for 30s. Subsequent auxiliary calls will skip it until 11:12:13."
    a, b, other = keys(classify, {"text": cool}, {"text": cool.replace("11:12:13", "14:15:16")}, {"text": cool.replace("groq", "mistral")})
    assert a == b != other


def test_policy_checks_and_first_match():
    with pytest.raises(ValueError):
        policy.validate([])
    with pytest.raises(ValueError):
        policy.validate({"rules": [], "default": "tracked"})


def test_policy_conditions_are_anded(spark):
    df = spark.createDataFrame([("ERROR", "timeout", ["timeout"]), ("INFO", "timeout", ["timeout"])], "log_level string, cause string, causes array<string>")
    rule = {"version": "v", "default": "watch", "rules": [{"when": {"log_level": ["ERROR"], "causes_any": ["timeout"]}, "label": "needs-attention"}]}
    got = [(r.severity.label, r.severity.rule_id) for r in policy.apply_severity(df, rule).collect()]
    assert got == [("needs-attention", "rule-0"), ("watch", "default")]


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first().v


@pytest.mark.parametrize("text,zone,expected,status", [
    ("2031-03-05 07:08:09 WARNING oven cold", "Asia/Dubai", "2031-03-05T07:08:09+04:00", "ok"),
    ("2031-03-05T07:08:09,125+01:00 dough", "Asia/Dubai", "2031-03-05T10:08:09+04:00", "ok"),
    ("2031-03-05 07:08:09.75-03:00 dough", "Asia/Dubai", "2031-03-05T14:08:09+04:00", "ok"),
    ("2031-03-05 07:08:09Z dough", "UTC", "2031-03-05T07:08:09Z", "ok"),
    ("dough without a stamp", "UTC", None, "missing"),
    ("", "UTC", None, "missing"),
    ("2031-02-30 07:08:09 no such day", "UTC", None, "malformed"),
    ("2031-03-05 07:61:09 no such minute", "UTC", None, "malformed"),
    ('  File "oven.py", line 9', "UTC", None, "missing"),
])
def test_leading_timestamps(spark, text, zone, expected, status):
    instant = T.leading_ts(F.col("text"), zone)
    assert value(spark, T.canonical_text(instant, zone), text) == expected
    assert value(spark, T.leading_status(F.col("text"), instant), text) == status


def test_freshness_is_inclusive(spark):
    now = F.lit("2031-03-05 12:00:00").cast("timestamp")
    fresh = T.is_fresh(T.parse_instant(F.col("text")), now)
    got = [value(spark, fresh, t) for t in ("2031-03-02T12:00:00Z", "2031-03-02T11:59:59Z", "2031-03-04T14:00:00+02:00", "half past nine")]
    assert got == [True, False, True, False]


def kept(spark, name, texts, chunk):
    rows = [(name, f"/x/{name}", i * 100, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "source_name string, source_path string, byte_start long, text string")
    return [r.keep for r in L.keep_lines(df, chunk).orderBy("byte_start").collect()]


@pytest.mark.parametrize("chunk", [100, 300, 1 << 20])  # the result must not depend on chunk borders
def test_level_context(spark, chunk):
    trace = ["2031-03-05 07:08:09 ERROR svc.oven: smoke", "Traceback (most recent call last):", '  File "/opt/bakery/oven.py", line 4, in bake',
             "    heat(dough)", "TypeError: dough is raw", "2031-03-05 07:08:11 INFO svc.oven: aired", "window was opened"]
    assert kept(spark, "agent.log", trace, chunk) == [True] * 5 + [False, False]
    assert kept(spark, "errors.log.2031-03-04", ["INFO crumbs", "", "flour"], chunk) == [True, False, True]
    assert kept(spark, "gateway.log.2", ["INFO svc: open", "ERROR svc: shut"], chunk) == [False, True]
    assert kept(spark, "agent.log", ["2031-03-05 07:08:09 ERROR svc.oven: smoke", "alarm was heard", "INFO svc: quiet"], chunk) == [True, True, False]


@pytest.mark.parametrize("chunk", [150, 1 << 20])
def test_fold_caps_long_records(spark, chunk):
    texts = ["2031-03-05 07:08:09 ERROR svc: smoke"] + ["  " + str(i) + "x" * 60 for i in range(300)]
    rows, at = [], 0
    for i, t in enumerate(texts):
        rows.append((i, "errors.log", "/x/errors.log", at, at + len(t) + 1, t))
        at += len(t) + 1
    df = spark.createDataFrame(rows, "line_id long, source_name string, source_path string, byte_start long, byte_end long, text string")
    now = F.lit("2031-03-05 08:00:00").cast("timestamp")
    out = L.fold(L.stage_lines(L.keep_lines(df, chunk), now, chunk_bytes=chunk), chunk_bytes=chunk).collect()
    assert len(out) == 1
    assert out[0].text == "\n".join(texts)[:8000] and out[0].text_truncated
    assert (out[0].byte_start, out[0].byte_end, out[0].original_text_bytes, out[0].children) == (0, at, at, 300)


def test_incremental_mode_keeps_untimestamped_heads(spark):
    rows = [(0, "errors.log", "/x/errors.log", 0, 10, "clock was stopped"), (1, "errors.log", "/x/errors.log", 10, 20, "2019-05-05 05:05:05 ERROR svc: stale")]
    df = spark.createDataFrame(rows, "line_id long, source_name string, source_path string, byte_start long, byte_end long, text string")
    now = F.lit("2031-03-05 08:00:00").cast("timestamp")
    got = L.stage_lines(L.keep_lines(df), now, initial=False).orderBy("line_id").collect()
    assert [(r.role, r.timestamp_basis, r.dropped) for r in got] == [("standalone", "new_append", None), (None, None, "old")]
    assert got[0].event_ts == dt.datetime(2031, 3, 5, 8)


def test_escalation_words(spark):
    df = spark.createDataFrame([("Escalate: yes, oven", 0), ("all calm, escalate: no", 2), ("bread is ready", 1), ("bread is ready", 0)], "text string, n int")
    assert [r.v for r in df.select(alarms.parse_escalate(F.col("text"), F.col("n")).alias("v")).collect()] == [True, False, True, False]


def test_originals_survive_enrichment(spark):
    df = spark.createDataFrame([("INFO svc.oven: warm", "mine", json.dumps({"keep": True}))], "text string, severity string, custom string")
    row = enrich.enrich(df, policy.load()).first().asDict(recursive=True)
    assert row["severity"] == "mine" and json.loads(row["custom"]) == {"keep": True}
    assert row["generated"]["severity"]["label"] == "watch" and row["classification"]["log_level"] == "INFO"
