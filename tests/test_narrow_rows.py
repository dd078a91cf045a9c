"""Columns that a step does not read wait in one struct, and texts are searched once for the words of both rule banks."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import identity as I
from tracewell.functions import regex as rx
from tracewell.functions import text as T
from tracewell.operators import coverage
from tracewell.plans import enrich, rules

TEXTS = [
    None, "", "plain", "2024-01-02 03:04:05 ERROR agent.core: Attempt 3 of 5 in [cron_a_b_20240101_000001]  x", "ERROR a.b: ATTEMPT 2/3\tat 2024-01-02 03:04:05Z",
    "Subsequent auxiliary calls will skip it until 01:02:03", 'File "a/b.py", line 3 in /srv/x', 'C:File "q", line 3\\dir\\f.txt', "C:\\dir\\f.txt and /var/log/x.log", "[cron_]",
]


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_banks_copy_few_columns_and_search_each_text_once(spark):
    rows = spark.createDataFrame([("ERROR agent.core: x", "h", "p")], "text string, host string, profile string")
    plan = list(_nodes(enrich.enrich(rows)._jdf.queryExecution().optimizedPlan()))
    hits = [n for n in plan if any(n.output().apply(i).name() in ("_cause_hits", "_event_hits") for i in range(n.output().size()))]
    assert hits and max(n.output().size() for n in hits) < 20
    templates = [n for n in plan if any(n.output().apply(i).name() == "normalized_text" for i in range(n.output().size()))]
    assert templates and max(n.output().size() for n in templates) < 12
    assert sum(n.simpleString(10_000_000).count("regexp_extract_all(body_lower#") for n in plan) == 1


def test_aside_keeps_what_waits_and_replaces_what_the_step_makes(spark):
    rows = spark.createDataFrame([(1, "old", "x", None)], "a int, Made string, `odd.name` string, n string")
    out = rx.aside(rows, ("a",), lambda df: df.withColumn("made", F.col("a") + 1))
    assert sorted(out.columns) == ["a", "made", "n", "odd.name"]
    assert out.select("a", "made", "`odd.name`", "n").first() == (1, 2, "x", None)
    assert rx.aside(rows, rows.columns, lambda df: df).columns == rows.columns


def test_words_found_together_name_the_same_parts(spark):
    book = rules.load()
    every = sorted({*rules._words(book["causes"]), *rules._words(book["events"])})
    texts = [r["example"].lower() for r in book["causes"] + book["events"]] + ["", "plain"]
    rows = spark.createDataFrame([(t,) for t in texts], "body_lower string")
    for bank in (book["causes"], book["events"]):
        alone = rules._named_parts(bank, "body_lower")
        both = rules._found_parts(bank, rules.find_words(every, "body_lower"), every)
        # more parts may be named, never fewer
        assert rows.select(alone.alias("a"), both.alias("b")).where("a & b <> a").count() == 0


def test_coverage_identity_equals_all_steps_on_every_text(spark):
    c = F.col
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, text string").withColumns(
        {n: F.lit(n) for n in ("host", "profile", "provider", "model", "target", "severity", "impact")})
    found = coverage.identity(c("host"), c("profile"), c("provider"), c("model"), c("target"), c("text"), c("severity"), c("impact"))
    bare = F.regexp_replace("text", P.FRAME_REFERENCE, "")
    paths = F.array_sort(F.array_distinct(F.concat(rx.every(bare, P.POSIX_PATH, 2), rx.every(bare, P.WINDOWS_PATH))))
    jobs = F.array_sort(rx.distinct(c("text"), P.SCHEDULED_RUN, 1))
    scope = I.digest(T.canonical_host(c("host")), c("profile"), c("provider"), c("model"), c("target"), I.packed_list(paths), I.packed_list(jobs))
    plain = F.trim(T._replace_all(c("text"), [
        (P.LEADING_STAMP, ""), (P.SCHEDULED_RUN, "[$1_<RUN>]"), (P.COOLDOWN_EXPIRY, "$1<TIME>"), (P.ISO_ANYWHERE, "<TIMESTAMP>"), (P.ATTEMPT_COUNT, "attempt <N>"),
        (P.FRAME_REFERENCE, 'File "<FRAME>", line'), (P.IDENTITY_PREFIX, ""), (r"\s+", " ")]))
    told = rows.select("k", found["covered_text"].alias("t"), plain.alias("t0"), found["scope_key"].alias("s"), scope.alias("s0"))
    assert [r for r in told.collect() if r.t != r.t0 or r.s != r.s0] == []
