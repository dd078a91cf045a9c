"""Brute-force checks of the chunked and block-wise algorithms, with hot keys, and plan checks."""
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import ledger
from tracewell.operators import feed, groups as G, packing as K, scan
from tracewell.sinks import stores
from tracewell.sources import files as S


def greedy(sizes, max_items, max_bytes):
    index, items, used, out = 0, 0, 0, []
    for size in sizes:
        if not items or items + 1 > max_items or used + size > max_bytes:
            index, items, used = index + 1, 0, 0
        items, used = items + 1, used + size
        out.append(index)
    return out


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 16), (3, 1000)])
def test_pack_equals_greedy(spark, seed, block):
    rng = random.Random(seed)
    # One key holds most rows; some items exceed the byte limit on their own.
    rows = [(k, p + 1, rng.choice([5, 20, 60, 130])) for k, n in (("hot", 300), ("b", 40), ("c", 1)) for p in range(n)]
    df = spark.createDataFrame(rows, "k string, position long, size long")
    got = {(r.k, r.position): r.batch_index for r in K.pack(df, "size", ["k"], 7, 100, block).collect()}
    for key in ("hot", "b", "c"):
        mine = [r for r in rows if r[0] == key]
        assert [got[(key, r[1])] for r in mine] == greedy([r[2] for r in mine], 7, 100)


def test_global_position_equals_sort(spark):
    rng = random.Random(5)
    values = [rng.randint(0, 50) for _ in range(2000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
    got = [(r.v, r.i) for r in scan.global_position(df, [F.col("v").asc(), F.col("i").desc()], partitions=8).orderBy("position").collect()]
    assert got == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0], -x[1]))


def test_running_min_looks_forward(spark):
    rows = [("a", i, None if i % 3 else (i * 7) % 31) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, at long, v int")
    got = {r.at: r.m for r in scan.running_min(df, ["k"], "at", F.col("v"), "m", 10).collect()}
    for _, at, _ in rows:
        later = [v for _, a, v in rows if a >= at and v is not None]
        assert got[at] == (min(later) if later else None)


def test_batch_order_of_groups(spark):
    rows = [("watch-old", "watch", "2026-09-12 10:00:00", 1), ("crit", "needs-attention", "2026-09-12 09:30:00", 1), ("watch-new", "watch", "2026-09-12 11:00:00", 1),
            ("ignore", "ignore", "2026-09-12 11:00:00", 9), ("watch-often", "watch", "2026-09-12 11:00:00", 5)]
    df = spark.createDataFrame(rows, "fingerprint string, severity string, last_at string, n long")
    assert [r.fingerprint for r in K.order_groups(df).orderBy("position").collect()] == ["crit", "watch-often", "watch-new", "watch-old", "ignore"]


def test_feed_tail_never_exceeds_its_budget(spark):
    df = spark.createDataFrame([("2026-09-16 10:00:00", "old" * 100), ("2026-09-16 10:01:00", "new")], "ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    def tail(size):
        return [r.text for r in feed.feed_tail(df, ["ts"], F.octet_length("text"), minutes=None, max_bytes=size).collect()]
    assert tail(1) == [] and tail(4) == ["new"] and len(tail(1000)) == 2


def test_bucket_replay_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(f"r{i}", "2026-09-12 %02d:30:00" % (i % 24)) for i in range(48)], "record_id string, at string").select(
        "record_id", F.col("at").cast("timestamp").alias("event_at"))
    path = str(tmp_path / "store")
    stores.write_buckets(df.limit(20), path)
    stores.write_buckets(df, path)
    stores.write_buckets(df.filter("record_id < 'r3'"), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 48 and rows.select("record_id").distinct().count() == 48
    assert {str(r.bucket_half).zfill(2) for r in rows.select("bucket_half").distinct().collect()} == {"00", "12"}


def test_raw_logs_and_guard(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "profiles" / "blue" / "logs").mkdir(parents=True)
    (tmp_path / "logs" / "agent.log").write_text("one\ntwo\n\n")
    (tmp_path / "logs" / "agentX.log").write_text("not a known kind\n")
    (tmp_path / "profiles" / "blue" / "logs" / "errors.log.1").write_text("three\r\n")
    got = {(r.text, r.profile, r.kind) for r in S.read_raw_logs(spark, str(tmp_path)).collect()}
    assert got == {("one", "default", "agent.log"), ("two", "default", "agent.log"), ("three", "blue", "errors.log")}
    (tmp_path / "events.jsonl").write_bytes('{"text": "é1", "keep_me": 1}\n\n[1]\n{"text": "unfinished"'.encode())
    rows = S.read_events(spark, [f"{tmp_path}/*.jsonl", f"{tmp_path}/events*"], positions=True).orderBy("byte_start").collect()
    assert [(r.byte_start, r.byte_end, r.text, r.is_object) for r in rows] == [(0, 30, "é1", True), (31, 35, None, False)]
    assert "keep_me" in rows[0].raw
    rows = spark.createDataFrame([("a", '{"x": 1}'), ("b", '{"x": 1}'), ("b", "[1]"), ("c", "{bad")], "path string, row string")
    clean, rejects = S.guard(rows, "path", "row")
    assert [r.path for r in clean.collect()] == ["a"] and {(r.path, r.reject_reason) for r in rejects.collect()} == {("b", "not an object"), ("c", "malformed")}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_enrichment_is_narrow_and_built_in(spark):
    from tracewell.plans import enrich
    df = spark.range(10).select(F.lit("ERROR a: b").alias("text"), F.lit("h").alias("host"), F.lit("p").alias("profile"))
    text = plan(enrich.enrich(df))
    assert "Exchange" not in text and "Python" not in text


def test_groups_aggregate_before_the_shuffle(spark):
    rows = spark.createDataFrame([], "fingerprint string, n long, first_at timestamp, last_at timestamp, first_id long, last_id long, "
                                     "sample struct<a:string>, latest struct<b:string>, source_files array<string>")
    assert "partial_sum" in plan(G.merge(rows)) and "Window" not in plan(G.merge(rows))


def test_first_rows_per_host_are_cut_before_the_shuffle(spark):
    from tracewell.operators import alarms
    names = "host string, ts string, line_id long, profile string, text string, source_path string, byte_start long, byte_end long, " \
            "event string, cause string, tool string, operation string, component string, provider string, model string"
    assert "WindowGroupLimit" in plan(alarms.format_alarm(spark.createDataFrame([], names), ["ts", "line_id"]))


def test_evidence_is_reduced_before_it_is_joined(spark):
    from tracewell.operators import coverage as C, ledger as O, serious as Z
    evidence = spark.createDataFrame([], "gid string, ts long, id string, signature string, scope_key string, concrete boolean, impact string, "
                                         "text string, profile string, event string, severity string, record_role string")
    findings = spark.createDataFrame([], "id string, decision string")
    coverage = spark.createDataFrame([], "finding_id string, history_id long, completed_at long, signature string, reopened_at long, scope_key string, concrete boolean, impact string")

    def joins_below_the_aggregate(df):
        """True when some partial max_by or min_by of evidence has a join underneath."""
        lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
        for i, line in enumerate(lines):
            if "Aggregate" in line and ("max_by" in line or "min_by" in line):
                below = [lines[j] for j in range(i + 1, len(lines)) if all(depth[k] > depth[i] for k in range(i + 1, j + 1))]
                if any(" Join " in f" {x.strip(' :+-')} " for x in below):
                    return True
        return False

    few = findings.select(F.col("id").alias("gid"))
    assert joins_below_the_aggregate(evidence.join(few, "gid", "left_semi").groupBy("gid").agg(F.max_by("text", "ts")))
    assert not joins_below_the_aggregate(O.latest(evidence).join(few, "gid", "left_semi"))
    current = C.basis(evidence, findings, coverage)
    done = C.covered(current, coverage)
    for later in (done, C.uncertain(current, findings, coverage, done), C.busy(findings.select("id"), current)):
        assert "gid" not in plan(later)  # evidence is read once, for the basis
    assert not joins_below_the_aggregate(O.promote(findings, evidence))
    assert not joins_below_the_aggregate(Z.serious_per_finding(Z.serious(evidence)).join(few, "gid", "left_anti"))


def test_budget_prefix_counts_empty_items_and_refuses_an_oversize_first(spark):
    def fit(sizes, budget):
        df = spark.createDataFrame(list(enumerate(sizes)), "i int, size int")
        return [r.i for r in K.fit_prefix(df, [F.col("i")], F.col("size"), budget).orderBy("i").collect()]
    assert fit([0, 0, 5], 5) == [0, 1, 2]
    assert fit([0] * 40 + [3, 3], 5) == list(range(41))
    assert fit([], 5) == []
    with pytest.raises(Exception, match="first item exceeds the budget"):
        fit([9, 1], 5)


def test_feed_tail_counts_rows_without_bytes(spark):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), "id")
    assert feed.feed_tail(df, ["ts", "id"], F.lit(0), minutes=None, max_bytes=90).count() == 90


def test_recent_feed_is_filtered_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "feed")
    spark.range(10).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), "id").write.parquet(path)
    stored = spark.read.parquet(path)
    recent = stored.filter(F.col("ts") >= F.lit("1970-01-01 08:00:00").cast("timestamp"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in recent._jdf.queryExecution().toString()
    assert [r.id for r in feed.feed_tail(stored, ["ts"], F.lit(1), minutes=60).orderBy("ts").collect()] == [8, 9]


def test_late_evidence_reopens(spark):
    findings = spark.createDataFrame([("a", "watch", 1000, False, False), ("b", "watch", 1000, True, False), ("c", "watch", 9000, False, False)],
                                     "id string, decision string, reviewed_at long, lane_a_done boolean, lane_b_done boolean")
    fresh = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "gid string, ts long")  # events long before the review
    out = {r.id: r.reopened for r in ledger.reopen(findings, fresh, F.lit(10_000)).collect()}
    assert out == {"a": True, "b": False, "c": False}


def test_second_tracked_sighting_decides(spark):
    evidence = spark.createDataFrame([], "id string, gid string, ts long, severity string, record_role string")
    findings = spark.createDataFrame([("old", 1, None)], "id string, seq long, decision string")
    rows = spark.createDataFrame([("1", "new", 1, "tracked", "parent"), ("2", "new", 2, "tracked", "parent"), ("3", "once", 1, "tracked", "parent"),
                                  ("4", "old", 1, "tracked", "parent"), ("5", "quiet", 1, "tracked", "continuation"), ("6", "quiet", 2, "tracked", "parent")], evidence.schema)
    out = {r.id: (r.decision, r.investigated) for r in ledger.ingest(evidence, findings, rows)[1].collect()}
    assert out == {"new": ("tracked", True), "once": (None, False), "old": ("tracked", True), "quiet": ("ignore", False)}
