"""The ledger's identities and joins against plain loops, with a signature that most findings share."""
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import coverage as C, evidence as EV, ledger as O, scan, serious as Z

FINDINGS = "id string, decision string, lane_a_done boolean, lane_b_done boolean, reviewed_at long"


def enriched(spark, rows):
    """rows: id, text, event_at and what else differs."""
    out = [(r["id"], "h", "p", r["text"], r.get("at", "2026-09-12 10:00:00"), r.get("known"), r.get("inode"), r.get("event"), r.get("label", "watch")) for r in rows]
    df = spark.createDataFrame(out, "record_id string, host string, profile string, text string, at string, known_key string, inode long, event string, label string")
    no = F.lit(None).cast("string")
    return df.select(
        "record_id", "host", "profile", "text", F.col("at").cast("timestamp").alias("event_at"), "known_key",
        F.when(F.col("inode").isNotNull(), F.struct("inode", F.lit(1).alias("dev"), F.lit("h").alias("content_hash"))).alias("source_identity"),
        F.struct(F.lit("/x/a.log").alias("source_path"), F.lit(0).cast("long").alias("byte_start"), F.lit(9).cast("long").alias("byte_end")).alias("provenance"),
        F.struct("event", *[no.alias(n) for n in ("cause", "provider", "model", "component", "tool", "operation", "target")]).alias("classification"),
        F.struct("label").alias("severity"), F.struct(F.sha2(F.regexp_replace("text", "[0-9]", ""), 256).alias("key")).alias("fingerprint"))


def test_evidence_identities(spark):
    run = "WARNING [cron_nightly_20260912_215040] worker: sync failed"
    rows = [{"id": "1", "text": run}, {"id": "2", "text": run.replace("215040", "215041")}, {"id": "3", "text": run, "known": "old"}, {"id": "4", "text": "plain failure"},
            {"id": "4", "text": "plain failure"}, {"id": "4", "text": "plain failure", "inode": 5}, {"id": "4", "text": "plain failure", "inode": 6}, {"id": "5", "text": "plain failure", "label": "ignore"}]
    got = EV.evidence_rows(enriched(spark, rows), keep=("record_id",)).collect()
    assert len({r.id for r in got}) == 7  # the repeated row is the same evidence, a replaced file is other evidence
    one, two, three = (next(r for r in got if r.record_id == x) for x in "123")
    assert one.gid == two.gid != three.gid and one.canonical_key == two.canonical_key == three.canonical_key
    assert one.signature == two.signature and one.concrete and one.scope_key == two.scope_key
    assert {r.canonical_key for r in got if r.record_id in "45"} == {None}
    assert len({r.gid for r in got if r.record_id == "4"}) == 1 != len({r.gid for r in got if r.record_id in "45"})
    with pytest.raises(Exception, match="lacks its time"):
        EV.evidence_rows(enriched(spark, [{"id": "1", "text": "x", "at": None}])).collect()


def test_recurring_records_attach(spark):
    key = lambda n: f"{n:064d}"
    findings = spark.createDataFrame([
        ("a", "watch", False, False, 5, key(1)), ("b", "watch", True, False, 1, key(1)), ("c", None, False, False, None, key(2)), ("d", "rca", True, True, 9, key(2)),
        ("e", "tracked", False, False, 7, key(3)), ("f", "tracked", False, False, 8, key(3))], FINDINGS + ", canonical_key string")
    new = [("r1", "own1", key(1)), ("r2", "own2", key(2)), ("r3", "own3", key(3)), ("r4", "own4", key(4)), ("r5", "own5", None)] + [(f"h{i}", "own", key(1)) for i in range(500)]
    out = {r.id: r.gid for r in O.alias(spark.createDataFrame(new, "id string, gid string, canonical_key string"), findings).collect()}
    assert {k: v for k, v in out.items() if k[0] == "r"} == {"r1": "b", "r2": "own2", "r3": "f", "r4": key(4)[:20], "r5": "own5"}
    assert {out[f"h{i}"] for i in range(500)} == {"b"}


def test_only_recurring_newest_evidence_gives_a_key(spark):
    evidence = spark.createDataFrame([("1", "a", 1, None), ("2", "a", 2, "k"), ("3", "b", 1, "k"), ("4", "b", 2, None), ("5", "c", 1, "k")], "id string, gid string, ts long, canonical_key string")
    findings = spark.createDataFrame([(x, None, False, False, None) for x in "abz"], FINDINGS)
    assert [(r.id, r.canonical_key) for r in EV.canonical_findings(evidence, findings).collect()] == [("a", "k")]


def loop_covered(current, coverage):
    cut = {}
    for f, h, _, _, reopened in coverage:
        if reopened is not None:
            cut[f] = max(cut.get(f, -1), h)
    out = {}
    for i, sig in current:
        found = [(at, h) for _, h, at, s, reopened in coverage if reopened is None and s == sig and h > cut.get(i, -1)]
        if found:
            out[i] = min(found)[1]
    return out


def test_covered_with_a_hot_signature(spark, monkeypatch):
    monkeypatch.setattr(C, "ID_CHUNK", 10)
    rng = random.Random(3)
    current = [(f"f{i}", "hot" if i % 3 else f"s{i % 20}") for i in range(600)]
    coverage = [(f"f{rng.randrange(600)}", h, rng.randrange(1000), rng.choice(["hot", f"s{rng.randrange(20)}"]), 5 if rng.random() < 0.3 else None) for h in range(200)]
    frame = spark.createDataFrame(current, "id string, signature string")
    links = spark.createDataFrame(coverage, "finding_id string, history_id long, completed_at long, signature string, reopened_at long")
    assert {r.id: r.history_id for r in C.covered(frame, links).collect()} == loop_covered(current, coverage)


def test_a_hot_key_is_joined_in_several_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = spark.range(8000).select(F.lit("hot").alias("k"), "id")
        joined = scan.salted_join(left, spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int"), ["k"])
        sizes = [len(p) for p in joined.rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 8000 and max(sizes) < 4000 and joined.columns == ["k", "id", "v"]


def test_quotes_are_looked_up(spark):
    text = "the disk of the third node was full again at noon"
    evidence = spark.createDataFrame([("e1", "f", 1, text + " and later"), ("e2", "g", 1, text)], "id string, gid string, ts long, text string")
    coverage = spark.createDataFrame([("f", "xx " + text), ("f", "short"), ("g", "something else that is long enough"), ("g", None)], "finding_id string, evidence_text string")
    reason = "a concrete reason for another look"
    claims = [("c1", "f", "e1", text, reason, None), ("c2", "f", "e1", "noon and later", reason, None), ("c3", "f", "e1", "again at noon and later", reason, None), ("c4", "g", "e2", text, reason, None),
              ("c5", "g", "old", text, reason, None), ("c6", "f", "old", "x", reason, "owner ticket 1234"), ("c7", "f", "e1", None, reason, None), ("c8", "f", "old", text, reason, "owner")]
    rows = spark.createDataFrame(claims, "claim_id string, finding_id string, evidence_id string, quote string, reason string, owner_authorization string")
    assert {r.claim_id for r in C.reopenings(rows, evidence, coverage).filter("accepted").collect()} == {"c3", "c4", "c6"}


def test_promotion_leaves_out_what_is_worked_on(spark):
    evidence = spark.createDataFrame([
        ("1", "a", 1, "fatal error in worker", "p", None, "watch", "parent"), ("2", "a", 2, "database disk image is malformed", "p", None, "watch", "parent"),
        ("3", "b", 1, "fatal error", "p", None, "watch", "parent"), ("4", "c", 1, 'said "fatal error"', "p", None, "watch", "parent"),
        ("5", "d", 1, "fatal error", "own-health", "platform.send_failed", "watch", "parent"), ("6", "e", 1, "fatal error", "p", None, "watch", "continuation")],
        "id string, gid string, ts long, text string, profile string, event string, severity string, record_role string")
    findings = spark.createDataFrame([(x, None) for x in "abcde"], "id string, decision string")
    out = O.promote(findings, evidence, spark.createDataFrame([("b",)], "id string")).collect()
    assert {(r.id, r.serious, r.first_seen) for r in out} >= {("a", "database corruption", 1)} and "b" not in {r.id for r in out} and "e" not in {r.id for r in out}
    assert "d" not in {r.gid for r in Z.serious(evidence, health_profile="^own-health$").collect()}
