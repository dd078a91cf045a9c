"""Streams: restarts, replays and late rows."""
import datetime as dt

from pyspark.sql import functions as F

from tracewell.operators import groups as G
from tracewell.operators import ledger as O
from tracewell.sinks import stores
from tracewell.streaming import jobs

NOW = "2024-01-10 00:00:00"


def finish(running):
    running.awaitTermination(300)
    assert not running.isActive


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_notice_is_sent_once_ever(spark, tmp_path):
    source, ledger, sent = str(tmp_path / "in"), str(tmp_path / "ledger"), []

    def run():
        stream = spark.readStream.schema("notice_key string, message string").parquet(source)
        finish(jobs.send_new_notices(stream, ledger, str(tmp_path / "check"), lambda df, n: sent.extend(r.message for r in df.collect())))

    write(spark, source, [("a", "first"), ("a", "first"), ("b", "second")], "notice_key string, message string")
    run()
    write(spark, source, [("b", "second"), ("c", "third")], "notice_key string, message string")
    run()
    run()
    assert sorted(sent) == ["first", "second", "third"]
    stream = spark.readStream.schema("notice_key string, message string").parquet(source)  # replayed from a lost checkpoint
    finish(jobs.send_new_notices(stream, ledger, str(tmp_path / "other"), lambda df, n: sent.extend(r.message for r in df.collect())))
    assert sorted(sent) == ["first", "second", "third"]


def test_late_rows_are_dropped_and_the_future_does_not_move_the_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "key string, at timestamp"
    moment = dt.datetime(2024, 1, 10)
    write(spark, source, [("future", moment + dt.timedelta(days=9)), ("now", moment)], schema)
    stream = spark.readStream.schema(schema).parquet(source)
    fresh = jobs.dedupe(jobs.fresh(stream, "at", F.lit(NOW).cast("timestamp")), "key")

    def run():
        finish(fresh.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")))

    run()
    write(spark, source, [("edge", moment - dt.timedelta(hours=72)), ("old", moment - dt.timedelta(hours=72, seconds=1)), ("now", moment)], schema)
    run()
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["edge", "now"]


def test_enrichment_replay_stores_nothing_twice(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "record_id string, event_at timestamp, text string"
    moment = dt.datetime(2024, 1, 9, 11, 59)
    write(spark, source, [("r1", moment, "a"), ("r2", moment + dt.timedelta(minutes=2), "b")], schema)

    def run(check):
        stream = spark.readStream.schema(schema).parquet(source)
        finish(jobs.enrich_to_buckets(stream, lambda rows: rows.withColumn("seen", F.lit(1)), store, str(tmp_path / check)))

    run("one")
    write(spark, source, [("r3", moment - dt.timedelta(days=2), "late but kept")], schema)
    run("two")  # a lost checkpoint: everything is read again
    rows = stores.read_buckets(spark, store).orderBy("record_id").collect()
    assert [(r.record_id, r.bucket_day, r.bucket_half) for r in rows] == [("r1", "20240109", "00"), ("r2", "20240109", "12"), ("r3", "20240107", "00")]


def test_rolling_groups_are_bounded(spark, tmp_path):
    """With a reference time that moves, groups leave as in a plain loop, and only two tables are kept."""
    source, path = str(tmp_path / "in"), str(tmp_path / "groups")
    start = dt.datetime(2024, 1, 10)
    batches = [[(f"k{(i + n) % 4}", start + dt.timedelta(hours=30 * n + i)) for i in range(3)] for n in range(6)]
    empty = spark.createDataFrame([], "key string, at timestamp").select(F.struct("key").alias("fingerprint"), F.col("at").alias("event_at"))
    schema = empty.schema
    clock = {}

    def rows(stream):
        none = F.lit(None)
        text = F.lit("t")
        return stream.select(
            F.struct(F.col("fingerprint.key").alias("key"), F.lit("h").alias("host"), F.lit("p").alias("profile"), text.alias("normalized_text")).alias("fingerprint"),
            "event_at", F.unix_timestamp("event_at").alias("record_id"), text.alias("text"),
            F.struct(*[(F.array().cast("array<string>") if a in ("events", "causes", "exceptions", "matched_rules", "conflicts") else none.cast("string")).alias(a) for a in G.CARRIED]).alias("classification"),
            F.struct(F.lit("watch").alias("label"), F.lit("r").alias("rule_id"), F.lit("v").alias("policy_version")).alias("severity"),
            F.struct(F.lit("/x").alias("source_path"), F.lit(0).alias("byte_start"), F.lit(1).alias("byte_end")).alias("provenance"))

    def now(batch):
        latest = batch.agg(F.max("event_at")).first()[0]
        clock["now"] = max(clock.get("now", latest), latest)
        return F.lit(clock["now"])

    held = {}
    for n, batch in enumerate(batches):
        spark.createDataFrame([((k,), at) for k, at in batch], schema).coalesce(1).write.mode("append").parquet(source)
        running = jobs.rolling_groups(rows(spark.readStream.schema(schema).parquet(source)), path, str(tmp_path / "check"), now)
        finish(running)
        moment = max(at for _, at in batch)
        inside = lambda at: moment - dt.timedelta(hours=72) <= at <= moment
        held = {k: v for k, v in held.items() if inside(v[1])}
        for k, at in batch:
            if inside(at):
                count, last = held.get(k, (0, at))
                held[k] = (count + 1, max(last, at))
        got = {r.fingerprint: (r.n, r.last_at) for r in spark.read.parquet(jobs.last_snapshot(running, path)).collect()}
        assert got == held, n
        assert len([x for x in (tmp_path / "groups").iterdir()]) <= 2


def test_state_is_kept_outside_the_heap(spark):
    from tracewell import session
    session.configure(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled") == "true"


def test_groups_leave_with_the_window(spark):
    def group(key, last):
        return (key, 1, last, last, 1, 1, ("s",), ("l",), ["/x"])
    schema = ("fingerprint string, n long, first_at timestamp, last_at timestamp, first_id long, last_id long, "
              "sample struct<a:string>, latest struct<b:string>, source_files array<string>")
    now = dt.datetime(2024, 1, 10)
    prior = spark.createDataFrame([group("alive", now - dt.timedelta(hours=72)), group("stale", now - dt.timedelta(hours=73))], schema)
    alive = prior.filter(F.col("last_at") >= F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 72 HOURS"))
    merged = G.merge(alive.unionByName(prior.filter("fingerprint = 'alive'")))
    assert [(r.fingerprint, r.n) for r in merged.collect()] == [("alive", 2)]


def test_an_unchanged_balance_is_silent(spark):
    status = spark.createDataFrame([("a", 1)], "name string, value long")
    history = spark.createDataFrame([(1, 10)], "id long, completed_at long")
    first = O.daily_balance(status, history).first()
    assert first.changed and not O.daily_balance(status, history, first.digest).first().changed
    more = spark.createDataFrame([(1, 10), (2, 20)], "id long, completed_at long")
    assert O.daily_balance(status, more, first.digest).first().changed


def test_records_span_micro_batches(spark, tmp_path):
    """Lines that arrive one part after another give the records of one pass, wherever the parts are cut."""
    from tracewell.operators import lines as L
    texts = ["detail before any level", "2024-01-09 10:00:00 ERROR a: one", "  File \"x.py\", line 1", "ValueError: bad", "plain words", "2024-01-09 10:00:01 INFO a: fine", "more words",
             "2024-01-09 10:00:02 WARNING a: two", "Traceback (most recent call last):", '  File "y.py", line 2', "KeyError: k"]
    rows, at = [], {}
    for i, text in enumerate(texts * 2):
        for path in ("/a/agent.log", "/b/errors.log"):
            start = at.get(path, 0)
            at[path] = start + len(text) + 1
            rows.append((i, path, path.rsplit("/", 1)[1], start, at[path], text))
    schema = "line_id long, source_path string, source_name string, byte_start long, byte_end long, text string"
    now = F.lit(NOW).cast("timestamp")
    whole = spark.createDataFrame(rows, schema)
    shown = lambda df: sorted((r.source_path, r.byte_start, r.byte_end, r.text, r.children) for r in df.collect())
    want = shown(L.fold(L.stage_lines(L.keep_lines(whole), now)))
    assert any(children > 2 for *_, children in want)
    source, path = str(tmp_path / "in"), str(tmp_path / "fold")
    for a, b in ((0, 2), (2, 3), (3, 9), (9, 13), (13, 14), (14, 30)):
        write(spark, source, [r for r in rows if a <= r[0] < b], schema)
        running = jobs.fold_lines(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "check"), now, 1 << 20)
        finish(running)
    jobs.flush_lines(running, path, now, 1 << 20)
    assert shown(spark.read.option("recursiveFileLookup", "true").parquet(path)) == want
    assert len(list((tmp_path / "fold-open").iterdir())) <= 2
