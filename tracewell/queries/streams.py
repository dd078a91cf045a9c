"""Streaming queries, each run to completion and checked against its batch form, and excerpts."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import text as T
from tracewell.operators import coverage as C, excerpts, groups as G
from tracewell.plans import enrich as E
from tracewell.queries import adapters, duck as d
from tracewell.queries import groups as Q
from tracewell.queries import lines as QL
from tracewell.queries import rules as QR
from tracewell.queries.registry import query
from tracewell.queries.text import HOST_ALIASES, LEADING_CTE
from tracewell.sinks import stores
from tracewell.sources import ranges as R
from tracewell.streaming import jobs

FILES_PER_BATCH = 3


def _stream(spark, frame):
    """The files of a stored table as a stream of several micro-batches."""
    path = frame.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)


def _finish(running):
    running.awaitTermination(1800)
    if running.isActive:
        running.stop()
        raise TimeoutError("the stream did not finish")


def _fresh_lines(spark, folder):
    rows = _stream(spark, adapters.lines(spark, folder)).withColumn("event_at", T.leading_ts(F.col("text")))
    return jobs.fresh(rows, "event_at", F.lit(adapters.NOW).cast("timestamp"))


def _to_table(spark, frame, name):
    path = Q._fresh(spark, name)
    _finish(frame.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path))
    return spark.read.parquet(path)


_FRESH = f"""fresh AS (SELECT * FROM staged WHERE instant BETWEEN {d.NOW_TS} - INTERVAL 72 HOUR AND {d.NOW_TS})"""


@query("stream_late_gate", d.with_lines(f"SELECT line_id, {d.iso('instant')} AS event_ts FROM fresh", LEADING_CTE, _FRESH))
def late_gate(spark, folder):
    stored = _to_table(spark, _fresh_lines(spark, folder).select("line_id", "event_at"), "late-gate")
    return stored.select("line_id", T.canonical_text(F.col("event_at")).alias("event_ts"))


@query("stream_dedupe", d.with_lines("SELECT DISTINCT sha256(profile || text) AS key FROM fresh", LEADING_CTE, _FRESH))
def stream_dedupe(spark, folder):
    keyed = _fresh_lines(spark, folder).select("event_at", F.sha2(F.concat("profile", "text"), 256).alias("key"))
    return _to_table(spark, jobs.dedupe(keyed, "key").select("key"), "dedupe")


@query("stream_groups", Q.with_store(Q._GROUP_SQL))
def stream_groups(spark, folder):
    path = Q._fresh(spark, "groups")
    frame = Q.store(spark, folder)
    running = jobs.rolling_groups(_stream(spark, frame), path, f"{path}-checkpoint", lambda rows: Q.now())
    _finish(running)
    return Q._show(G.flat(spark.read.parquet(jobs.last_snapshot(running, path))))


@query("stream_fold", d.with_lines("""SELECT source_path, parent_start AS byte_start, max(byte_end) AS byte_end,
    md5(substr(string_agg(substr(text, 1, 800), chr(10) ORDER BY byte_start), 1, 8000)) AS text_md5, count(*) - 1 AS children FROM records WHERE role IS NOT NULL GROUP BY source_path, parent_start""", QL.ROLES))
def stream_fold(spark, folder):
    # Each source arrives in three parts that are cut without regard to records, as a tail finds them.
    lines = adapters.lines(spark, folder)
    most = lines.agg(F.max("byte_start")).first()[0]
    path = Q._fresh(spark, "fold")
    for part in range(3):
        inside = F.col("byte_start").between(F.lit(part * most // 3 + (part > 0)), F.lit((part + 1) * most // 3))
        lines.filter(inside).write.mode("append").parquet(f"{path}-in")
        stream = spark.readStream.schema(lines.schema).parquet(f"{path}-in")
        running = jobs.fold_lines(stream, path, f"{path}-checkpoint", Q.now(), adapters.CHUNK_BYTES)
        _finish(running)
    jobs.flush_lines(running, path, Q.now(), adapters.CHUNK_BYTES)
    return spark.read.option("recursiveFileLookup", "true").parquet(path).select(
        "source_path", "byte_start", "byte_end", F.md5("text").alias("text_md5"), "children")


@query("stream_enrich", Q.with_store("""SELECT strftime(event_at, '%Y%m%d') AS bucket_day, CASE WHEN hour(event_at) < 12 THEN '00' ELSE '12' END AS bucket_half,
    count(*) AS rows, count(DISTINCT fingerprint) AS fingerprints, count(*) FILTER (WHERE severity = 'needs-attention') AS attention FROM stored GROUP BY ALL"""))
def stream_enrich(spark, folder):
    def enrich(rows):
        out = E.enrich(rows.drop("ts").withColumnRenamed("stamp", "ts"), QR.POLICY, QR.BOOK, HOST_ALIASES)
        at = F.coalesce(T.leading_ts(F.col("text")), F.date_trunc("second", F.col("stored_at")))
        return out.select(F.col("line_id").alias("record_id"), "source_path", "byte_start", at.alias("event_at"),
                          F.col("fingerprint.key").alias("fingerprint"), F.col("severity.label").alias("severity"))

    path = Q._fresh(spark, "enriched-stream")
    _finish(jobs.enrich_to_buckets(_stream(spark, adapters.lines(spark, folder)), enrich, path, f"{path}-checkpoint"))
    return stores.read_buckets(spark, path).groupBy("bucket_day", "bucket_half").agg(
        F.count("*").alias("rows"), F.countDistinct("fingerprint").alias("fingerprints"),
        F.count_if(F.col("severity") == "needs-attention").alias("attention"))


# --- excerpts and coverage identity -------------------------------------------------------------------
_EXCERPTS = """whole AS (SELECT rel_path, string_agg(content, '' ORDER BY line_id) AS content FROM exported GROUP BY rel_path),
 cases AS (SELECT f.rel_path, first_byte AS byte_start, f.text, CASE WHEN first_byte % 10 = 7 THEN 300 ELSE end_byte - first_byte END AS span, w.content,
   CASE first_byte % 10 WHEN 3 THEN 'rotated_or_truncated' WHEN 4 THEN 'source_file_missing' WHEN 5 THEN 'journald_entry' WHEN 6 THEN 'rotated_or_truncated' ELSE 'exact_source' END AS status
   FROM found f JOIN whole w USING (rel_path))"""


@query("fn_evidence_excerpt", d.with_lines("""SELECT rel_path, byte_start, status, md5(CASE WHEN status = 'exact_source' THEN substr(content, byte_start + 1, least(span, 300)) ELSE substr(text, 1, 300) END) AS excerpt_md5,
    CASE WHEN status = 'exact_source' THEN span > 300 ELSE length(text) > 300 END AS truncated, CASE WHEN byte_start % 10 IN (0, 2, 8) THEN true WHEN byte_start % 10 IN (3, 6) THEN false END AS verified
    FROM cases""", adapters.EXPORTED, _EXCERPTS))
def evidence_excerpt(spark, folder):
    c = F.col
    lines = QL.read_logs(spark, folder)
    paths = R.with_identity(lines.select(c("source_path").alias("path")).distinct())
    case = c("byte_start") % 10
    evidence = lines.join(paths, c("source_path") == c("path")).select(
        F.concat_ws(":", "source_path", "byte_start").alias("id"), QL.in_root().alias("rel_path"),
        F.when(case == 4, "/gone").when(case == 5, "journald").otherwise(c("source_path")).alias("source_path"), "byte_start",
        F.when(case == 7, c("byte_start")).otherwise(c("byte_end")).alias("byte_end"), "text",
        F.when(case == 3, "another line").when(case.isin(0, 2, 6, 8), F.sha2("text", 256)).alias("content_hash"),
        F.when(case == 6, c("inode") + 1).when(case == 8, c("inode")).alias("inode"), F.when(case.isin(6, 8), c("dev")).alias("dev"),
        F.when(case == 5, "s=1").alias("cursor"), F.lit(None).cast("string").alias("boot_id"))
    return excerpts.excerpt(evidence, max_bytes=300).select(
        "rel_path", "byte_start", c("excerpt_status").alias("status"), F.md5("excerpt").alias("excerpt_md5"), c("excerpt_truncated").alias("truncated"), "verified")


_STEPS = [(P.LEADING_STAMP, ""), (P.SCHEDULED_RUN, "[$1_<RUN>]"), (P.COOLDOWN_EXPIRY, "$1<TIME>"), (P.ISO_ANYWHERE, "<TIMESTAMP>"),
          (P.ATTEMPT_COUNT, "attempt <N>"), (P.FRAME_REFERENCE, 'File "<FRAME>", line'), (P.IDENTITY_PREFIX, ""), (r"\s+", " ")]
_BARE = d.sub("text", P.FRAME_REFERENCE, "")


@query("fn_coverage_identity", d.with_lines(f"""SELECT line_id, scope_key, concrete, covered_text, {d.digest('scope_key', 'covered_text', "'watch'", 'impact')} AS signature FROM
    (SELECT *, {d.digest("CASE WHEN lower(trim(host)) = 'node-b' THEN 'beta' ELSE trim(host) END", 'profile', 'event_type', 'NULL', 'NULL', d.packed_list('paths'), d.packed_list('jobs'))} AS scope_key,
       len(paths) > 0 OR len(jobs) > 0 AS concrete, trim({d.subs('text', _STEPS)}) AS covered_text, CASE WHEN line_id % 13 = 0 THEN 'outage' END AS impact
     FROM (SELECT *, list_sort(list_distinct(list_concat({d.every(_BARE, P.POSIX_PATH, 2)}, {d.every(_BARE, P.WINDOWS_PATH)}))) AS paths,
       list_sort({d.distinct(d.every('text', P.SCHEDULED_RUN, 1))}) AS jobs FROM lines))"""))
def coverage_identity(spark, folder):
    c = F.col
    nothing = F.lit(None).cast("string")
    identity = C.identity(c("host"), c("profile"), c("event_type"), nothing, nothing, c("text"), F.lit("watch"),
                          F.when(c("line_id") % 13 == 0, "outage"), HOST_ALIASES)
    return adapters.lines(spark, folder).select("line_id", *[v.alias(k) for k, v in identity.items()])
