"""Heavy work per row is spread over the cores, and steps that are skipped change nothing."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tracewell import patterns as P
from tracewell.functions import regex as rx
from tracewell.functions import text as T
from tracewell.queries import adapters

TEXTS = [
    None, "", " ", "a\tb", "two  blanks", "plain", "token=abcdefgh12", "File \"a/b.py\", line 3 in /srv/x", "request_id=abcdefgh1234 took 3 ms",
    "REQUEST ID: abcdefgh.1234", "span-id='abcdefgh99'", "id 0123456789abcdef0 and 0xABCDEF12", "in 12.5s after 3 chunks", "1,024 input tokens", "7 CHARS", "12 char",
    "pid=12 PID 13 process id: 14 ProcessId 15", "Process ID 16", "at 2024-01-02 03:04:05,123 and Jan  3 04:05:06", "x 12345678-aaaa-bbbb-cccc-123456789abc y",
    "12345678-AAAA-BBBB-CCCC-123456789ABC", "to/pp/k ens 5 to /q ken 9 tokens", "C:\\dir\\file.txt and /var/log/x.log", "https://h.example/a/b?x=1 /tmp/z  end", "5 \u212aelvin p\u0131d 7",
    "api_key: 'hush/hush' see /etc/app", "sk-abcdefghij/keys /etc/a", "Bearer abcdefghijklmnopqrst /etc/b", "a\u00a0b\u2003c  d", "1 \n 2\r\n3\x0b4\x0c5", "[20240101_000001_abc] [cron_x_20240101_000001] 5 m",
]


def test_template_and_resources_equal_all_steps_on_every_text(spark):
    rows = spark.createDataFrame([(i, s, t) for i, t in enumerate(TEXTS) for s in (False, True)], "k int, s boolean, text string")
    got = {(r.k, r.s): (r.normalized_text, r.res) for r in T.add_template(rows, F.col("text"), F.col("s")).withColumn("res", T.resources(F.col("text"))).collect()}

    def every_step(lead):
        c = F.col
        safe = T.redact(F.coalesce("text", F.lit("")))
        steps = [{"safe": safe}, {"urls": rx.every(c("safe"), P.URL), "t": F.regexp_replace("safe", P.URL, P.URL_MARK)}]
        steps += [{"t": F.regexp_replace("t", P.LEADING_STAMP, "")}, {"t": F.regexp_replace("t", P.FRAME_REFERENCE, 'File "<F>", line')}]
        steps += [{"t": F.when(c("s"), T._replace_all(c("t"), T.SHORTEN_PATHS)).otherwise(T._replace_all(c("t"), T.DROP_PATHS))}]
        steps += [{"t": F.regexp_replace("t", p, w)} for p, w in T.TEMPLATE_STEPS[:3]]
        steps += [{"t": F.when(c("t").rlike("[0-9]|[iI][dD]"), T._replace_all(c("t"), T.TEMPLATE_STEPS[3:])).otherwise(c("t"))}]
        steps += [{"t": F.array_join(F.zip_with(F.split("t", P.URL_MARK, -1), "urls", lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")}]
        clean = T._replace_all(c("text"), [(P.FRAME_REFERENCE, ""), *T.REDACTIONS, (P.KEYED_SECRET, "<REDACTED>")])
        found = F.array_sort(F.array_distinct(F.concat(rx.every(clean, P.WINDOWS_PATH), rx.every(clean, P.POSIX_PATH, 2))))
        steps += [{"n": F.trim(F.regexp_replace("t", r"\s+", " ")), "res": F.when(c("text").rlike(r"[/\\]"), found).otherwise(F.array().cast("array<string>"))}]
        return reduce(lambda df, step: df.withColumns(step), steps, lead)

    assert got == {(r.k, r.s): (r.n, r.res) for r in every_step(rows).collect()}


def test_template_keeps_columns_and_replaces_an_older_template(spark):
    rows = spark.createDataFrame([("a 1", "old", 7)], "text string, normalized_text string, `odd.name` int")
    out = T.add_template(rows, F.col("text"), F.lit(False))
    assert sorted(out.columns) == ["normalized_text", "odd.name", "text"]
    assert out.select("text", "normalized_text", "`odd.name`").first() == ("a 1", "a 1", 7)


def test_rows_are_spread_in_equal_parts_two_per_core_at_most(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(adapters.ROWS_PER_TASK * 4 * cores).selectExpr("id AS line_id").coalesce(cores + 1)
    parts = adapters.balanced(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) == 2 * cores and max(p["count"] for p in parts) < 1.2 * min(p["count"] for p in parts)
    assert adapters.balanced(spark.range(0).selectExpr("id AS line_id")).count() == 0
