"""Log-shaped views of the given tables, as SQL text that Spark and DuckDB read alike.

``LINES`` turns every row of ``events`` into one line of a log file; the other
texts build on it. Placeholders of the form ``{lines}`` are filled by ``sql``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell import session

# Reference time of every query: inside the month the events cover.
NOW = "2024-01-30 12:00:00"
# Bytes per chunk in the chunked scans: small, so that tests cross chunk borders.
CHUNK_BYTES = 1 << 20

_FIELDS = """
  SELECT event_id AS line_id, event_id, user_id, event_type, value, ts,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         substr(CAST(ts AS STRING), 1, 19) AS stamp,
         md5(concat('e', CAST(event_id AS STRING))) AS tag
  FROM events
"""

_BODY = """
  SELECT f.*,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'signup' THEN 'CRITICAL'
         WHEN 'click' THEN 'INFO' ELSE 'WARNING' END AS level,
    CASE event_id % 24
      WHEN 0 THEN 'agent.conversation_loop' WHEN 1 THEN 'agent.chat_completion' WHEN 2 THEN 'gateway.discord'
      WHEN 3 THEN 'agent.tool_executor' WHEN 4 THEN 'agent.storage' WHEN 5 THEN 'agent.conversation_loop'
      WHEN 6 THEN 'agent.tool_executor' WHEN 7 THEN 'agent.tool_executor' WHEN 8 THEN 'agent.auxiliary_client'
      WHEN 9 THEN 'gateway.telegram' WHEN 10 THEN 'host' WHEN 11 THEN 'host' WHEN 12 THEN 'host'
      WHEN 13 THEN 'agent.conversation_loop' WHEN 14 THEN 'agent.http' WHEN 15 THEN 'agent.credential'
      WHEN 16 THEN 'agent.conversation_loop' WHEN 17 THEN 'gateway.discord' WHEN 18 THEN 'agent.title_generator'
      WHEN 19 THEN 'agent.ingest' WHEN 20 THEN 'tools.mcp' WHEN 21 THEN 'agent.db' WHEN 22 THEN 'gateway.slack'
      ELSE 'agent.resolver' END AS logger,
    CASE event_id % 24
      WHEN 0 THEN concat('API call failed: provider=openai model=gpt-4o HTTP 429 Too Many Requests (attempt ', CAST(k % 5 + 1 AS STRING), '/5), retrying in ', CAST(k AS STRING), '.5s')
      WHEN 1 THEN concat('Streaming failed before delivery: Codex stream produced no SSE events after ', CAST(k AS STRING), 's')
      WHEN 2 THEN 'Failed to connect to discord: 503 Service Unavailable'
      WHEN 3 THEN 'Tool terminal returned error (127): /bin/sh: line 1: widget: command not found, exit code 127'
      WHEN 4 THEN concat('database disk image is malformed: /srv/data/shard', CAST(k % 3 AS STRING), '.sqlite')
      WHEN 5 THEN 'The usage limit has been reached (429 RateLimitError) for openai-codex gpt-4.1-mini'
      WHEN 6 THEN 'Tool read_file returned error: [Errno 2] No such file or directory: ''missing.py'''
      WHEN 7 THEN concat('Tool search completed in 0.', CAST(k AS STRING), 's (1,', lpad(CAST(k AS STRING), 3, '0'), ' chars)')
      WHEN 8 THEN concat('Auxiliary: marking vertex unhealthy for 600s (payment / credit error). Subsequent auxiliary calls will skip it until 00:', lpad(CAST(k % 60 AS STRING), 2, '0'), ':33.')
      WHEN 9 THEN concat('Telegram polling conflict (', CAST(k % 3 + 1 AS STRING), '/3): terminated by other getUpdates request')
      WHEN 10 THEN concat('kernel: Out of memory: Killed process ', CAST(k * 7 AS STRING), ' (postgres) total-vm:1048576kB')
      WHEN 11 THEN concat('systemd[1]: worker', CAST(k % 2 AS STRING), '.service: Main process exited, code=exited, status=', CAST(k % 3 + 1 AS STRING))
      WHEN 12 THEN concat('sshd[', CAST(k * 11 AS STRING), ']: Failed password for root from 10.0.0.', CAST(k AS STRING), ' port 22')
      WHEN 13 THEN 'provider=gemini model=gemini-1.5-pro rejected the request: 400 Bad Request invalid argument; falling back to provider=openrouter model=claude-3-haiku'
      WHEN 14 THEN concat('Connection refused by host db-', CAST(k % 4 AS STRING), '.internal:5432 (pid ', CAST(k * 13 AS STRING), ') request_id=', substr(tag, 1, 12))
      WHEN 15 THEN concat('token = "', tag, '" was refused: 401 Unauthorized, see /etc/app/', CASE WHEN k % 2 = 0 THEN 'auth.yaml' ELSE 'keys.json' END)
      WHEN 16 THEN concat('API call #', CAST(k AS STRING), ': 1,024 input tokens, previous status 500 in ', CAST(k AS STRING), ' ms')
      WHEN 17 THEN concat('Missing Access while editing message ', substr(tag, 1, 8), '-aaaa-bbbb-cccc-', substr(tag, 9, 12))
      WHEN 18 THEN concat('Title generation failed: TimeoutError while calling https://api.example.com/v1/jobs/', CAST(k AS STRING), ' timed out after 30s')
      WHEN 19 THEN repeat('payload ', 120)
      WHEN 20 THEN 'MCP server ''files'' failed initial connection: MCP error: -32000 Connection closed'
      WHEN 21 THEN 'fatal error: disk I/O error while writing cache.db, exit code 3, SIGKILL'
      WHEN 22 THEN 'rate limit reached: error code: 429 - {''code'': ''rate_limit_exceeded'', ''type'': ''requests''}, earlier status 503'
      ELSE 'Temporary failure in name resolution for host api.internal:443 raised aiohttp.ClientConnectorDNSError' END AS message
  FROM fields f
"""

_LINES = """
  SELECT line_id, user_id, event_type, value, k, ts, stamp,
    CASE WHEN user_id % 3 = 0 THEN 'alpha' WHEN user_id % 3 = 1 THEN 'Node-B' ELSE 'gamma' END AS host,
    CASE WHEN user_id % 8 = 0 THEN 'system:worker.service' ELSE concat('team-', CAST(user_id % 8 AS STRING)) END AS profile,
    CASE WHEN user_id % 9 < 3 THEN 'agent.log' WHEN user_id % 9 < 6 THEN 'errors.log.1' ELSE 'gateway.log' END AS source_name,
    concat('/var/app/', CASE WHEN user_id % 8 = 0 THEN 'logs/' ELSE concat('profiles/team-', CAST(user_id % 8 AS STRING), '/logs/') END,
           CASE WHEN user_id % 3 = 0 THEN 'alpha' WHEN user_id % 3 = 1 THEN 'Node-B' ELSE 'gamma' END, '/',
           CASE WHEN user_id % 9 < 3 THEN 'agent.log' WHEN user_id % 9 < 6 THEN 'errors.log.1' ELSE 'gateway.log' END) AS source_path,
    event_id * 2048 AS byte_start,
    CASE
      WHEN event_id % 5 = 4 AND event_id % 3 = 0 THEN concat('  File "/srv/app/worker.py", line ', CAST(k AS STRING))
      WHEN event_id % 5 = 4 AND event_id % 3 = 1 THEN '    result = do_work(payload)'
      WHEN event_id % 5 = 4 THEN concat('ValueError: bad payload ', CAST(k % 4 AS STRING))
      WHEN event_id % 53 = 7 THEN concat('2024-13-45 99:99:99 ERROR ', logger, ': ', message)
      WHEN event_id % 74 = 5 THEN concat('plain diagnostic recorded at ', stamp, ' without a level')
      WHEN event_id % 37 = 5 THEN 'plain diagnostic without a level'
      WHEN event_id % 41 = 3 THEN concat(logger, ': ', message)
      WHEN event_id % 6 = 1 THEN concat(replace(stamp, ' ', 'T'), '.250+02:00 ', level, ' ', logger, ': ', message)
      WHEN event_id % 4 = 0 THEN concat(stamp, ',', lpad(CAST(k AS STRING), 3, '0'), ' ', level, ' [20240101_0', lpad(CAST(k AS STRING), 5, '0'), '_', substr(tag, 1, 6), '] ', logger, ': ', message)
      WHEN event_id % 4 = 1 THEN concat(stamp, ' ', level, ' [cron_job', CAST(user_id % 7 AS STRING), '_20240102_0', lpad(CAST(k AS STRING), 5, '0'), '] ', logger, ': ', message)
      ELSE concat(stamp, ' ', level, ' ', logger, ': ', message) END AS text
  FROM bodies
"""

LINES_CTE = f"fields AS ({_FIELDS}), bodies AS ({_BODY}), raw_lines AS ({_LINES}), " \
    "lines AS (SELECT *, byte_start + length(text) + 1 AS byte_end FROM raw_lines)"

# Journal export rows: one per line, every value a string, some cursors repeated.
JOURNAL = """journal AS (
  SELECT line_id,
    CASE WHEN line_id % 6 = 5 THEN NULL ELSE text END AS MESSAGE,
    CASE WHEN line_id % 11 = 0 THEN 'n/a' ELSE CAST(line_id % 8 AS STRING) END AS PRIORITY,
    CASE WHEN line_id % 29 = 0 THEN 'junk' WHEN line_id % 31 = 0 THEN NULL
         ELSE CAST(1704067200000000 + line_id * 250000000 % 2592000000000 AS STRING) END AS __REALTIME_TIMESTAMP,
    concat('s=', CAST(line_id - line_id % 3 AS STRING)) AS __CURSOR,
    CASE WHEN line_id % 4 = 0 THEN concat('unit', CAST(line_id % 3 AS STRING), '.service') END AS _SYSTEMD_UNIT,
    CASE WHEN line_id % 4 = 1 THEN 'user.service' END AS _SYSTEMD_USER_UNIT,
    CASE WHEN line_id % 4 = 2 THEN 'cron' END AS SYSLOG_IDENTIFIER,
    CASE WHEN line_id % 8 = 3 THEN 'bash' END AS _COMM,
    host AS _HOSTNAME
  FROM lines)"""
JOURNAL_CTE = LINES_CTE + ", " + JOURNAL


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session.configure(spark).read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str = "line_id") -> DataFrame:
    """Spreads rows by a unique key, whatever files they came from."""
    return df.repartition(key)


ROWS_PER_TASK = 5_000


def balanced(df: DataFrame, key: str = "line_id") -> DataFrame:
    """Spreads rows that take much work each into equal parts, two per core of the session if there are enough rows.

    Left as files, one file more than cores is a second round in which all cores but one wait.
    """
    most = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(most, -(-df.count() // ROWS_PER_TASK))), key)


_STAGED: dict[tuple[str, str, str], str] = {}


def stage(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """A derived table, written once per application to the shared folder and read back."""
    session.configure(spark)
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STAGED:
        target = f"{session.shared_dir(spark)}/{name}-{key[0]}-{len(_STAGED)}"
        build().write.mode("overwrite").parquet(target)
        _STAGED[key] = target
    return spark.read.parquet(_STAGED[key])


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Log lines as stored data: path, byte range, identity and text.

    Stored once, so that the operators under test read a table, with pruning
    and pushdown, instead of re-deriving every line.
    """
    def build() -> DataFrame:
        table(spark, folder, "events").createOrReplaceTempView("events")
        return spread(spark.sql(f"WITH {LINES_CTE} SELECT *, CAST(ts AS TIMESTAMP) AS stored_at FROM lines"))

    return stage(spark, folder, "lines", build)


def from_lines(spark: SparkSession, folder: str, ctes: str, select: str) -> DataFrame:
    """Runs shared adapter text over the staged lines."""
    lines(spark, folder).createOrReplaceTempView("lines")
    return spark.sql(f"WITH {ctes} {select}")


def journal(spark: SparkSession, folder: str) -> DataFrame:
    return from_lines(spark, folder, JOURNAL, "SELECT * FROM journal")


# The lines as log files in the layout of an application's folders, one per host, profile and log. Some lines end with a
# carriage return, some are followed by a blank line, and the files of one host end without a newline.
_EXPORTED = """
  SELECT *, CAST(sum(length(content)) OVER (PARTITION BY rel_path ORDER BY line_id ROWS UNBOUNDED PRECEDING) - length(content) AS BIGINT) AS file_start FROM (
    SELECT *, concat(text, CASE WHEN line_id % 10 = 3 THEN chr(13) ELSE '' END,
      CASE WHEN host = 'alpha' AND line_id = last_id THEN '' WHEN line_id % 50 = 7 THEN concat(chr(10), chr(10)) ELSE chr(10) END) AS content FROM (
      SELECT line_id, host, source_name, text, stamp, k, profile AS owner, rel_path, max(line_id) OVER (PARTITION BY rel_path) AS last_id FROM (
        SELECT *, concat(host, '/', CASE WHEN user_id % 8 = 0 THEN '' ELSE concat('profiles/team-', CAST(user_id % 8 AS STRING), '/') END, 'logs/', source_name) AS rel_path
        FROM lines) a) b) c
"""
# What a reader finds in them: byte ranges with the line's end, unfinished lines left out.
EXPORTED = f"""exported AS ({_EXPORTED}),
 found AS (SELECT *, file_start AS first_byte, file_start + length(text) + CASE WHEN line_id % 10 = 3 THEN 2 ELSE 1 END AS end_byte,
   coalesce(nullif(regexp_extract(rel_path, 'profiles/([^/]+)/', 1), ''), 'default') AS path_profile FROM exported
   WHERE NOT (host = 'alpha' AND line_id = last_id)),
 sizes AS (SELECT rel_path, CAST(max(file_start + length(content)) AS BIGINT) AS size FROM exported GROUP BY rel_path)"""
# The same lines as JSON, one file per host.
EVENT_JSON = "to_json({'ts': stamp, 'host': host, 'profile': profile, 'text': text, 'k': k})"


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows of rel_path, line_id and content as files below ``root``, in order; a repeated task writes the same file again."""
    def put(batches):
        import os
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        store, folder = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
        path = sink = mark = None
        written = []

        def close():
            if sink is not None:
                sink.close()
                store.move(mark, path)
                written.append(path)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{folder}/{name}"
                if target != path:
                    close()
                    path, mark = target, f"{target}.{uuid.uuid4().hex[:8]}.tmp"
                    store.create_dir(os.path.dirname(path), recursive=True)
                    sink = store.open_output_stream(mark)
                sink.write(content.encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array(written, pa.string())], ["path"])

    ordered = rows.select("rel_path", "content", "line_id").repartition("rel_path").sortWithinPartitions("rel_path", "line_id")
    return ordered.select("rel_path", "content").mapInArrow(put, "path string")


def log_files(spark: SparkSession, folder: str, kind: str = "logs") -> str:
    """Folder of the exported log files (``logs``) or JSON files (``jsonl``), written once per application."""
    key = (spark.sparkContext.applicationId, folder, f"files-{kind}")
    if key not in _STAGED:
        root = f"{session.shared_dir(spark)}/files-{kind}-{key[0]}-{len(_STAGED)}"
        if kind == "logs":
            rows = from_lines(spark, folder, f"exported AS ({_EXPORTED})", "SELECT rel_path, line_id, content FROM exported")
        else:
            rows = lines(spark, folder).selectExpr(
                "concat(host, '.jsonl') AS rel_path", "line_id",
                "concat(to_json(named_struct('ts', stamp, 'host', host, 'profile', profile, 'text', text, 'k', k)), char(10)) AS content")
        write_files(rows, root).count()
        _STAGED[key] = root
    return _STAGED[key]
