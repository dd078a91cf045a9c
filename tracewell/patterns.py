"""Patterns and word lists that decide results.

They describe external formats (log prefixes, tracebacks, status lines) and
must stay as they are for results to match. All of them avoid lookaround and
named groups, so Java and RE2 read them alike; ``[^\\n]`` replaces ``.``.
"""

# --- timestamps -------------------------------------------------------------
STAMP = r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?"
LEADING_PARTS = r"^\s*(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d)(?:[.,]\d+)?(Z|[+-]\d\d:?\d\d)?"
ANY_STAMP = r"\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d"
TEXT_STAMP = r"^" + STAMP
ISO_INSTANT = r"^\s*(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d)(?:[.,]\d+)?(Z|[+-]\d\d:?\d\d)?\s*\z"

# --- line prefix ------------------------------------------------------------
LEVELS = "CRITICAL|ERROR|WARNING|WARN|INFO|DEBUG|NOTICE|ALERT|EMERGENCY"
PREFIX = (
    r"^\s*(?:(" + STAMP + r")\s+)?(" + LEVELS + r")\b[ :]*"
    r"(?:\[([^\]]+)\]\s*)?(?:([\w.-]+):\s*)?"
)
LOGGER = r"^\s*((?:agent|tools|gateway|plugins|discord|telegram|searx)\.[\w.]+):\s*"
LOGGER_IS_EXCEPTION = r"(?:Error|Exception|TimedOut|Forbidden|NotFound)\z"
LEVEL_GATE = (
    r"(?i)^\s*(?:" + STAMP + r"\s+)?(DEBUG|INFO|NOTICE|WARNING|WARN|ERROR|CRITICAL|ALERT|EMERGENCY)\b[ :]*"
)
KEPT_LEVELS = ("WARNING", "WARN", "ERROR", "CRITICAL", "ALERT", "EMERGENCY")

# --- tracebacks -------------------------------------------------------------
FRAME = (
    r'^\s*(?:File "[^"]+", line \d+|Traceback \(most recent call last\):'
    r"|During handling of the above exception|The above exception was the direct cause|[~^]{3,}\s*\z)"
)
CODE_LINE = (
    r"^\s*(?:(?:return|raise|await|yield|async with)\s+"
    r"|[\w., ()]+\s*=\s*(?:await\s+|self\.|[\w.]+\()"
    r"|(?:self\.[\w.]+|\w+)\([^\n]*\)\s*\z)"
)
CONTEXT_LINE = (
    r'^(?:\s+File "[^\n]*", line \d+|\s+\^|\s{2,}|Traceback \(|[A-Za-z_][\w.]*(?:Error|Exception):)'
)
FRAME_REFERENCE = r'File "[^"]*", line(?:\s+\d+)?'

# --- attributes -------------------------------------------------------------
# The value groups end before trailing full stops, commas and semicolons.
PROVIDER_PARAM = r"(?i)(?:^|[^\w-])(provider\s*[=:]\s*['\"]?([\w./:-]*[\w/:-]))"
MODEL_PARAM = r"(?i)(?:^|[^\w-])model(?:_name)?\s*[=:]\s*['\"]?([\w./:@+-]*[\w/:@+-])"
MODEL_QUOTED = r"(?i)\bmodel\s+['\"]([^'\"]*[^'\".,;])[.,;]*['\"]"
MODEL_NAME = (
    r"(?i)\b(gpt-\d[\w.-]*|o[134](?:-[\w.-]+)?|gemini-\d[\w.-]*|claude-\d[\w.-]*"
    r"|claude-(?:sonnet|opus|haiku)-[\w.-]+|deepseek-(?:chat|reasoner|v\d[\w.-]*)|grok-[\w.-]+)\b"
)
FALLBACK = r"(?i)\b(?:falling back to|fallback(?:\s+(?:provider|model))?[=:])\s*['\"]?([\w./:@+-]+)"
ROUTES = (
    ("openai-codex", r"(?i)\bopenai-codex\b|chatgpt\.com/backend-api/codex|\bCodex (?:stream|token|OAuth)"),
    ("openrouter", r"(?i)openrouter\.ai"),
    ("gemini", r"(?i)generativelanguage\.googleapis\.com|\bGeminiAPIError\b"),
    ("vertex", r"(?i)aiplatform\.googleapis\.com"),
    ("openai", r"(?i)api\.openai\.com"),
    ("xai-oauth", r"(?i)\bxai-oauth\b"),
    ("copilot", r"(?i)\bCopilot token exchange"),
)
REFERENCE_MODEL = r"(?i)MoA reference model\s+([\w-]+):([\w./-]+)"
COOLDOWN_PROVIDER = r"(?i)Auxiliary: marking\s+([\w-]+)\s+unhealthy"
PLATFORMS = ("discord", "telegram", "homeassistant", "slack", "whatsapp", "wecom")
PLATFORM_AFTER = (
    r"\s+(?:adapter|gateway|websocket|client|transport|polling|bot token|typing|failed to connect|error|connect timed out)"
)
PLATFORM_BEFORE = (
    r"\b(?:Reconnect|Failed to connect to|Discovering|Fatal|handling for|closing unhealthy|aborted unresponsive|Platform)\s+['\"]?"
)
TOOL_NAMED = r"(?i)\bTool\s+['\"]?([\w.-]+)['\"]?\s+(?:returned|completed|failed|timed|execution)"
TOOL_KEYED = r"(?i)\btool_name[=:]\s*['\"]?([\w.-]+)"
TOOL_DEADLINE = r"(?i)\[deadline\]\s*['\"]?(\w+)"
MCP_SERVER = r"(?i)MCP server\s+['\"]?([\w.-]+)"
ENDPOINT = r"(?i)\bhost\s+([\w.-]+:\d+)"
DATABASE_FILE = r"(?i)\b([\w.-]+\.(?:db|sqlite|sqlite3))\b"
CHECK_FUNCTION = r"(?i)check_fn\s+(\w+)\s+returned False"
FILE_BASENAME = r"(?i)(?:[/\\]|['\"])([\w.-]+\.(?:yaml|yml|json|md|py|txt))['\"]?(?:\s|:|\z)"
EXCEPTION = (
    r"\b(?:\w+\.)*([A-Z][A-Za-z0-9]*(?:Error|Exception|Timeout)|gaierror|Forbidden|NotFound|BadRequest|TimedOut)\b"
)
ERROR_TYPE = r"(?i)error_type=(\w+)"
HTTP_LABELLED = (
    r"(?i)\b(?:HTTP(?:/\d(?:\.\d)?)?(?:\s+(?:error|status))?|status(?:_code)?|error\s+code)"
    r"\s*['\"]?\s*[:=]?\s*['\"]?([45]\d\d)\b"
)
HTTP_PHRASED = (
    r"(?i)\b([45]\d\d)\s+(?:Bad Request|Unauthorized|Forbidden|Not Found|Request Timeout|Conflict|Gone"
    r"|Payment Required|Too Many Requests|Internal Server Error|Bad Gateway|Service Unavailable"
    r"|Gateway Timeout|RESOURCE_EXHAUSTED|UNAVAILABLE|RateLimitError)\b"
)
CODE_QUOTED = r"(?i)['\"](?:code|type)['\"]\s*:\s*['\"]([\w.-]+)['\"]"
CODE_NUMBER = r"(?i)\berror code\s*[:=]\s*(-?\d+)\b"
LITERAL_CODES = (
    "RESOURCE_EXHAUSTED", "usage_limit_reached", "model_not_available_for_integrator",
    "invalid_grant", "context_length_exceeded",
)
RPC_CODE = r"(?i)\b(?:rpc(?:_code)?|MCP(?:\s+error)?|code)\s*['\"]?\s*[:=]\s*(-32\d{3})\b"
ERRNO = r"(?i)\bErrno\s+(-?\d+)\b"
EXIT_LABELLED = r"(?i)\bexit(?:_code| code| status)\s*['\"]?\s*[:=]?\s*(-?\d+)\b"
EXIT_SYSTEMD = r"(?i)\bcode=exited,\s*status=(\d+)\b"
EXIT_PHRASED = r"(?i)\bexited with code\s+(-?\d+)\b"
SIGNAL_NAME = r"(?i)\b(SIG(?:KILL|TERM|INT|ABRT|SEGV|PIPE))\b"
SIGNAL_KILLED = r"(?i)code=killed,\s*status=(\d+/\w+)"
ATTEMPT = r"(?i)\battempt\s+(\d+)(?:\s*(?:/|of)\s*(\d+))?"
POLL_ATTEMPT = r"(?i)\bpolling conflict\s*\((\d+)/(\d+)\)"
STREAM_BEFORE = r"(?i)Streaming failed before delivery"
STREAM_AFTER = r"(?i)Streaming failed after"

# --- scopes -----------------------------------------------------------------
CLEAR_SYSTEM = (
    r"(?i)(?:\bsystemd(?:\[\d+\])?:|\bkernel(?:\[[^\]]+\])?:|\bCIFS:\s|\bNetworkManager(?:\[\d+\])?:"
    r"|\bxrdp(?:-sesman)?(?:\.service)?(?:\[\d+\])?:|\bpam_(?:unix|winbind|systemd)\b|\bsshd(?:\[\d+\])?:"
    r"|\boom-kill\b|\binvoked oom-killer\b|\bOut of memory:\s|\bFailed with result ['\"][^'\"]+['\"]"
    r"|\bsearx\.|\bMDS CPU bug\b|\bVMSCAPE:|\[Firmware Bug\]|\bmicrocode\b)"
)
PLATFORM_SCOPE_TEXT = r"(?i)\bdiscord\b|\btelegram\b|\bapi_server failed to connect"
LLM_SCOPE_TEXT = r"(?i)\bAPI call|\bStreaming failed|\bCodex stream|\bGeminiAPIError"
PLATFORM_COMPONENTS = ("gateway.", "discord", "telegram", "tui_gateway.")
LLM_COMPONENTS = (
    "agent.conversation_loop", "agent.chat_completion", "agent.auxiliary",
    "agent.credential", "agent.title_generator", "agent.moa_loop",
)
TUNING = r"(?i)\b(?:Disabling|Scaling|Capping)\s+openai-codex\b[^\n]*(?:TTFB|watchdog)"
OBSERVATION = (
    r"(?i)^API call #\d+:|^Turn ended: reason=(?:completed|success|stop)\b|^shell hook registered:"
    r"|\bTool\s+\S+\s+completed|^Web search via local-web-router:|^\[MEMORY\] rss=|Registered /\w+ command"
)
PREDICTED = "Copilot token exchange degraded"

# --- redaction and templates ------------------------------------------------
SECRETS = (
    r"\bsk-[A-Za-z0-9_-]{8,}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    r"(?i)\bBearer\s+[A-Za-z0-9._-]{15,}\b",
)
KEYED_SECRET = r"(?i)\b(api[_-]?key|token|secret|password)\s*[:=]\s*['\"]?[^'\"\s,;]+"
URL_MARK = "\ue000"
URL = r"(?i)\b[a-z][a-z0-9+.-]*://[^\s'\"<>]+"
LEADING_STAMP = r"^\s*" + STAMP + r"\s*"
WINDOWS_PATH = r"\b[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]+"
WINDOWS_DIRECTORY = r"\b[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)+([^\\/:*?\"<>|\r\n]+)"
POSIX_PATH = r"(^|[^:])(/(?:[^/\s'\"<>|]+/)*[^/\s'\"<>|]+)"
POSIX_DIRECTORY = r"(^|[^:])/(?:[^/\s'\"<>|]+/)+([^/\s'\"<>|]+)"
SCHEDULED_RUN = r"\[(cron_[A-Za-z0-9_-]+)_\d{8}_\d{6}\]"
COOLDOWN_EXPIRY = r"(Subsequent auxiliary calls will skip it until )\d\d:\d\d:\d\d"
SESSION_TAG = r"\[\d{8}_\d{6}_[0-9a-fA-F]+\]"
SESSION_KEY = (
    r"(?i)\b((?:session|conversation|trace|span|request|run)[_-]?id\s*)[:=]\s*['\"]?[A-Za-z0-9_.:-]{8,}\b"
)
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
LONG_HEX = r"\b(?:0x[0-9a-fA-F]{6,}|[0-9a-fA-F]{16,})\b"
ISO_ANYWHERE = r"\b" + STAMP + r"\b"
SYSLOG_STAMP = r"\b[A-Z][a-z]{2}\s+\d{1,2}\s+\d\d:\d\d:\d\d\b"
DURATION = (
    r"(?i)\b(?:\d+(?:\.\d+)?\s*(?:ms|msec|s|sec|secs|seconds|m|min|mins|minutes|h|hr|hrs|hours)"
    r"|in\s+\d+(?:\.\d+)?s|after\s+\d+\s+chunks?)\b"
)
TOKEN_COUNT = r"(?i)\b\d[\d,]*(?:\s+(?:request|response|input|output|total))?\s+tokens?\b"
CHAR_COUNT = r"(?i)\b\d[\d,]*\s+chars?\b"
PROCESS_ID = r"\b((?:pid|PID|process id|ProcessId)\s*[:=]?\s*)\d+\b"
ATTEMPT_COUNT = r"(?i)\battempt\s+\d+(?:\s*/\s*\d+|\s+of\s+\d+)?"
IDENTITY_PREFIX = r"^\s*(?:DEBUG|INFO|WARNING|ERROR|CRITICAL)\s+(?:\[[^\]]+\]\s+)?[\w.]+:\s*"

# --- review -----------------------------------------------------------------
QUOTED_SPAN = r"\"[^\"]*\"|'[^']*'"
SERIOUS = (
    ("database corruption", r"(?i)database disk image is malformed|database\s+corrupt(?:ed|ion)|disk I/O error"),
    ("fatal exception", r"(?i)\bfatal(?:\s+unhandled\s+exception|\s+error)\b"),
)
ADAPTER_RECONNECT = (
    r"(?i)fatal\s+\S+\s+adapter error|discord_websocket_health_stale|telegram_network_error"
    r"|websocket health check failed|rebuilding the adapter"
)
HEALTH_PROFILE = r"^[a-z0-9-]*(?:health-monitor|system-health)\z"
HEALTH_EVENTS = ("platform.adapter_failed", "platform.send_failed", "platform.disconnected")
REPORT_SECTIONS = (
    ("Observed Impact", r"(?i)\b(?:observed\s+impact|impact)\b"),
    ("Timeline / Evidence", r"(?i)\b(?:timeline\s+and\s+evidence|timeline|evidence)\b"),
    ("Facts vs Hypotheses", r"(?i)\b(?:facts\s+versus\s+hypotheses|facts\s+vs\s+hypotheses|facts)\b"),
    ("Checks and Results", r"(?i)\b(?:checks\s+and\s+results|checks)\b"),
    ("Root Cause", r"(?i)\broot\s+cause\b"),
    ("Proposed Fix", r"(?i)\b(?:precise\s+proposed\s+fix|proposed\s+fix|fix)\b"),
    ("Risks and Prerequisites", r"(?i)\b(?:risks\s+and\s+prerequisites|risks|prerequisites)\b"),
    ("Rollback", r"(?i)\brollback\b"),
    ("Post-Repair Verification", r"(?i)\b(?:post-repair\s+verification|verification)\b"),
)
INCONCLUSIVE = r"(?i)undetermined|inconclusive|not established"
DIAGNOSED = r"(?i)root cause[^\n]*(?:established|identified)|mechanism[^\n]*established"
RELATION_HEDGE = (
    r"(?i)not (?:the |a )?(?:same|duplicate|shared)|different mechanism|unrelated|hypothes[ie]s|possibly|might be"
)
RELATION_CLAIM = r"(?i)(?:same mechanism|same (?:diagnosed )?problem|duplicate|shared with sibling)"

# --- other fixed values -----------------------------------------------------
JOURNAL_FIELDS = (
    "MESSAGE", "PRIORITY", "__REALTIME_TIMESTAMP", "__CURSOR",
    "_SYSTEMD_UNIT", "_SYSTEMD_USER_UNIT", "SYSLOG_IDENTIFIER",
    "_COMM", "_EXE", "_CMDLINE", "_PID", "_UID", "_GID", "_HOSTNAME",
    "_BOOT_ID", "CODE_FILE", "CODE_LINE", "CODE_FUNC", "ERRNO",
    "RESULT", "UNIT", "USER_UNIT", "INVOCATION_ID", "SYSLOG_FACILITY",
)
LOG_KINDS = ("agent.log", "errors.log", "gateway.log")
SEVERITY_RANK = (("needs-attention", 0), ("watch", 1), ("tracked", 2), ("ignore", 3))
DOMAINS = (
    ("api", "llm"), ("tool", "tool"), ("platform", "platform"), ("git", "vcs"), ("database", "storage"),
    ("security", "security"), ("search", "search"), ("service", "system"), ("system", "system"),
    ("process", "system"), ("network", "network"), ("runtime", "runtime"),
)
FUNCTION_SLOTS = (
    ("agent.conversation_loop", "main"), ("agent.chat_completion", "main"), ("agent.auxiliary", "aux"),
    ("agent.title_generator", "title"), ("agent.moa_loop", "moa"), ("agent.credential", "credential"),
    ("tools.approval", "approvals"), ("agent.tool_executor", "tool"), ("cli.plugins", "plugin"),
)
REPAIR_TRANSITIONS = (
    ("open", "repair assigned"), ("open", "deferred"), ("open", "won't fix"),
    ("repair assigned", "repairing"), ("repair assigned", "deferred"), ("repair assigned", "won't fix"),
    ("repairing", "fixed"), ("repairing", "open"), ("repairing", "deferred"), ("repairing", "won't fix"),
    ("fixed", "verified by owner"), ("fixed", "open"),
    ("verified by owner", "open"),
    ("deferred", "open"), ("deferred", "repair assigned"),
    ("won't fix", "open"),
)
