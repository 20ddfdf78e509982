"""Table schemas and the fixed vocabularies of the data model."""

from pyspark.sql import types as T

# Source aliases -> stored code (exact case).
SOURCE_ALIASES = {
    "TERM": "TERM", "terminal": "TERM",
    "IDE": "IDE", "editor": "IDE",
    "GIT": "GIT", "git": "GIT",
    "FS": "FS", "file_system": "FS",
    "NOTE": "NOTE", "manual": "NOTE",
    "MCP": "MCP", "mcp": "MCP",
}

# Stored code -> JSON name.
SOURCE_NAMES = {
    "TERM": "terminal",
    "IDE": "editor",
    "GIT": "git",
    "FS": "file_system",
    "NOTE": "manual",
    "MCP": "mcp",
}

PERMANENT_SOURCES = ("NOTE", "MCP")
TASK_STATUSES = ("active", "paused", "completed", "abandoned")

# Limits of the read API (default, low, high).
RECENT_LIMIT = (20, 1, 200)
SEARCH_LIMIT = (20, 1, 200)
SNIPPET_LIMIT = (5, 1, 50)
SESSIONS_LIMIT = (2, 1, 20)
NOTES_LIMIT = (20, 1, 200)
TASK_LIST_LIMIT = 50
RETENTION_DAYS = (30, 1, 365)
CARD_MAX_EVENTS = 200
FEED_SIZE = 200


def clamp(value, bounds):
    """Apply a (default, low, high) bound to an optional number."""
    default, low, high = bounds
    return min(max(default if value is None else int(value), low), high)


INGEST_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("metadata", T.StringType()),
    T.StructField("cwd", T.StringType()),
    T.StructField("git_repo", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("was_redacted", T.BooleanType()),
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("metadata", T.StringType()),
    T.StructField("was_redacted", T.BooleanType()),
    T.StructField("cwd", T.StringType()),
    T.StructField("git_repo", T.StringType()),
    T.StructField("task_id", T.StringType()),
])
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

TASK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("stopped_at", T.TimestampType()),
    T.StructField("status", T.StringType(), False),
    T.StructField("summary", T.StringType()),
    T.StructField("git_repo", T.StringType()),
    T.StructField("event_count", T.IntegerType()),
])
TASK_COLUMNS = TASK_SCHEMA.fieldNames()

COMMAND_TYPE = T.StructType([
    T.StructField("cmd", T.StringType()),
    T.StructField("exit_code", T.IntegerType()),
])

CARD_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("goal", T.StringType()),
    T.StructField("duration_secs", T.LongType()),
    T.StructField("files_touched", T.ArrayType(T.StringType())),
    T.StructField("commands_verified", T.ArrayType(COMMAND_TYPE)),
    T.StructField("decisions", T.ArrayType(T.StringType())),
    T.StructField("result", T.StringType()),
    T.StructField("token_estimate", T.LongType()),
])

ACTION_SCHEMA = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])
