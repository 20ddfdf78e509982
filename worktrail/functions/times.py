"""Timestamps, durations and relative times."""

from pyspark.sql import functions as F

# Accepted stored forms, tried in this order.
RFC3339_RE = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"
NAIVE_RE = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}(\.\d+)?$"


def parse_timestamp(c):
    """RFC-3339 or one of two zone-less UTC forms; anything else gives null.

    A zone-less text is read as UTC whatever the session time zone is.
    """
    naive = F.concat(F.regexp_replace(c, "T", " "), F.lit("Z"))
    return (F.when(c.rlike(RFC3339_RE), F.upper(c).try_cast("timestamp"))
            .when(c.rlike(NAIVE_RE), naive.try_cast("timestamp")))


def in_utc(ts):
    """The UTC wall clock of a timestamp, whatever the session time zone is."""
    return F.to_utc_timestamp(ts, F.current_timezone())


def utc_date(ts):
    return F.date_add(F.lit("1970-01-01").cast("date"),
                      F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def stamp(ts):
    return F.date_format(in_utc(ts), "yyyy-MM-dd HH:mm 'UTC'")


def seconds_between(start, end):
    """Whole seconds, truncated toward zero."""
    return F.timestamp_diff("SECOND", start, end)


def task_duration(started_at, stopped_at, now):
    return seconds_between(started_at, F.coalesce(stopped_at, now))


def _text(c):
    return c.cast("string")


def _div(c, n):
    return F.floor(c / F.lit(n)).cast("bigint")


def format_duration(secs):
    """``Ns``, ``Nm Ns`` or ``Nh Nm``."""
    return (F.when(secs < 60, F.concat(_text(secs), F.lit("s")))
            .when(secs < 3600, F.concat(
                _text(_div(secs, 60)), F.lit("m "), _text(secs % 60), F.lit("s")))
            .otherwise(F.concat(
                _text(_div(secs, 3600)), F.lit("h "), _text(_div(secs % 3600, 60)), F.lit("m"))))


def format_duration_short(secs):
    """``Nh Nm`` or ``Nm``."""
    minutes = F.concat(_text(_div(secs % 3600, 60)), F.lit("m"))
    return (F.when(secs.isNull(), F.lit(""))
            .when(secs >= 3600, F.concat(_text(_div(secs, 3600)), F.lit("h "), minutes))
            .otherwise(minutes))


def relative_time(ts, now, feed=False):
    """Age of ``ts``; the feed form says ``just now`` below five seconds."""
    micros = F.unix_micros(now) - F.unix_micros(ts)
    secs = _div(micros, 1_000_000)
    aged = (F.when(secs < 60, F.concat(_text(secs), F.lit("s ago")))
            .when(secs < 3600, F.concat(_text(_div(secs, 60)), F.lit("m ago")))
            .when(secs < 86400, F.concat(_text(_div(secs, 3600)), F.lit("h ago")))
            .otherwise(F.concat(_text(_div(secs, 86400)), F.lit("d ago"))))
    if feed:
        aged = F.when(secs < 5, F.lit("just now")).otherwise(aged)
    return F.when(ts.isNull(), F.lit("")).otherwise(aged)
