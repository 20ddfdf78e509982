"""Tiered retention: loose events expire, notes and task events stay."""

from pyspark.sql import functions as F

from worktrail import schema as S


def cutoff(now, days=None):
    return now - F.make_dt_interval(days=F.lit(S.clamp(days, S.RETENTION_DAYS)))


def expired(now, days=None):
    return ((F.col("timestamp") < cutoff(now, days))
            & F.col("task_id").isNull()
            & ~F.col("source").isin(*S.PERMANENT_SOURCES))


def prune(events, now, days=None):
    """The surviving events."""
    return events.filter(~expired(now, days))


def prune_count(events, now, days=None):
    return events.agg(F.count_if(expired(now, days)).alias("n_pruned"))
