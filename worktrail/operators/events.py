"""Event timeline: filters, counts, paging, reference checks."""

from dataclasses import dataclass, replace
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import functions as F

from worktrail import schema as S
from worktrail.functions import text
from worktrail.operators.ranking import salted_lookup


@dataclass(frozen=True)
class EventFilter:
    """Optional predicates; bounds on time are inclusive."""

    source: str | None = None
    git_repo: str | None = None
    task_id: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    limit: int | None = None
    offset: int | None = None

    def with_limit(self, limit):
        return replace(self, limit=limit)

    @property
    def resolved_limit(self):
        return S.clamp(self.limit, S.RECENT_LIMIT)

    @property
    def resolved_offset(self):
        return max(self.offset or 0, 0)

    def predicates(self, partitioned=False):
        """Conjuncts; ``partitioned`` adds the date bounds that prune files."""
        out = []
        for name in ("source", "git_repo", "task_id"):
            wanted = getattr(self, name)
            if wanted is not None:
                out.append(F.col(name) == wanted)
        if self.since is not None:
            since = utc(self.since)
            out.append(F.col("timestamp") >= F.lit(since.isoformat()).cast("timestamp"))
            if partitioned:
                out.append(F.col("event_date") >= F.lit(since.date()))
        if self.until is not None:
            until = utc(self.until)
            out.append(F.col("timestamp") <= F.lit(until.isoformat()).cast("timestamp"))
            if partitioned:
                out.append(F.col("event_date") <= F.lit(until.date()))
        return out


def utc(at):
    """A bound in UTC; one without a zone is read as UTC."""
    return at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)


def newest_first(ts="timestamp", tie="id"):
    return [F.desc(ts), F.asc(tie)]


def apply_filter(events, flt):
    preds = flt.predicates(partitioned="event_date" in events.columns)
    return events.filter(reduce(lambda a, b: a & b, preds)) if preds else events


def recent(events, flt=EventFilter()):
    """Filtered, newest first, one page (a top-k, never a full sort)."""
    page = apply_filter(events, flt).orderBy(*newest_first())
    if flt.resolved_offset:
        page = page.offset(flt.resolved_offset)
    return page.limit(flt.resolved_limit)


def count_events(events, flt=EventFilter()):
    return apply_filter(events, flt).agg(F.count("*").alias("n_events"))


def permanent_notes(events):
    return events.filter(F.col("source").isin(*S.PERMANENT_SOURCES))


def notes(events, limit=None):
    return (permanent_notes(events).orderBy(*newest_first())
            .limit(S.clamp(limit, S.NOTES_LIMIT)))


def counts_by(events, *keys):
    return events.groupBy(*keys).agg(F.count("*").alias("n_events"))


def task_event_counts(events):
    return counts_by(events.filter(F.col("task_id").isNotNull()), "task_id")


def orphan_task_refs(events, tasks):
    """Events that name a task which does not exist."""
    known = tasks.select(F.col("id").alias("task_id"))
    refs = events.filter(F.col("task_id").isNotNull()).select("id", "task_id")
    return salted_lookup(refs, known, ["task_id"], salt_on=["id"], how="left_anti").select(
        "id", "task_id")


def detach_orphans(events, tasks):
    """Set-null for references to missing tasks."""
    known = tasks.select(F.col("id").alias("task_id"), F.lit(True).alias("__known"))
    return (salted_lookup(events, known, ["task_id"], salt_on=["id"], how="left")
            .withColumn("task_id", F.when(F.col("__known"), F.col("task_id")))
            .select(*events.columns))


def to_json_rows(events):
    """One JSON object per event: the source by name, metadata as JSON, nulls kept."""
    named = events.withColumn("source", text.source_name(F.col("source"))).withColumn(
        "metadata", F.try_parse_json("metadata"))
    return named.select("id", F.to_json(
        F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("json"))
