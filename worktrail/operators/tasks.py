"""Task sessions: lifecycle, listings, summaries in the task table."""

from pyspark.sql import functions as F

from worktrail import schema as S
from worktrail.operators.ranking import salted_lookup

# Terminal action -> resulting status. A stop ends only an active
# task, an abandon ends an active or paused one; the first to apply wins.
TERMINAL = {"stop": "completed", "abandon": "abandoned"}


def task_state(actions):
    """Lifecycle state per task from its (task_id, action, ts, seq) log.

    One aggregation: the first start opens the task and the first terminal
    action at or after it closes the task. No task's log is collected.
    """
    at = F.struct("ts", "seq")
    opened = actions.filter(F.col("action") == "start").groupBy("task_id").agg(
        F.min(at).alias("opened"))
    closing = actions.filter(F.col("action").isin(*TERMINAL))
    first_close = (
        salted_lookup(closing, opened, ["task_id"], salt_on=["ts", "seq"])
        .filter(at >= F.col("opened"))
        .groupBy("task_id")
        .agg(F.min(F.struct("ts", "seq", "action")).alias("closed"))
    )
    table = F.create_map(*[F.lit(x) for kv in TERMINAL.items() for x in kv])
    return opened.join(first_close, "task_id", "left").select(
        "task_id",
        F.col("opened.ts").alias("started_at"),
        F.col("closed.ts").alias("stopped_at"),
        F.coalesce(table[F.col("closed.action")], F.lit("active")).alias("status"),
    )


def essential_actions(actions):
    """The least part of a log that gives the same states, whatever is added later.

    Of a task: its first start, the first terminal action from then on, and the
    terminal actions before it, which count if an earlier start turns up.
    """
    at = F.struct("ts", "seq")
    known = actions.filter(F.col("action").isin("start", *TERMINAL)).distinct()
    opened = (known.filter(F.col("action") == "start").groupBy("task_id")
              .agg(F.min(at).alias("opened")))
    closing = salted_lookup(known.filter(F.col("action") != "start"), opened, ["task_id"],
                            salt_on=["ts", "seq"], how="left")
    late = closing.filter(at >= F.col("opened"))
    first = late.groupBy("task_id").agg(F.min(F.struct("ts", "seq", "action")).alias("x"))
    return (opened.select("task_id", F.lit("start").alias("action"), "opened.ts", "opened.seq")
            .unionByName(first.select("task_id", "x.action", "x.ts", "x.seq"))
            .unionByName(closing.filter(F.col("opened").isNull() | (at < F.col("opened")))
                         .select("task_id", "action", "ts", "seq")))


def start_tasks(tasks, new):
    """Append new active tasks."""
    rows = new.select(
        "id", "name", "description", "started_at",
        F.lit(None).cast("timestamp").alias("stopped_at"),
        F.lit("active").alias("status"),
        F.lit(None).cast("string").alias("summary"),
        "git_repo", F.lit(0).cast("int").alias("event_count"))
    return tasks.unionByName(rows)


def active_task(tasks):
    return (tasks.filter(F.col("status") == "active")
            .orderBy(F.desc("started_at"), "id").limit(1))


def completed_sessions(tasks, limit=None):
    return (tasks.filter(F.col("status") == "completed")
            .orderBy(F.desc("stopped_at"), "id").limit(S.clamp(limit, S.SESSIONS_LIMIT)))


def task_list(tasks, limit=S.TASK_LIST_LIMIT):
    return tasks.orderBy(F.desc("started_at"), "id").limit(limit)


def latest_session(tasks, by="stopped_at"):
    """Newest completed task by stop time, or by start time."""
    return (tasks.filter(F.col("status") == "completed")
            .orderBy(F.desc(by), "id").limit(1))


def task_by_id(tasks, task_id):
    return tasks.filter(F.col("id") == task_id)


def update_summaries(tasks, cards):
    """Write (task_id, summary) pairs; unknown ids change nothing."""
    new = cards.select(F.col("task_id").alias("id"), F.col("summary").alias("__new"))
    return (tasks.join(new, "id", "left")
            .withColumn("summary", F.coalesce("__new", "summary"))
            .select(*tasks.columns))


def status_report(events, tasks):
    """One row: stored events and the newest active task."""
    total = events.agg(F.count("*").alias("n"))
    pick = F.max_by(F.struct("id", "name", "started_at"),
                    F.when(F.col("status") == "active", F.struct("started_at", "id")))
    active = tasks.agg(pick.alias("t"))
    return active.select(
        F.coalesce(total.scalar(), F.lit(0)).alias("total_events"),
        F.col("t.id").alias("active_task_id"),
        F.col("t.name").alias("active_task_name"),
        F.col("t.started_at").alias("active_started_at"))
