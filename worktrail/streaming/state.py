"""Stateful streams: burst debounce, running counts, task lifecycle.

State lies in Spark's own state store. A micro-batch writes the groups that it has
changed or closed to its own folder, so its cost follows the batch; a replayed
micro-batch replaces that folder. Of a group changed many times the newest row counts.
"""

from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from worktrail.operators import capture, tasks


def _write(df, path, batch_id):
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _read(spark, path, schema):
    """All rows written, with ``batch_id``; none where nothing is written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("batch_id", F.lit(0))


def _run(stream, write, mode, checkpoint, drain):
    trigger = {"availableNow": True} if drain else {"processingTime": "500 milliseconds"}
    return (stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def newest(spark, path, schema, keys):
    """The newest row of each group, from what all micro-batches wrote."""
    rows = _read(spark, path, schema)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("__last"))
            .select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest]))


# --- debounce ----------------------------------------------------------------------

def _bursts(events, keys, delay_ms):
    """The last event of each burst, as a session that ``delay_ms`` without events ends."""
    order = ["timestamp", "id"]
    rest = [c for c in events.columns if c not in order]
    last = F.max(F.struct(*order, *rest)).alias("last")
    window = F.session_window("timestamp", f"{delay_ms} milliseconds").alias("burst")
    return events.groupBy(window, *keys).agg(last).select(
        *[F.col(f"last.{c}").alias(c) for c in events.columns])


def watermark_of(spark, checkpoint, batch_id):
    """The watermark that the engine has recorded for a micro-batch, in milliseconds."""
    plan = spark.read.text(f"{checkpoint}/offsets/{batch_id}")
    at = F.get_json_object("value", "$.batchWatermarkMs").cast("bigint")
    return plan.agg(F.max(at)).first()[0] or 0


def start_debounce(events, keys, delay_ms, lateness_ms, path, checkpoint, drain=False):
    """Write the last event of each burst to ``path``/bursts once the watermark has passed it.

    Bursts are session windows in Spark's state. Events whose own window ends before
    the watermark can join none any more and go to ``path``/late. ``flush_debounce``
    gives the bursts that are still open at the end of the input.
    """
    marked = events.withWatermark("timestamp", f"{lateness_ms} milliseconds")
    closed = _bursts(marked, keys, delay_ms).withColumn("__read", F.lit(False))
    both = closed.unionByName(marked.withColumn("__read", F.lit(True)))

    def write(batch, batch_id):
        batch.persist()
        ends = F.unix_millis("timestamp") + F.lit(delay_ms)
        late = F.col("__read") & (ends <= F.lit(watermark_of(batch.sparkSession, checkpoint, batch_id)))
        _write(batch.filter(~F.col("__read")).select(events.columns), f"{path}/bursts", batch_id)
        _write(batch.filter(late).select(events.columns), f"{path}/late", batch_id)
        batch.unpersist()

    return _run(both, write, "append", checkpoint, drain)


def closed_bursts(spark, path, schema):
    return _read(spark, f"{path}/bursts", schema).drop("batch_id")


def flush_debounce(spark, path, checkpoint, events, keys, delay_ms):
    """The last events of the bursts still open when the input ends, from Spark's state.

    ``events`` gives the columns; it is not read.
    """
    state = spark.read.format("statestore").load(checkpoint)
    order = ["timestamp", "id"]
    rest = [c for c in events.columns if c not in order]
    value = state.schema["value"].dataType.names
    held = state.select(F.col(f"value.`{value[-1]}`").alias("last"))
    return held.select(*[F.col("last").getField(c).alias(c) for c in events.columns])


# --- counts ------------------------------------------------------------------------

def running_counts(events, *keys):
    """Counts kept with the stream; use the update or complete output mode."""
    return events.groupBy(*keys).agg(F.count("*").alias("n_events"))


def start_counts(events, keys, path, checkpoint, drain=False):
    """Write the counts that a micro-batch has changed; ``counts`` reads them all."""
    return _run(running_counts(events, *keys), lambda batch, n: _write(batch, path, n), "update",
                checkpoint, drain)


def counts(spark, path, schema, keys):
    return newest(spark, path, schema, keys)


# --- task lifecycle ----------------------------------------------------------------

ACTIONS = "task_id string, action string, ts timestamp, seq bigint"
HOURS = ("task_id string, hour timestamp, opened struct<ts:timestamp,seq:bigint>, "
         "closings array<struct<ts:timestamp,seq:bigint,action:string>>")


def start_lifecycle(actions, path, checkpoint, drain=False):
    """Keep each task's first start and closing actions per hour; ``lifecycle`` reads the states.

    Actions may come in any order and in any micro-batch, and repeated. A task's
    hours are separate groups, so a task with very many actions is spread.
    """
    at = F.struct("ts", "seq")
    closing = F.col("action").isin(*tasks.TERMINAL)
    hours = (actions.filter(closing | (F.col("action") == "start"))
             .groupBy("task_id", F.date_trunc("hour", F.col("ts")).alias("hour"))
             .agg(F.min(F.when(F.col("action") == "start", at)).alias("opened"),
                  F.collect_set(F.when(closing, F.struct("ts", "seq", "action"))).alias("closings")))
    return _run(hours, lambda batch, n: _write(batch, path, n), "update", checkpoint, drain)


def lifecycle(spark, path):
    hours = newest(spark, path, HOURS, ["task_id", "hour"])
    starts = hours.filter("opened is not null").select(
        "task_id", F.lit("start").alias("action"), "opened.ts", "opened.seq")
    ends = hours.select("task_id", F.inline("closings")).select("task_id", "action", "ts", "seq")
    return tasks.task_state(starts.unionByName(ends))
