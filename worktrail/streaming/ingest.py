"""Streaming ingest: clean, validate, store and index each micro-batch.

Delivery is at-least-once from the checkpoint. What a micro-batch inserts is one
part of the store and one segment of the index, named after the stream and the
batch, so a replayed micro-batch changes nothing and no event is lost. The cost of
a batch follows the batch: ids are looked up in the ledger, the index gets only the
rows just inserted, and parts are merged by levels.
"""

from pyspark.sql import functions as F

from worktrail.sources import events as src
from worktrail.sources.textstore import TextStore

# Flush interval of the micro-batches.
FLUSH = "500 milliseconds"


def batch_scope(batch, batch_id):
    """A name for this micro-batch of this stream: the query id is kept in the checkpoint."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{query}-{batch_id}"


def ingest_batch(store, index=None, quarantine=True):
    """The ``foreachBatch`` function for a stream of ingest requests."""
    def apply(batch, batch_id):
        spark, part = batch.sparkSession, batch_scope(batch, batch_id)
        arrived = batch.withColumn("arrival", F.monotonically_increasing_id())
        valid, rejected = src.split_requests(arrived)
        events = src.to_events(valid, scope=part, keep=("arrival",)).persist()
        # Of offers of one id the first to arrive counts.
        store.append(events, part, order=("arrival",))
        events.unpersist()
        if quarantine:
            rejected.drop("arrival").write.mode("overwrite").parquet(
                f"{store.root}/quarantine/batch_id={batch_id}")
        if index is not None:
            index.add(store.read_part(spark, part), part, fresh=True)
            index.merge(spark)
        store.compact(spark)
    return apply


def start_ingest(requests, store, checkpoint, index_path=None, drain=False):
    """Run until stopped, or until the present input is stored when draining."""
    index = TextStore(index_path) if index_path else None
    writer = (requests.writeStream.foreachBatch(ingest_batch(store, index))
              .option("checkpointLocation", checkpoint))
    trigger = {"availableNow": True} if drain else {"processingTime": FLUSH}
    return writer.trigger(**trigger).start()


def tail(requests, scope="load"):
    """Live feed: each valid, cleaned event as one JSON line."""
    valid, _ = src.split_requests(requests)
    events = src.to_events(valid, scope)
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def start_tail(requests, path, checkpoint, drain=False):
    """Write the feed of each micro-batch to its own folder; a replay replaces it."""
    def write(batch, batch_id):
        tail(batch, batch_scope(batch, batch_id)).write.mode("overwrite").text(
            f"{path}/batch_id={batch_id}")

    trigger = {"availableNow": True} if drain else {"processingTime": FLUSH}
    return (requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())
