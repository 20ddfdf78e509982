"""Insert-if-absent by event id."""

from pyspark.sql import functions as F

from worktrail.operators.ranking import keep_first


def first_offers(batch, order=("timestamp",)):
    """Keep the first offer of each id within a batch."""
    return keep_first(batch, ["id"], order)


def stored_ids(batch_ids, stored):
    """Ids of the batch that the store already holds.

    The store's id column is probed with the batch's ids, so a small batch is
    broadcast against the scan and the store itself is not shuffled.
    """
    return stored.select("id").join(batch_ids, "id", "left_semi").distinct()


def absent_from(batch, stored):
    known = stored_ids(batch.select("id"), stored)
    return batch.join(known, "id", "left_anti")


def insert_if_absent(batch, stored, order=("timestamp",)):
    """Rows of ``batch`` to append to ``stored``."""
    return absent_from(first_offers(batch, order), stored)


def ingest_counts(batch, stored):
    """Offered, inserted and ignored row counts of one batch."""
    per_id = batch.groupBy("id").agg(F.count("*").alias("offers"))
    fresh = absent_from(per_id, stored).agg(F.count("*").alias("inserted"))
    offered = per_id.agg(F.coalesce(F.sum("offers"), F.lit(0)).alias("offered"))
    return (offered.withColumn("inserted", fresh.scalar())
            .withColumn("ignored", F.col("offered") - F.col("inserted")))
