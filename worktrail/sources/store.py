"""The event store: Parquet parts by event date, and a ledger of the ids they hold.

A write adds part folders and commits them to the manifest in one step, so a
replayed or interrupted write changes nothing. Insert-if-absent asks the ledger,
not the events: ids are dealt into hash buckets, a batch reads the few small parts
written last and of the merged ones only its own buckets. Parts are merged by
levels, so their number grows with the logarithm of the history.
"""

import os
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import functions as F
from pyspark.sql import types as T

from worktrail import schema as S
from worktrail.functions import times
from worktrail.operators import dedup, retention
from worktrail.operators.tasks import update_summaries
from worktrail.sources.manifest import Entry, Manifest, due, read_parts

STORED_SCHEMA = T.StructType(
    [T.StructField(f.name, f.dataType) for f in S.EVENT_SCHEMA.fields]
    + [T.StructField("event_date", T.DateType())])
#: ``here`` is false where retention removed the id; the largest ``seq`` of an id holds.
LEDGER_SCHEMA = "id string, seq bigint, here boolean, id_bucket int"
ID_BUCKETS = 64
FANOUT = 8


def id_bucket(c):
    return F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS)).cast("int")


@dataclass(frozen=True)
class EventStore:
    """Tables under one shared folder; every write may be repeated safely."""

    root: str

    @cached_property
    def manifest(self):
        return Manifest(self.root)

    @property
    def events_path(self):
        return f"{self.root}/events"

    def _folder(self, entry):
        return f"{self.events_path}/part={entry.part}/event_date={entry.day}"

    def _events(self, spark, entries):
        df = read_parts(spark, STORED_SCHEMA, [self._folder(e) for e in entries], self.events_path)
        return df.drop("part")

    def read(self, spark):
        return self._events(spark, self.manifest.live(spark, "events"))

    def read_part(self, spark, part):
        """The events that one write has inserted and that no merge has moved since."""
        return self._events(spark, [e for e in self.manifest.live(spark, "events") if e.part == part])

    # --- ids ---

    def _ledger(self, spark, entries, buckets=None):
        def parts(of):
            paths = [f"{self.root}/ids/part={e.part}" for e in of]
            return read_parts(spark, LEDGER_SCHEMA, paths, f"{self.root}/ids").drop("part")

        new, merged = parts([e for e in entries if not e.level]), parts([e for e in entries if e.level])
        if buckets is not None:
            merged = merged.filter(F.col("id_bucket").isin(buckets))
        return new.unionByName(merged)

    def known_ids(self, spark, ids):
        """Those of ``ids`` (id) that the store holds."""
        entries = self.manifest.live(spark, "ids")
        buckets = None
        if any(e.level for e in entries):
            buckets = [r[0] for r in ids.select(id_bucket("id")).distinct().collect()]  # at most ID_BUCKETS
        found = self._ledger(spark, entries, buckets).join(ids, "id", "left_semi")
        return found.groupBy("id").agg(F.max_by("here", "seq").alias("here")).filter("here").select("id")

    def _write_ids(self, ids, part, here, seq):
        (ids.select("id", F.lit(seq).cast("bigint").alias("seq"), F.lit(here).alias("here"),
                    id_bucket("id").alias("id_bucket"))
         .hint("rebalance").sortWithinPartitions("id_bucket", "id")
         .write.mode("overwrite").parquet(f"{self.root}/ids/part={part}"))
        return Entry("ids", part)

    # --- writes ---

    def append(self, batch, part=None, order=("timestamp",)):
        """Insert-if-absent; of the batch's own copies the first in ``order`` counts.

        A ``part`` written before is left as it is.
        """
        spark = batch.sparkSession
        part = part or f"append-{os.urandom(8).hex()}"
        version, live = self.manifest.newest(spark)
        if any(e.kind == "ids" and e.part == part for e in live):
            return
        known = self.known_ids(spark, batch.select("id"))
        fresh = dedup.first_offers(batch.join(known, "id", "left_anti"), order)
        entries = self._write_events(spark, fresh, part)
        own = self._events(spark, entries).select("id")
        self.manifest.commit(spark, [*entries, self._write_ids(own, part, True, version + 1)])

    def _write_events(self, spark, events, part, level=0):
        """Write a part; its entries, one per day."""
        write_events(events, f"{self.events_path}/part={part}")
        files = spark.read.schema(STORED_SCHEMA).parquet(f"{self.events_path}/part={part}").inputFiles()
        days = sorted({m[1] for n in files if (m := re.search(r"/event_date=([^/]+)/", n))})
        return [Entry("events", part, day, level) for day in days]

    def compact(self, spark, fanout=FANOUT):
        """Merge the days and ids of which many parts of one level are there."""
        for kind in ("events", "ids"):
            version, live = self.manifest.newest(spark)
            own, new = [e for e in live if e.kind == kind], f"merged-{version + 1}-{kind}"
            if kind == "ids":
                old = due(own, fanout)
                if old:
                    whole = max(e.level for e in own) <= old[0].level
                    self.manifest.commit(spark, [self._merge_ids(spark, old, new, whole)], old)
                continue
            by_day = {}
            for e in own:
                by_day.setdefault(e.day, []).append(e)
            old = [e for same in by_day.values() for e in due(same, fanout)]
            if old:
                made = self._write_events(spark, self._events(spark, old), new)
                level = {e.day: e.level + 1 for e in old}
                made = [Entry("events", e.part, e.day, level[e.day]) for e in made]
                self.manifest.commit(spark, made, old)

    def _merge_ids(self, spark, old, new, whole):
        newest = self._ledger(spark, old).groupBy("id", "id_bucket").agg(
            F.max("seq").alias("seq"), F.max_by("here", "seq").alias("here"))
        if whole:  # nothing older is left that a removal would have to hide
            newest = newest.filter("here")
        (newest.hint("rebalance", "id_bucket").sortWithinPartitions("id_bucket", "id")
         .write.mode("overwrite").partitionBy("id_bucket").parquet(f"{self.root}/ids/part={new}"))
        return Entry("ids", new, None, old[0].level + 1)

    def prune(self, spark, now, days=None):
        """Drop expired events, rewriting only the days that hold some.

        ``now`` is a timestamp column without row references. Only parts that were
        read are replaced: events appended meanwhile stay.
        """
        version, live = self.manifest.newest(spark)
        entries = [e for e in live if e.kind == "events"]
        gone = retention.expired(now, days)
        old = F.col("event_date") <= times.utc_date(retention.cutoff(now, days))
        events = self._events(spark, entries).filter(old)
        per_day = (events.groupBy("event_date").agg(F.count_if(gone).alias("gone"))
                   .filter(F.col("gone") > 0).collect())  # one row per day
        if not per_day:
            return 0
        touched = {str(r["event_date"]) for r in per_day}
        replaced = [e for e in entries if e.day in touched]
        part, chosen = f"pruned-{version + 1}", self._events(spark, replaced)
        made = self._write_events(spark, chosen.filter(~gone), part)
        made.append(self._write_ids(chosen.filter(gone).select("id"), part, False, version + 1))
        self.manifest.commit(spark, made, replaced)
        return sum(r["gone"] for r in per_day)


def write_events(events, path):
    """Write by day, sorted by time inside the files for row-group pruning."""
    (events.select(*S.EVENT_COLUMNS)
     .withColumn("event_date", times.utc_date(F.col("timestamp")))
     .hint("rebalance", F.col("event_date"))
     .sortWithinPartitions("event_date", "timestamp")
     .write.mode("overwrite").partitionBy("event_date").parquet(path))


def update_task_summaries(spark, path, cards, out):
    """Write the task table with new summaries as the next version at ``out``."""
    update_summaries(spark.read.parquet(path), cards).write.mode("overwrite").parquet(out)
