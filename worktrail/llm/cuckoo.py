"""Exact duplicates through a cuckoo-filter index of live digests.

A document's address is the SHA-256 of its text. The index is dealt by address
into shards; a shard keeps a cuckoo filter (four 16-bit marks per bucket, two
buckets per address) and the hashes of its live addresses. What the filter does
not know is new and needs no lookup. What it seems to know is looked up in the
content, which is dealt into buckets by shard and address and sorted by them: an
equal text makes a copy, anything else is a false alarm and becomes live itself. An address leaves the filter when its last
document is deleted. A filter that overflows is built again, twice as large, from
the stored hashes.

Rows that hold one text are counted per salt before they are shuffled, so a text
of which there are millions of copies reaches the filter as at most ``SALTS``
rows, and its rows are joined to their group in as many tasks. Content is written
once per distinct text. Every step is a table in the shared folder; an index is a
value, an operation returns the next one and leaves the former as it was.

Null texts count as empty; empty texts are equal to each other. Texts of any
length are compared whole. Of equal texts the row with the largest id stays, null
ids are the smallest, and of rows that repeat an id the one read last. An empty
table gives an empty result. Other columns are not read. Two texts of the same
SHA-256, 64-bit hash and length would stop the job with an error.
"""

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worktrail.llm.common import numbered, stored

SHARD_ROWS = 4096
SALTS = 64
SLOTS, FIRST_BUCKETS, KICKS = 4, 64, 200
KEY = ["shard", "address", "mix", "size"]


class Filter:
    """Marks in buckets; all operations take arrays of unsigned 64-bit hashes."""

    def __init__(self, slots=None):
        self.slots = np.zeros((FIRST_BUCKETS, SLOTS), np.uint16) if slots is None else slots

    def places(self, h):
        mask = np.uint64(len(self.slots) - 1)
        mark = np.maximum(h >> np.uint64(48), np.uint64(1))
        here = h & mask
        return mark.astype(np.uint16), here.astype(np.int64), self.other(here, mark)

    def other(self, bucket, mark):
        mask = np.uint64(len(self.slots) - 1)
        step = (mark.astype(np.uint64) * np.uint64(0x9E3779B1)) & mask
        return (bucket.astype(np.uint64) ^ step).astype(np.int64)

    def has(self, h):
        mark, a, b = self.places(h)
        return ((self.slots[a] == mark[:, None]) | (self.slots[b] == mark[:, None])).any(1)

    def hits(self, h):
        """What a lookup before each insertion, one after another, would say."""
        mark, a, b = self.places(h)
        pair = np.minimum(a, b) << 16 | mark
        hit = np.ones(len(h), bool)
        hit[np.unique(pair, return_index=True)[1]] = False
        return hit | self.has(h)

    def add(self, h):
        """False if some mark finds no room; the filter must then be built anew."""
        rng = np.random.default_rng(len(h))
        mark, at, _ = self.places(h)
        for _ in range(KICKS):
            if not len(mark):
                return True
            mark, at = self._fill(mark, at)
            if len(mark):
                mark, at = self._fill(mark, self.other(at, mark))
            if len(mark):
                # One mark per full bucket changes places with one that lies there.
                first = np.unique(at, return_index=True)[1]
                slot = rng.integers(0, SLOTS, len(first))
                out = self.slots[at[first], slot]
                self.slots[at[first], slot] = mark[first]
                mark[first], at[first] = out, self.other(at[first], out)
        return not len(mark)

    def _fill(self, mark, at):
        """Put marks into free slots of their buckets; returns those left over."""
        order = np.argsort(at, kind="stable")
        mark, at = mark[order], at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        taken = self.slots[at] != 0
        free = place < SLOTS - taken.sum(1)
        slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(at)), np.minimum(place, SLOTS - 1)]
        self.slots[at[free], slot[free]] = mark[free]
        return mark[~free], at[~free]

    def drop(self, h):
        """Take one mark out for each hash; all of them must have been added."""
        while len(h):
            mark, a, b = self.places(h)
            both = np.concatenate([a[:, None] * SLOTS + np.arange(SLOTS),
                                   b[:, None] * SLOTS + np.arange(SLOTS)], 1)
            same = self.slots.reshape(-1)[both] == mark[:, None]
            spot = both[np.arange(len(h)), same.argmax(1)]
            spot, first = np.unique(spot, return_index=True)
            self.slots.reshape(-1)[spot] = 0
            h = np.delete(h, first)


def rebuilt(keys, buckets):
    """A filter of all keys with at least so many buckets."""
    while True:
        made = Filter(np.zeros((buckets, SLOTS), np.uint16))
        if made.add(keys):
            return made
        buckets *= 2


class Shard:
    """One shard's filter with the hashes of its live addresses."""

    def __init__(self, state):
        if state.num_rows:
            row = state.slice(0, 1).to_pylist()[0]
            self.filter = Filter(np.frombuffer(row["slots"], np.uint16).reshape(-1, SLOTS).copy())
            self.keys = np.frombuffer(row["keys"], np.uint64)
        else:
            self.filter, self.keys = Filter(), np.zeros(0, np.uint64)

    def add(self, h):
        self.keys = np.concatenate([self.keys, h])
        if not self.filter.add(h):
            self.filter = rebuilt(self.keys, 2 * len(self.filter.slots))

    def drop(self, h):
        self.filter.drop(h)
        self.keys = np.setdiff1d(self.keys, h)

    def row(self, shard, schema):
        own = {"shard": shard, "slots": self.filter.slots.tobytes(), "keys": self.keys.tobytes()}
        return pa.Table.from_pylist([own], schema=schema)


STATE = "shard bigint, slots binary, keys binary"


def _hashes(table):
    return table["h"].to_numpy().view(np.uint64)


def _probe(key, offers, state):
    """The offers with ``hit``, and the shard's next state as one more row."""
    shard = Shard(state)
    hit = np.zeros(0, bool)
    if offers.num_rows:
        h = _hashes(offers)
        hit = shard.filter.hits(h)
        shard.add(h[~hit])
    none = [pa.nulls(len(hit), pa.binary())] * 2
    told = offers.append_column("hit", pa.array(hit, pa.bool_()))
    for name, column in zip(("slots", "keys"), none, strict=True):
        told = told.append_column(name, column)
    return pa.concat_tables([told, shard.row(key[0].as_py(), told.schema)])


def _changed(method):
    def run(key, rows, state):
        shard = Shard(state)
        if rows.num_rows:
            getattr(shard, method)(_hashes(rows))
        return shard.row(key[0].as_py(), pa.schema(
            [("shard", pa.int64()), ("slots", pa.binary()), ("keys", pa.binary())]))
    return run


@dataclass(frozen=True)
class Index:
    """members, filters, content and tombs are tables in the shared folder."""

    shards: int
    batch: int
    members: DataFrame
    filters: DataFrame
    content: DataFrame
    tombs: DataFrame


def empty(spark, shards, id_type="bigint"):
    """An index without documents, dealt into ``shards``; filters grow as they fill."""
    frame = lambda schema: spark.createDataFrame([], schema)
    key = "shard bigint, address string, mix bigint, size bigint"
    return Index(shards, 0, frame(f"batch int, row bigint, doc_id {id_type}, {key}, salt int, shared boolean"),
                 frame(STATE), frame(f"batch int, {key}, text string"),
                 frame("address string, until int"))


def digest_of(text):
    return F.sha2(text, 256)


def _keyed(docs, shards, address):
    text = F.coalesce("text", F.lit(""))
    own = address(text)
    return docs.select(
        "doc_id", F.pmod(F.xxhash64(F.lit("shard"), own), F.lit(shards)).alias("shard"),
        own.alias("address"), F.xxhash64(text).alias("mix"),
        F.octet_length(text).cast("bigint").alias("size"), text.alias("text"))


def _next_filters(index, rows, method):
    out = (rows.groupBy("shard").cogroup(index.filters.groupBy("shard"))
           .applyInArrow(_changed(method), STATE))
    return stored(out, "filters")


def insert(index, docs, address=digest_of):
    """The index with all rows of ``docs`` (doc_id, text)."""
    batch = index.batch + 1
    keyed = _keyed(docs, index.shards, address)
    new = stored(numbered(keyed.drop("text"), "row").withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")), "offered")
    offers = (new.groupBy(*KEY, "salt").agg(F.count("*").alias("n"))
              .withColumn("h", F.xxhash64("address")))
    probed = stored(offers.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(
        _probe, "shard bigint, address string, mix bigint, size bigint, salt int, n bigint, "
                "h bigint, hit boolean, slots binary, keys binary"), "probed")
    filters = probed.filter("slots is not null").select("shard", "slots", "keys")
    # Any row of an address that the filter missed shows that the address was new.
    same = Window.partitionBy("address")
    told = probed.filter("address is not null").select(
        *KEY, "salt", "h", F.bool_and("hit").over(same).alias("old"),
        F.sum("n").over(same).alias("n"))
    told = stored(told.withColumn("shared", F.col("old") | (F.col("n") > 1)), "told")

    distinct = keyed.select(*KEY, "text").groupBy(*KEY, "text").agg(F.lit(batch).alias("batch"))
    if index.batch:
        live = index.content.join(index.tombs, (
            index.content["address"] == index.tombs["address"])
            & (index.content["batch"] <= index.tombs["until"]), "left_anti")
        hits = told.filter("old").select("address").distinct().withColumn("old", F.lit(True))
        kept = live.join(hits, "address", "left_semi").select(*KEY, F.col("text").alias("there"))
        met = distinct.join(hits, "address", "left").join(kept, KEY, "left")
        other = F.raise_error(F.lit("two texts of one digest, hash and length"))
        distinct = (met.withColumn("known", F.when(F.col("there") == F.col("text"), True)
                                   .when(F.col("there").isNull(), False).otherwise(other))
                    .filter(~F.col("known")).select(*KEY, "text", "batch"))
        known = stored(live.select("address").join(hits, "address", "left_semi").distinct(), "known")
    else:
        known = index.tombs.select("address")
    content = stored(distinct.sortWithinPartitions("shard", "address"), "content")
    twice = content.groupBy(*KEY).agg(F.count("*").alias("texts")).filter("texts > 1")
    if not twice.isEmpty():
        raise ValueError("two texts of one digest, hash and length")

    alarms = (told.filter("old").select("shard", "address", "h").distinct()
              .join(known, "address", "left_anti"))
    grown = replace(index, filters=filters)
    filters = _next_filters(grown, alarms, "add")
    mine = new.join(told.select(*KEY, "salt", "shared"), [*KEY, "salt"]).withColumn(
        "batch", F.lit(batch)).select(index.members.columns)
    if index.batch:
        hit = told.filter("shared").select("address").distinct()
        before = index.members.join(hit.withColumn("met", F.lit(True)), "address", "left")
        mine = mine.unionByName(before.withColumn(
            "shared", F.col("shared") | F.coalesce("met", F.lit(False))).select(index.members.columns))
        content = index.content.unionByName(content)
    return Index(index.shards, batch, stored(mine, "members"), filters, content, index.tombs)


def delete(index, gone):
    """The index without the rows whose id is in ``gone`` (doc_id)."""
    ids = gone.select("doc_id").distinct()
    left = stored(index.members.join(ids, "doc_id", "left_anti").select(index.members.columns), "members")
    dead = stored(
        index.members.join(ids, "doc_id", "left_semi").select("shard", "address").distinct()
        .join(left.select("address"), "address", "left_anti")
        .withColumn("h", F.xxhash64("address")), "dead")
    tombs = index.tombs.unionByName(dead.select("address", F.lit(index.batch).alias("until")))
    return replace(index, batch=index.batch + 1, members=left, tombs=tombs,
                   filters=_next_filters(index, dead, "drop"))


def groups(index):
    """One row per live document: doc_id, keep_id, group_size, kept, text digest.

    Only documents whose address was met more than once are grouped.
    """
    members = index.members
    name = F.struct("doc_id", "batch", "row")
    alone = members.filter(~F.col("shared")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.col("address").alias("text_sha256"))
    shared = members.filter("shared")
    part = shared.groupBy(*KEY, "salt").agg(F.count("*").alias("n"), F.max(name).alias("last"))
    same = Window.partitionBy(*KEY)
    whole = part.select(*KEY, "salt", F.sum("n").over(same).alias("group_size"),
                        F.max("last").over(same).alias("last"))
    copies = shared.join(whole, [*KEY, "salt"]).select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size",
        (name == F.col("last")).alias("kept"), F.col("address").alias("text_sha256"))
    return alone.unionByName(copies)


def digest(docs):
    """Every document of one table, through an index built for its size."""
    own = docs.select("doc_id", "text")
    shards = -(-own.count() // SHARD_ROWS) or 1
    kind = own.schema["doc_id"].dataType.simpleString()
    return groups(insert(empty(docs.sparkSession, shards, kind), own))


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id,
             count(*) OVER (PARTITION BY text) AS group_size, text FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM g
"""
