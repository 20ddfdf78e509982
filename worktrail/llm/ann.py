"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product is turned into smallest distance by one more coordinate,
which gives every vector the same length. A table's key is the vector's cell
under ``HASHES`` functions floor((a.x + b) / w) with Gaussian a; a query visits
the cells of a table in the order of the estimated probability that a neighbour
lies there, until these add up to ``TARGET``. Candidates of all tables are
merged and ranked by their exact inner products in double precision.

The index is kept in shards of rows dealt by hash of the row, so a crowded cell
is spread over all shards, and a shard holds a bounded number of rows. Queries
go to every shard in blocks. A task handles one shard and one block of queries;
what it hands on is each query's best rows of that shard.

How near a query's k-th neighbour is (``similarity``) is estimated for each query
from its own inner products with a bounded sample of ``SAMPLE`` rows, and rather
too far than too near: a crowd elsewhere does not narrow its search. Cells are
also taken for nearer neighbours (``nearer``), up to near copies. Every row is
indexed.

Vectors that are null, zero, of another length than most, or hold null, NaN or
infinite components take no part, neither do rows without an id. Ids should be
unique; rows that repeat an id are ranked each. Ties go to the smaller id. Other columns
are not read. An empty table, or one without usable vectors, gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktrail.llm.common import stored
from worktrail.operators.ranking import newest_per_key

TABLES, HASHES, WIDTH, TARGET = 2, 4, 1.5, 0.78
SHARD, BLOCK = 4096, 512
SAMPLE = 1024
NEAREST = 0.999
SEED = 7


def usable(vectors, id_column="vec_id", vector="embedding"):
    """Rows that take part: id, vector as array<double>."""
    v = F.transform(vector, lambda x: x.cast("double"))
    limit = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return (vectors.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull())
            .select(F.col(id_column).cast("bigint").alias("vec_id"), v.alias("v"))
            .filter(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda x: x != 0))
            .withColumn("dim", F.size("v")))


def phi(x):
    """Normal distribution function, to about 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) * t * (0.319381530 + t * (
        -0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


class Hashes:
    """The hash functions of all tables, the same in every task."""

    def __init__(self, dim, length):
        rng = np.random.default_rng(SEED)
        self.scale = length / np.sqrt(dim)
        self.width = WIDTH * self.scale
        self.a = rng.standard_normal((TABLES, dim, HASHES)) / np.sqrt(dim)
        self.b = rng.random((TABLES, HASHES)) * self.width
        self.length = length

    def rows(self, x):
        """Vectors on one sphere: the added coordinate leaves the order of distances to q."""
        more = np.sqrt(np.maximum(self.length ** 2 - (x * x).sum(1), 0))
        return np.hstack([x, more[:, None]])

    def queries(self, q):
        q = np.hstack([q, np.zeros((len(q), 1))])
        return q * (self.length / np.linalg.norm(q, axis=1))[:, None]

    def cells(self, t, rows):
        """The used cells of a table and each row's cell."""
        keys = np.floor((rows @ self.a[t] + self.b[t]) / self.width).astype(np.int64)
        return np.unique(keys, axis=0, return_inverse=True)

    def visits(self, t, cells, queries, similarity):
        """Which cells each query visits: the likeliest until their estimates reach TARGET."""
        low = cells * self.width - self.b[t]
        seen = np.zeros((len(queries), len(cells)), bool)
        for near in nearer(similarity):
            centre = near[:, None] * (queries @ self.a[t])
            sd = np.sqrt(np.maximum(1 - near ** 2, 1e-4))[:, None] * self.scale
            chance = np.ones(seen.shape)
            for j in range(HASHES):
                edge, which = np.unique(low[:, j], return_inverse=True)
                p = (phi((edge + self.width - centre[:, j, None]) / sd)
                     - phi((edge - centre[:, j, None]) / sd))
                chance *= p[:, which]
            order = np.argsort(-chance, axis=1, kind="stable")
            ranked = np.take_along_axis(chance, order, 1)
            going = np.cumsum(ranked, 1) - ranked < TARGET
            own = np.zeros(chance.shape, bool)
            np.put_along_axis(own, order, going, 1)
            seen |= own
        return seen


def nearer(similarity):
    """Similarities to search at: the k-th neighbour's, half as far, and a near copy's."""
    return [similarity, (similarity + NEAREST) / 2, np.full(len(similarity), NEAREST)]


def similarities(query_ids, queries, sample_ids, sample, longest, n, k):
    """Of each query, how near its k-th of n neighbours is at least (cosine on the sphere).

    Of a sample that holds ``mean`` of the k nearest on average, a place a few
    standard deviations further is taken; the k-th place is never too near.
    """
    near = queries @ (sample / longest).T / np.linalg.norm(queries, axis=1)[:, None]
    own = query_ids[:, None] == sample_ids[None, :]
    near = -np.sort(np.where(own, np.inf, -near), axis=1)
    others = (~own).sum(1)
    mean = k * others / max(n - 1, 1)
    place = np.minimum(np.minimum(np.ceil(mean + 2 * np.sqrt(mean)) + 1, k), others).astype(int)
    found = np.where(place > 0, near[np.arange(len(near)), np.maximum(place, 1) - 1], -NEAREST)
    return np.clip(found, -NEAREST, NEAREST)


def search_shard(ids, rows, query_ids, queries, similarity, hashes, k):
    """(query row, id, score) of the best ``k`` candidates of each query in one shard."""
    scores = np.full((len(queries), len(rows)), -np.inf)
    on_sphere, asked = hashes.rows(rows), hashes.queries(queries)
    for t in range(TABLES):
        cells, where = hashes.cells(t, on_sphere)
        seen = hashes.visits(t, cells, asked, similarity)
        order = np.argsort(where, kind="stable")
        for cell, own in enumerate(np.split(order, np.cumsum(np.bincount(where))[:-1])):
            who = np.flatnonzero(seen[:, cell])
            if len(who) and len(own):
                scores[np.ix_(who, own)] = queries[who] @ rows[own].T
    scores[query_ids[:, None] == ids[None, :]] = -np.inf
    out = []
    for i, row in enumerate(scores):
        best = np.flatnonzero(row > -np.inf)
        if len(best) > k:
            # Blocked products may differ in the last bits: keep what is that near the last place.
            edge = np.partition(row[best], len(best) - k)[len(best) - k]
            best = best[row[best] >= edge - 1e-9 * max(1.0, abs(edge))]
        exact = (rows[best] * queries[i]).sum(1)
        first = np.lexsort((ids[best], -exact))[:k]
        out.append((np.full(len(first), i), ids[best][first], exact[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def measure(rows):
    """Rows of the usual dimension, their number, dimension and longest length; ids and rows of a sample."""
    dim = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dim is None:
        return None
    own = rows.filter(F.col("dim") == dim["dim"])
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest = own.agg(F.max(norm)).first()[0] ** 0.5
    sample = own.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("vec_id", "v").collect()
    return (own, dim["count"], dim["dim"], longest, np.array([r[0] for r in sample]),
            np.array([r[1] for r in sample]))


def search(vectors, queries, k=20, id_column="vec_id", vector="embedding"):
    """Each query's ``k`` nearest found: query_id, rank, vec_id, score.

    ``queries`` has the columns of ``vectors``; a query's own id is no candidate.
    """
    rows = stored(usable(vectors, id_column, vector), "vectors")
    spark = rows.sparkSession
    known = measure(rows)
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if known is None:
        return spark.createDataFrame([], empty)
    own, n, dim, longest, sample_ids, sample = known
    shards = -(-n // SHARD) * 5 // 4 + 1
    asked = usable(queries, id_column, vector).filter(F.col("dim") == dim)
    blocks = max(1, -(-asked.count() // BLOCK) * 5 // 4)
    mixed = F.xxhash64("vec_id", "v")

    def matrix(column):
        return np.asarray(column.flatten()).reshape(-1, dim)

    def estimated(batches):
        for batch in batches:
            near = similarities(batch["vec_id"].to_numpy(), matrix(batch["v"]), sample_ids, sample,
                                longest, n, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], ["vec_id", "v", "near"])

    asked = asked.select("vec_id", "v").mapInArrow(
        estimated, "vec_id bigint, v array<double>, near double")
    left = own.select((F.pmod(mixed, F.lit(shards))).alias("shard"), F.explode(
        F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    right = asked.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"),
        F.pmod(mixed, F.lit(blocks)).cast("int").alias("block"),
        F.col("vec_id").alias("query_id"), "v", "near")

    def run(mine, asking):
        if not mine.num_rows or not asking.num_rows:
            ids = np.zeros(0, np.int64)
            return pa.table({"query_id": ids, "vec_id": ids, "score": np.zeros(0)})
        asked_ids = asking["query_id"].to_numpy()
        i, ids, score = search_shard(
            mine["vec_id"].to_numpy(), matrix(mine["v"].combine_chunks()), asked_ids,
            matrix(asking["v"].combine_chunks()), asking["near"].to_numpy(),
            Hashes(dim + 1, longest), k)
        return pa.table({"query_id": asked_ids[i], "vec_id": ids, "score": score})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        run, "query_id bigint, vec_id bigint, score double")
    best = newest_per_key(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k, "vec_id")
    return best.select("query_id", F.col("pos").alias("rank"), "vec_id", "score")


def digest(vectors):
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))
