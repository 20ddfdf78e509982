"""Hard negatives by anchor-clustered shared lists.

Scores are integer inner products of vectors whose components are scaled and
floored. An anchor's positives are its best rows of its own label; a negative of
an (anchor, positive) pair is a row of another label whose score lies in a window
of the positive's.

Anchors go in blocks to shards of candidates; both are dealt by hash, so blocks and
shards are even and bounded whatever labels or near copies hold. Within a task the
block's anchors are clustered by direction. A cluster has one list of the shard's
candidates, sorted once by an upper bound that holds for all its members: if no
member is further than the angle b from the centre and a candidate is at the angle
t, no member's inner product with it exceeds ``|anchor| |candidate| cos(max(0, t - b))``.
Every member walks that list, ``STEP`` candidates at a time, until the bound of the
next one lies below the last of its best so far (or below all its windows): what
is left cannot enter the result, which is therefore exact. Tasks hand on an anchor's
best of the shard; these are merged per anchor.

Rows without id, label or vector, with a null, NaN or infinite component, or of
another length than most take no part. No row is a candidate of an anchor of the
same id. Ids should be unique: rows that repeat one are each a candidate, and those
that repeat an anchor's id are each an anchor. Equal scores go by smaller id, then
by row. Fewer rows than asked for give all of them; an empty table gives no rows.
Other columns are not read. Vectors whose scores could pass ``LARGEST`` are refused
with an error.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from worktrail.llm.common import numbered, stored
from worktrail.operators.ranking import newest_per_key

SHARD, BLOCK = 4096, 1024
CLUSTER, ROUNDS, STEP = 16, 6, 256
SCALE = 256
LARGEST = 2 ** 46
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
NONE = np.iinfo(np.int64).min


def usable(vectors, id_column="vec_id", vector="embedding", label="label"):
    """Rows that take part: vec_id, label, v as array<double> of whole numbers."""
    v = F.transform(vector, lambda x: x.cast("double"))
    limit = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    rows = (vectors.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull()
                           & F.col(label).isNotNull())
            .select(F.col(id_column).cast("bigint").alias("vec_id"),
                    F.col(label).cast("bigint").alias("label"), v.alias("v"))
            .filter(F.coalesce(fine, F.lit(False))))
    whole = F.transform("v", lambda x: F.rint(F.floor(x * SCALE).cast("double")))
    return rows.select("vec_id", "label", whole.alias("v"), F.size("v").alias("dim"))


def clusters(unit):
    """Groups of directions: row numbers of each. Lloyd's rounds on unit vectors."""
    n = -(-len(unit) // CLUSTER)
    centres = unit[np.linspace(0, len(unit) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        own = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-300), centres)
    own = (unit @ centres.T).argmax(1)
    return [(centres[c], np.flatnonzero(own == c)) for c in np.unique(own)]


def shared_list(centre, members, rows, lengths):
    """Candidates by falling bound, with the bounds for an anchor of length one."""
    def angle(unit):
        return np.arccos(np.clip(unit @ centre, -1, 1))

    widest = angle(members).max() + 1e-7
    apart = angle(rows / np.maximum(lengths, 1e-300)[:, None]) - widest - 1e-7
    bound = lengths * (np.cos(np.maximum(apart, 0)) + 1e-9)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class Walk:
    """A shard's candidates and a block of anchors. Candidates are in order of id."""

    def __init__(self, ids, labels, rows, anchor_ids, anchor_labels, anchors):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        self.anchor_ids, self.anchor_labels, self.anchors = anchor_ids, anchor_labels, anchors
        self.lengths = np.linalg.norm(self.rows, axis=1)
        self.anchor_lengths = np.linalg.norm(anchors, axis=1)
        self.walked = 0

    def keys(self, scores, at):
        """Whole numbers that order by higher score, then by smaller id."""
        n = len(self.ids)
        return np.rint(scores).astype(np.int64) * n + (n - 1 - at)

    def read(self, keys):
        """Scores and places of candidates."""
        n = len(self.ids)
        return keys // n, n - 1 - keys % n

    def lowest(self, key):
        """The score of a key, far below all scores for none."""
        return np.where(key == NONE, -np.inf, key // len(self.ids))

    def run(self, k, fits, floor):
        """Each anchor's best ``k`` keys in each of its lists: (anchors, lists, k).

        ``fits(who, at, scores)`` tells which candidates may enter (who, list,
        at); below ``floor`` (anchors, lists) none can.
        """
        best = np.full((*floor.shape, k), NONE, np.int64)
        unit = self.anchors / np.maximum(self.anchor_lengths, 1e-300)[:, None]
        for centre, members in clusters(unit):
            order, bound = shared_list(centre, unit[members], self.rows, self.lengths)
            going = members
            for i in range(0, len(order), STEP):
                needed = np.maximum(self.lowest(best[going].min(2)), floor[going]).min(1)
                going = going[bound[i] * self.anchor_lengths[going] + 1e-6 >= needed]
                if not len(going):
                    break
                at = order[i:i + STEP]
                scores = self.anchors[going] @ self.rows[at].T
                self.walked += scores.size
                keys = np.where(fits(going, at, scores), self.keys(scores, at)[:, None, :], NONE)
                both = np.concatenate([best[going], keys], 2)
                best[going] = np.partition(both, both.shape[2] - k, axis=2)[:, :, -k:]
        return best

    def positives(self, k):
        def fits(who, at, _):
            return ((self.anchor_labels[who][:, None] == self.labels[at])
                    & (self.anchor_ids[who][:, None] != self.ids[at]))[:, None, :]
        return self.run(k, fits, np.full((len(self.anchors), 1), -np.inf))[:, 0]

    def negatives(self, k, scores):
        """``scores``: (anchors, positives), NaN where there are fewer."""
        low, high = LOW * scores, HIGH * scores
        nothing = ~(low <= high)

        def fits(who, at, own):
            other = ((self.anchor_labels[who][:, None] != self.labels[at])
                     & (self.anchor_ids[who][:, None] != self.ids[at]))
            own = 100 * np.rint(own)[:, None, :]
            return (other[:, None, :] & (own >= low[who][:, :, None]) & (own <= high[who][:, :, None]))
        return self.run(k, fits, np.where(nothing, np.inf, low / 100))


def _matrix(column, dim):
    return np.asarray(column.combine_chunks().flatten()).reshape(-1, dim)


def _walk(mine, asking, dim):
    """The walk of a (shard, block), or None where a side is empty."""
    if not mine.num_rows or not asking.num_rows:
        return None
    return Walk(mine["vec_id"].to_numpy(), mine["label"].to_numpy(), _matrix(mine["v"], dim),
                asking["anchor_id"].to_numpy(), asking["label"].to_numpy(), _matrix(asking["v"], dim))


def _found(walk, keys, more):
    """Rows of all keys there are; ``more`` names arrays by the keys' places."""
    where = np.nonzero(keys != NONE)
    score, at = walk.read(keys[where])
    return pa.table({**{name: column[where[:column.ndim]] for name, column in more.items()},
                     "vec_id": walk.ids[at], "score": score})


def mine(vectors, anchors, id_column="vec_id", vector="embedding", label="label",
         positives=POSITIVES, negatives=NEGATIVES):
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` has the columns of ``vectors``; its rows are the queries.
    """
    spark = vectors.sparkSession
    rows = stored(numbered(usable(vectors, id_column, vector, label), "row"), "vectors")
    out = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
           "positive_score bigint, negative_score bigint")
    usual = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if usual is None or not usual["dim"]:
        return spark.createDataFrame([], out)
    n, dim = usual["n"], usual["dim"]
    rows = rows.filter(F.col("dim") == dim)
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    if rows.agg(F.max(length)).first()[0] > LARGEST:
        raise ValueError("vectors are too long for exact scores")
    asked = stored(numbered(usable(anchors, id_column, vector, label).filter(F.col("dim") == dim), "anchor")
                   .select("anchor", F.col("vec_id").alias("anchor_id"), "label", "v"), "anchors")
    shards, blocks = -(-n // SHARD), max(1, -(-asked.count() // BLOCK))

    def every(name, parts):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)

    def dealt(parts, *of):
        return F.pmod(F.xxhash64(*of), F.lit(parts)).cast("int")

    def candidates():
        return rows.select("vec_id", "label", "v", dealt(shards, "row").alias("shard"),
                           every("block", blocks)).groupBy("shard", "block")

    def queries(frame):
        return frame.select("*", dealt(blocks, "anchor").alias("block"),
                            every("shard", shards)).groupBy("shard", "block")

    def near(mine, asking):
        walk = _walk(mine, asking, dim)
        none = np.zeros(0, np.int64)
        if walk is None:
            return pa.table(dict.fromkeys(["anchor", "anchor_id", "vec_id", "score"], none))
        return _found(walk, walk.positives(positives), {
            "anchor": asking["anchor"].to_numpy(), "anchor_id": walk.anchor_ids})

    found = candidates().cogroup(queries(asked)).applyInArrow(
        near, "anchor bigint, anchor_id bigint, vec_id bigint, score bigint")
    best = newest_per_key(found, ["anchor"], [F.desc("score"), F.asc("vec_id")], positives, "vec_id")
    best = (best.groupBy("anchor").agg(F.array_sort(F.collect_list(
        F.struct("pos", "vec_id", "score"))).alias("best"))  # at most ``positives``
        .select("anchor", F.transform("best", lambda x: x["vec_id"]).alias("positive_ids"),
                F.transform("best", lambda x: x["score"]).alias("scores")))
    known = stored(asked.join(best, "anchor"), "positives")

    def hard(mine, asking):
        walk = _walk(mine, asking, dim)
        none = np.zeros(0, np.int64)
        if walk is None:
            return pa.table(dict.fromkeys(
                ["anchor", "anchor_id", "place", "positive_id", "positive_score", "vec_id", "score"], none))
        scores = np.full((asking.num_rows, positives), np.nan)
        ids, whole = (np.zeros(scores.shape, np.int64) for _ in range(2))
        for i, (own, of) in enumerate(zip(asking["scores"].to_pylist(),
                                          asking["positive_ids"].to_pylist(), strict=True)):
            scores[i, :len(own)], whole[i, :len(own)], ids[i, :len(of)] = own, own, of
        place = np.broadcast_to(np.arange(positives), scores.shape)
        return _found(walk, walk.negatives(negatives, scores), {
            "anchor": asking["anchor"].to_numpy(), "anchor_id": walk.anchor_ids, "place": place,
            "positive_id": ids, "positive_score": whole})

    found = candidates().cogroup(queries(known)).applyInArrow(
        hard, "anchor bigint, anchor_id bigint, place bigint, positive_id bigint, "
              "positive_score bigint, vec_id bigint, score bigint")
    best = newest_per_key(found, ["anchor", "place"], [F.desc("score"), F.asc("vec_id")], negatives, "vec_id")
    return best.select("anchor_id", "positive_id", F.col("pos").alias("rank"),
                       F.col("vec_id").alias("negative_id"), "positive_score",
                       F.col("score").alias("negative_score"))


def digest(vectors):
    """Labels of every seventh row are moved on by one, then every hundredth row is an anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", moved.alias("label"))
    return mine(rows, rows.filter(F.col("vec_id") % 100 == 0))


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM r a JOIN r c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id
                               ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
