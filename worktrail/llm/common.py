"""What the operators of this subpackage share."""

import pyarrow as pa
from pyspark.sql import functions as F

from worktrail.session import work_dir


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark, rows=1000, size=4 << 20):
    """Bound what a Python worker holds of a table at once, for this session from now on.

    A batch holds at most ``rows`` rows and, but for a single larger row, ``size`` bytes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def stored(df, name):
    """``df`` written once to the shared folder and read back.

    Cuts the lineage: what follows reads one fixed copy, so row numbers given
    before stay the same when a lost executor's work is done again.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df, name="__row"):
    """A unique number per row. Only for a frame that is written before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def runs(column, rows=256):
    """Values of an Arrow column, a few rows at a time: no second copy of a whole batch."""
    for i in range(0, len(column), rows):
        yield column.slice(i, rows).to_pylist()


class Cache:
    """A dict of bounded size in two generations: full, the younger one becomes the elder.

    What is still asked for moves to the younger generation again, so frequent
    entries stay and about ``2 * most`` entries (plus one batch) are held. A key
    of more than 64 characters counts for as many entries as it has 64s. A worker
    process serves many operators in turn, so only the cache in use is kept.
    """

    in_use = None

    def __init__(self, most):
        self.most, self.young, self.old, self.extra = most, {}, {}, 0

    @staticmethod
    def release():
        """Empty the cache that an operator before has left in this worker."""
        if Cache.in_use is not None:
            Cache.in_use.young, Cache.in_use.old, Cache.in_use.extra = {}, {}, 0
            Cache.in_use = None
            pa.default_memory_pool().release_unused()

    def rows(self, keys, make):
        """For each list of keys its list of values; ``make(set)`` gives those not known."""
        if Cache.in_use is not self:
            Cache.release()
            Cache.in_use = self
        if len(self.young) + self.extra > self.most:
            self.young, self.old, self.extra = {}, self.young, 0
        young, old, new, holes, out = self.young, self.old, set(), [], []
        get = young.get
        for own in keys:
            values = list(map(get, own))
            out.append(values)
            at = -1
            for _ in range(values.count(None)):
                at = values.index(None, at + 1)
                key = own[at]
                holes.append((values, at, key))
                if key not in new and key not in young:
                    value = old.get(key)
                    if value is None:
                        new.add(key)
                    else:
                        young[key] = value
        if new:
            young.update(make(new))
            self.extra += sum([len(k if type(k) is not tuple else k[0]) >> 6 for k in new])
        for values, at, key in holes:
            values[at] = young[key]
        return out
