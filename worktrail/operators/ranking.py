"""Skew-safe per-key ranking and neighbour lookups.

A key may hold a large share of all rows, so no operator here sends a key's
rows to one task: per-key top-k is cut per salt first, and neighbour values are
found per time bucket, with only bucket edges compared across buckets.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

SALTS = 32


def newest_per_key(df, keys, order, k, salt_on="id", salts=SALTS):
    """The first ``k`` rows of each key in ``order``; adds ``pos`` from 1.

    Spark cuts each map task's rows to ``k`` per window partition before the
    shuffle; the salt then bounds what one reducer sees of a hot key, and the
    last step ranks at most ``salts * k`` rows per key.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    cut = (salted.withColumn("__rank", F.row_number().over(first))
           .filter(F.col("__rank") <= k).drop("__rank", "__salt"))
    last = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn("pos", F.row_number().over(last)).filter(F.col("pos") <= k)


def keep_first(df, keys, order):
    """One row per key: the first in ``order`` (cut map-side before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("__rank", F.row_number().over(w))
            .filter(F.col("__rank") == 1).drop("__rank"))


def with_neighbour(df, keys, ts, order, value, name, ahead=False, bucket="minute"):
    """Add the previous (or next) row's ``value`` per key, as column ``name``.

    Rows are ordered within (key, time bucket). A bucket's first and last rows then
    meet those of the key's other buckets: at most two rows per bucket, so neither a
    key's rows nor all rows of one hour end in one task. Both steps read the same
    shuffle, so the input is read and dealt once.
    """
    rows = df.withColumn("__bucket", F.date_trunc(bucket, F.col(ts))).withColumn(
        "__value", F.struct(value.alias("v")))
    inner = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    step = F.lead if ahead else F.lag
    rows = rows.select("*", step("__value").over(inner).alias("__near"),
                       F.row_number().over(inner).alias("__place"),
                       F.lead("__value").over(inner).isNull().alias("__ends"))
    edge = (F.col("__place") == 1) | F.col("__ends")
    outer = Window.partitionBy(*keys).orderBy(*order)
    edges = rows.filter(edge).withColumn("__far", step("__value").over(outer))
    edges = edges.withColumn("__near", F.coalesce("__near", "__far")).drop("__far")
    return (rows.filter(~edge).unionByName(edges)
            .withColumn(name, F.col("__near.v"))
            .withColumn(f"has_{name}", F.col("__near").isNotNull())
            .drop("__bucket", "__value", "__near", "__place", "__ends"))


def salted_lookup(big, small, on, salt_on, how="inner", salts=8):
    """Join a hot-keyed frame to a small per-key lookup.

    The lookup is repeated once per salt so that a hot key spreads over
    ``salts`` tasks; where the lookup turns out small, AQE broadcasts it.
    ``how`` is any join type that keeps or filters the rows of ``big``.
    """
    salt = F.pmod(F.xxhash64(*salt_on), F.lit(salts)).cast("int")
    left = big.withColumn("__salt", salt)
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")
