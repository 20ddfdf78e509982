"""Connected components of an edge table, by alternating large and small stars.

Repeated edges and edges from a node to itself change nothing; an edge with a null end
links nothing. An empty table gives no rows. Other columns are not read.
"""

from pyspark.sql import functions as F

from worktrail.llm.common import stored


def _least(pairs):
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def large_star(edges):
    """Each node sends its larger neighbours to the least node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("m", "u").alias("m"))
    return (both.filter("v > u").join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())


def small_star(edges):
    """Each node sends its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .filter("u <> v").distinct())


def components(edges):
    """(u, root) for every node with an edge; the root is the least node reachable.

    ``edges`` has the columns u and v. Each round is written to the shared
    folder; the edge count and a checksum tell whether it changed anything.
    """
    now = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    state = None
    while True:
        now = stored(small_star(large_star(now)), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()
    return now.select("u", F.col("v").alias("root")).unionByName(roots)
