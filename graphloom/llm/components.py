"""Connected components of links too many for one machine, by alternating large and small stars.

Each round is two pre-aggregated minima and joins; the number of rounds grows with the logarithm of the number of links.
Only counts and a checksum come to the driver. A hub's links are an ordinary skewed join side. The rounds end when no link
has changed: equal checksums only say that it is worth comparing the links themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of all ids in links (u, v), except those that are their own."""
    now = stored(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    was = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if not mark[0] or was and mark == was[0] and now.join(was[1], ["u", "v"], "left_anti").isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        was, now = (mark, now), stored(_small(_large(now)), "links")
