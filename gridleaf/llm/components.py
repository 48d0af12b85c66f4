"""Connected components of a graph given as a table of links.

Alternating large-star and small-star steps (Kiveris et al. 2014): every node is
tied to the least node it knows until the links form stars.  Each step is two
aggregations and joins; a node with very many links is a join key that adaptive
execution can split, and its least neighbour is pre-aggregated before the shuffle.
Links never reach the driver; only their count and checksum do, once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridleaf.llm.shared import discard, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: u > v, distinct."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        tied = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        tied = links.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v")
    return tied.distinct()


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """``links`` (a, b): one row (node, root) for each node with a link to another; root is the least reachable node.

    Nulls and loops are ignored, repeated links count once.  An empty table gives
    an empty table.  The rounds needed grow with the logarithm of the longest path; one that needs
    more than ``rounds`` is an error, not a wrong result.
    """
    now = links.where("a is not null and b is not null and a != b")
    now = written(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        after = written(_star(_star(now, True), False), "links")
        row = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        new = (row[0], row[1])
        discard(now)
        now = after
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
