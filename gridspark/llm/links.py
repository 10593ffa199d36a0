"""Connected components of an edge list by alternating large and small stars.

Every round is one aggregation and one join over the edges, written to the shared
folder. Stars shrink paths by half or more, so rounds grow with the logarithm of
the longest path. A hub's edges are spread: the aggregate combines before the
shuffle and the join back is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(low, "u")
    if large:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v: orderable) -> u, v: every vertex but the least of its component, and that least one."""
    now = cut(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        new = cut(_star(_star(now, True), False))
        same = [df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first() for df in (now, new)]
        now = new
        if same[0] == same[1] and not now.groupBy("u").count().filter("count > 1").limit(1).count():
            return now
    raise RuntimeError("components did not settle")
