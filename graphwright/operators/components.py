"""Connected components of a table of links, by alternating large and small stars.

Every step is a minimum per node (partial before the shuffle) and a join back on the node, which adaptive execution
splits where a node has very many links.  The links stay on the cluster; each round is settled in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.plans.scratch import Settled


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    # u > v holds after a large star
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    down = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _mark() -> dict[str, Column]:
    """What tells one round's links from the next one's."""
    return {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}


def components(links: DataFrame) -> Settled:
    """From links (u, v) of longs, a settled table (node, component) of all nodes that have links; component: the smallest node."""
    now = Settled(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), observed=_mark())
    while now.seen["n"]:
        after = Settled(_small(_large(now.df)), observed=_mark())
        now.drop()
        done, now = after.seen == now.seen, after
        if done:
            break
    own = F.explode(F.array("u", "v")).alias("node")
    out = Settled(now.df.select(own, F.col("v").alias("component")).distinct())
    now.drop()
    return out
