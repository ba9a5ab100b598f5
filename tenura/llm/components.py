"""Connected components by alternating large-star and small-star rounds.

Each round is a grouped minimum (combined before the shuffle) and an equi-join back, which Spark can
split when one node has most of the links. Only a row count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.storage import cut

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v): hang the neighbours of each u on the smallest node around it."""
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # each node with its smaller neighbours
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable."""
    now = cut(links.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        now = cut(_star(_star(now, large=True), large=False))
        row = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row.n, row.x) == mark:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
        mark = (row.n, row.x)
    raise RuntimeError("the components did not settle")
