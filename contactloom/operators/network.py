"""Connected components of undirected graphs, in tables only.

Every edge points from its larger node to its smaller one. A node with several
smaller neighbours keeps the smallest and hands it on to the others, and every
parent gives way to its own parent, so edges merge from round to round until each
node has one parent; pointer jumping then finds the roots. Minima are combined before the shuffle, and joins on a hub's
key broadcast the hubs (at most ``HOT`` of them) instead of sending their rows
to one task. Every round is checkpointed, and only emptiness reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.session import prepare

#: Keys with more than one part in HOT of all rows are hot: there are at most HOT of them.
HOT = 10_000


def spread_join(left: DataFrame, right: DataFrame, on: str, total: int, count: str = "c", how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``count`` the left rows of the key.

    Hot keys (more than ``total / HOT`` rows of ``total``) are broadcast; the rest
    is shuffled. ``how`` is inner or left.
    """
    hot = F.broadcast(right.where(F.col(count) > total / HOT).drop(count))
    cold = right.where(F.col(count) <= total / HOT).drop(count)
    near = left.join(hot, on)
    return near.unionByName(left.join(hot, on, "left_anti").join(cold, on, how))


def _jump(up: DataFrame) -> DataFrame | None:
    """Every node with its parent's parent in place of its parent; None if all parents are roots."""
    children = up.groupBy("up").agg(F.count(F.lit(1)).alias("c"))
    further = up.select(F.col("node").alias("up"), F.col("up").alias("far")).join(children, "up").checkpoint()
    if further.isEmpty():
        return None
    return spread_join(up, further, "up", up.count(), how="left").select("node", F.coalesce("far", "up").alias("up")).checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): the smallest node that it reaches. Nodes of any type that has an order."""
    prepare(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("up")).distinct().checkpoint()
    while True:
        low = e.groupBy("node").agg(F.min("up").alias("m"), F.count(F.lit(1)).alias("c")).checkpoint()
        several, up = low.where("c > 1"), low.select("node", F.col("m").alias("up"))
        if several.isEmpty():
            break
        more = spread_join(e, several, "node", e.count()).where("up <> m").select(F.col("up").alias("node"), F.col("m").alias("up"))
        e = (_jump(up) or up).unionByName(more).distinct().checkpoint()
    while (further := _jump(up)) is not None:
        up = further
    roots = up.select(F.col("up").alias("node"), F.col("up").alias("component")).distinct()
    return up.withColumnRenamed("up", "component").unionByName(roots)
