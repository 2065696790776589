"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsift.plans.lineage import cut
from depsift.plans.skew import spread_join


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node of `edges` with the smallest node it can reach.

    Returns (node, component). Rows with a null end and self loops name a node but link nothing.
    Each round, every node picks the one of least hash among its neighbours and itself, follows that node's
    own pick, and edges are contracted to the picked nodes. Order by hash keeps long chains from contracting
    one step at a time, and a star is done in two rounds. A round costs a few shuffles on the edges left,
    never a group collected in one task: adaptive execution splits joins on hubs, which end in a checkpoint, and
    the last join splits giant components. Labels are cut every fourth round, so plans stay short. Joins are by shuffle: what is
    broadcast goes through the driver, several times a round, and each time leaves it threads and heap to hold.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("cur"))
    live = pairs.where("a <> b")
    order = lambda c: F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("n"))
    for turn in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        pick = best.select(F.col("a").alias("v"), F.least("m", order("a"))["n"].alias("t"))
        hop = pick.select(F.col("v").alias("hv"), F.col("t").alias("ht"))
        pick = cut(pick.join(hop.hint("merge"), F.col("t") == F.col("hv"), "left").select("v", F.coalesce("ht", "t").alias("t")))
        labels = labels.join(pick.hint("merge"), F.col("cur") == F.col("v"), "left").select("node", F.coalesce("t", "cur").alias("cur"))
        if turn % 4 == 3:
            labels = cut(labels)
        ends = [pick.select(F.col("v").alias(c), F.col("t").alias(n)) for c, n in (("a", "na"), ("b", "nb"))]
        met = live.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").where("na <> nb")
        live = cut(met.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct())
    else:
        raise RuntimeError("connected components did not settle")
    labels = cut(labels)
    least = labels.groupBy("cur").agg(F.min("node").alias("component"))
    return spread_join(labels, least.hint("merge"), ["cur"], "node").select("node", "component")
