"""Connected components of a link table, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.stage import dropped, settled


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (src, dst: long); root is a node of the same component.

    Each round every node moves to the neighbour of least hash (with a hash of the round's own), or stays
    if its own is least, and the links are rewritten between the new places. Components shrink by a
    constant factor a round whatever their shape. Links never leave the executors: the driver only sees
    whether any are left.
    """
    links = settled(links.select("src", "dst").where("src <> dst").distinct())
    nodes = settled(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct())
    found = nodes.select("node", F.col("node").alias("root"))
    turn = 0
    while not links.isEmpty():
        rank = lambda c, t=turn: F.xxhash64(F.col(c), F.lit(t))
        both = links.union(links.select("dst", "src"))
        moves = both.groupBy("src").agg(F.min(F.struct(rank("dst").alias("h"), F.col("dst").alias("to"))).alias("least"))
        moves = settled(moves.select(F.col("src").alias("at"), F.when(F.col("least.h") < rank("src"), F.col("least.to")).otherwise(F.col("src")).alias("to")))
        found = found.join(moves, found["root"] == moves["at"], "left").select("node", F.coalesce("to", "root").alias("root"))
        a, b = moves.toDF("a", "a_to"), moves.toDF("b", "b_to")
        moved = links.join(a, F.col("src") == F.col("a")).join(b, F.col("dst") == F.col("b"))
        pair = moved.select(F.least("a_to", "b_to").alias("src"), F.greatest("a_to", "b_to").alias("dst"))
        before, links = links, settled(pair.where("src <> dst").distinct())
        dropped(before)
        turn += 1
    return found
