"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorr.llm.common import stash, unstash


def _large_star(edges: DataFrame, spent: list[DataFrame]) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    spent.append(least)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, spent: list[DataFrame]) -> DataFrame:
    least = stash(edges.groupBy("u").agg(F.min("v").alias("m")))
    spent.append(least)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: long); the root is the smallest node reached.

    Loops, repeats and null ends count for nothing. Each round is written to the shared folder, so
    that neither a lost executor nor a long chain of links makes the plan start over; chains
    shorten by more than half a round. So are the minima of each star: the join of links to them then
    has two sides that are dealt alone, and a large star's links can be split over tasks.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = stash(now), None
    while True:
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == mark:
            break
        mark = got
        spent = [now]
        now = stash(_small_star(_large_star(now, spent).distinct(), spent))
        unstash(*spent)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
