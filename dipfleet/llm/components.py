"""Connected components of links that no task or driver holds whole: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfleet.llm.common import checkpointed


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """`node, component` (the smallest node reachable) for every node with a link. Links to null or to a node itself link nothing; repeated
    links count once; no links give an empty result.

    Each step hangs nodes on the smallest neighbour known; the star forest is reached in about log(n) steps, each cut
    off by a checkpoint. Smallest neighbours are combined before they are shuffled, and the joins that follow can
    split a node with very many links.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = checkpointed(edges)
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u hangs on the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u, hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = checkpointed(edges)
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)), F.countDistinct("u")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
