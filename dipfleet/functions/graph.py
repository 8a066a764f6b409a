"""Connected components of links that no task or driver holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipfleet.functions.storage import checkpointed


def linked_parts(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """`node, part` (its smallest node) for every node with a link; null ends link nothing.

    Alternating star steps: every larger neighbour of a node moves to the smallest one known, then every smaller one does, until
    all hang on one centre: about log(n) rounds, each cut off by a checkpoint. Smallest neighbours are combined before rows are
    shuffled.
    """
    edges = checkpointed(links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high > low").distinct())
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        centre = both.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("c")).select("node", F.least("node", "c").alias("c"))
        large = both.join(centre, both["high"] == centre["node"]).where("low > node").select(F.col("low").alias("high"), F.col("c").alias("low")).where("high > low").distinct()
        centre = large.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("c"))
        small = large.join(centre, large["high"] == centre["node"])
        edges = checkpointed(small.select(F.col("low").alias("high"), F.col("c").alias("low")).unionByName(small.select("high", F.col("c").alias("low"))).where("high > low").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")), F.lit(0)), F.countDistinct("high")).first()
        if now == seen:
            centres = edges.select(F.col("low").alias("node")).distinct()
            return edges.select(F.col("high").alias("node"), F.col("low").alias("part")).unionByName(centres.select("node", F.col("node").alias("part")))
        seen = now
    raise RuntimeError("parts did not settle")
