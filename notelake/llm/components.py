"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import stored


def _least(links: DataFrame) -> DataFrame:
    """``u, least``: the smallest of each node and its neighbours v."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``links(a, b)``; the root is the smallest node reachable.

    Alternates large-star and small-star steps: every node hands the smallest
    neighbour to its other neighbours, larger ones first.  Minima are combined
    before the shuffle; no node's neighbours are gathered.  Each round is written
    to the shared folder.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .where("u <> v")
            .distinct()
        )
        least = _least(large)
        edges = stored(
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(least.select("u", F.col("least").alias("v")))
            .where("u <> v")
            .distinct(),
            "links",
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
