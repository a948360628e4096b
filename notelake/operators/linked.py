"""Groups of notes that moves tie together.

Edges are ``(vault, a, b)``: two note names of one vault.  A group is named by its smallest
note.  A bounded number of edges is united in one pass by vault; beyond it, roots
are found by pointer doubling: in every round each note takes the smallest grandparent among
its neighbours', hands it to its own parent, and then points to its grandparent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .checkpoints import checkpoint

# Edges that one task may hold.
FEW_EDGES = 200_000

ROOTS = "vault string, key string, root string"


def _unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[tuple, tuple] = {}

    def root(x: tuple) -> tuple:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for vault, a, b in zip(batch.vault, batch.a, batch.b):
            low, high = sorted((root((vault, a)), root((vault, b))))
            parent[high] = low
    rows = [(vault, key, root((vault, key))[1]) for vault, key in list(parent)]
    for start in range(0, len(rows), 10_000):
        yield pd.DataFrame(rows[start : start + 10_000], columns=["vault", "key", "root"])


def _doubled(edges: DataFrame) -> DataFrame:
    both = checkpoint(
        edges.unionByName(edges.select("vault", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    at = ["vault", "key"]
    roots = both.groupBy("vault", F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    before = None
    while True:
        roots = checkpoint(roots)
        now = roots.agg(F.count("*"), F.sum(F.xxhash64("vault", "key", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return roots
        before = now
        above = roots.select("vault", F.col("key").alias("root"), F.col("root").alias("grand"))
        grand = roots.join(above, ["vault", "root"])
        # Smallest grandparents are combined before the shuffle, so a note of very many moves is gathered nowhere.
        near = (
            both.join(grand.select("vault", F.col("key").alias("b"), "grand"), ["vault", "b"])
            .groupBy("vault", F.col("a").alias("key"))
            .agg(F.min("grand").alias("near"))
        )
        offers = grand.join(near, at)
        roots = (
            offers.select(*at, F.least("grand", "near").alias("root"))
            .unionByName(offers.select("vault", F.col("root").alias("key"), F.col("near").alias("root")))
            .groupBy(*at)
            .agg(F.min("root").alias("root"))
        )


def groups(edges: DataFrame, count: int, few: int = FEW_EDGES) -> DataFrame:
    """``vault, key, root`` of every note of ``edges(vault, a, b)``, of which there are ``count``."""
    if count <= few:
        return checkpoint(edges.repartition("vault").mapInPandas(_unite, ROOTS))
    return _doubled(edges)
