"""Connected components of a link table, by alternating large and small stars.

Each step gives every node's neighbours the smallest id that the node knows, until
nothing changes; then every node points to the smallest id of its component
(Kiveris et al., 2014). A step is one aggregate, summed up before its shuffle, and
one join in which nodes with very many links are set apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import Scratch, join_by_key


def _pointed(edges: DataFrame, scratch: Scratch, name: str, smaller_only: bool) -> DataFrame:
    """(a, b), a > b: the links after one star step. ``edges`` holds each link once, with a > b."""
    both = edges if smaller_only else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    least = scratch.table(least.withColumn("m", F.least("a", "m")), f"{name}-least")
    total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_by_key(both, least, "a", "n", total)
    if smaller_only:
        moved = joined.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    else:
        moved = joined.where("b > a").select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
    return moved.where("x > m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): the smallest id of its component for every node of links (a, b) but these smallest ones.

    Direction and repetition of links do not matter; a link of a node with itself
    is none. Without links the result is empty.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = scratch.table(edges, f"{name}-0")
    step, state = 0, None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        # A star has each node once on the left and no left node on the right.
        if now[0] == 0 or tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = tuple(now)
        large = scratch.table(_pointed(edges, scratch, f"{name}-{step}l", False), f"{name}-{step}large")
        edges = scratch.table(_pointed(large, scratch, f"{name}-{step}s", True), f"{name}-{step}small")
        # The links of the step before are read no more.
        scratch.drop(f"{name}-{step}l-least", f"{name}-{step}large", f"{name}-{step}s-least", f"{name}-0" if step == 0 else f"{name}-{step - 1}small")
        step += 1
