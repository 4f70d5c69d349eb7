"""Connected components of a table of links, in a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import MOST_BROADCAST, drop, stash


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b`` of one orderable type); root is the least node it is linked with.

    Alternates large-star and small-star steps (Kiveris et al. 2014): each node links its larger
    neighbours to the least node it sees, then its smaller neighbours. Each round is two
    shuffles over the links, whose number never grows, and is written to the shared folder.
    Only a count and two sums of hashes reach the driver, to tell when nothing changes any more.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stash(edges, "links")
    state = _state(edges)
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        # A node with very many links is one key of these joins: a table of a checked size is broadcast, a larger one left to Spark's splitting.
        near = F.broadcast if state[0] <= MOST_BROADCAST // 2 else lambda df: df
        least = near(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = near(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        after = stash(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        before, state = state, _state(after)
        drop(edges)
        edges = after
        if state == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _state(edges: DataFrame) -> tuple:
    sums = [F.sum(F.xxhash64(F.lit(seed), "u", "v").cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())
