"""Connected components by alternating large-star and small-star steps, each a group-by and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm.common import lookup, stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of `edges` (a, b; any order, repeats allowed).

    Each step is proportional to the edges, and a node with many neighbours is dealt over several tasks: a large-star
    links each larger neighbour to the smallest one, a small-star each smaller one. The steps end when nothing changes,
    after about the logarithm of the longest path; the edges' number and the sum of their hashes, taken while they are
    written, tell. No edges: no rows.
    """
    seen = Observation()
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    now, state = stored(now.observe(seen, F.count(F.lit(1)).alias("n")), "edges"), None
    n = seen.get["n"]
    while n:
        # no node has many neighbours among few edges
        joined = (lambda left, least: lookup(left, least.select("u", "m"), "u", least)) if n > common.HOT else (lambda left, least: left.join(least.select("u", "m"), "u"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
        large = joined(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        moved = joined(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        seen = Observation()
        now = stored(moved.where("u > v").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "small")
        if seen.get == state:
            break
        state, n = seen.get, seen.get["n"]
    rooted = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())
