"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castwright.llm.common import land


def components(links: DataFrame) -> DataFrame:
    """Columns node, root (smallest node of the component) for every node of `links` (a, b).

    Large-star and small-star steps (Kiveris et al., 2014) until the links no longer change; each round is landed.
    The rounds grow with the logarithm of the longest path. A node's neighbours never meet in one row: a hub costs
    a partial minimum and a join, which adaptive execution splits.
    """
    edges = land(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(lowest, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(moved.select("u", F.col("m").alias("v"))).where("u <> v")
        edges = land(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.groupBy("u").agg(F.min("v").alias("root"))
            tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return land(roots.select(F.col("u").alias("node"), "root").unionByName(tops))
        before = now


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` (node, root) after more links (a, b): components meet by their roots, so links inside one cost no round."""
    ends = links.select("a", "b")
    for side in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left")
    between = land(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct())
    if between.isEmpty():
        return roots
    tops = components(between)
    known = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return land(known.unionByName(tops.join(roots, "node", "left_anti")))
