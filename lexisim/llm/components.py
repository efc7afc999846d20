"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisim.llm.common import materialise, release


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node it reaches) for every node of the links (a, b).

    Alternates the large-star and small-star steps of Kiveris et al.: each step
    is a minimum per node, joined back, and halves the depth of what is left.
    Every step's links are a written table, so a lost executor costs one step.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        stars = materialise(_star(_star(edges, True), False), "stars")
        before, after = (x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (edges, stars))
        release(edges)
        edges = stars
        if before == after:
            break
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return members.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges are (a, b) with a > b."""
    seen = edges.select("a", "b")
    if large:
        seen = seen.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = seen.join(least, "a")
    if large:  # neighbours larger than a go to the smallest
        out = joined.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # a and its smaller neighbours go to the smallest
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()
