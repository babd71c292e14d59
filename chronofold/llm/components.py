"""Connected components of a link table, by alternating large and small stars.

Every round rewires links to the smallest neighbour, first those of larger neighbours, then
those of smaller ones, and ends when all links are stars, each around its least node; the
rounds grow with the logarithm of the longest chain. Minima are aggregated before they are shuffled, links never meet in a group:
those of a node with very many are joined where they are. Each round is a table in the shared
folder, so that nothing is held by an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import join_counted, materialise, release


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link up, or only links from others."""
    ends = links.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of one type: (node, root), root being the least node reachable; linked nodes only."""
    links = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars(links):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_counted(both.where("b > a"), least, "a", "n", 2 * links.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = join_counted(down, least, "a", "n", large.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = materialise(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        release(links)
        release(large)
        links = small
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
