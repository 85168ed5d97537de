"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismdex.llm.tables import release, written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the least of its neighbourhood."""
    ways = _both_ways(links)
    least = written(ways.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    stars = written(ways.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "links")
    release(links, least)
    return stars


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the least of these."""
    least = written(links.groupBy("b").agg(F.min("a").alias("m")), "least")
    moved = links.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    stars = written(moved.union(least.select(F.col("m").alias("a"), "b")).distinct(), "links")
    release(links, least)
    return stars


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of the written links (a, b), a < b, which it releases; the root is the least node of the component.

    Each round writes its links to the shared folder, so lineage stays short.  Rounds end when every node hangs
    directly on a root that hangs on none, which takes about the logarithm of the longest chain.  The least neighbours are
    aggregated before they are shuffled and written before they are joined: the join then sends them to all tasks if they are few, and
    otherwise has a shuffle on both sides, so adaptive execution can split a node of very many links.
    """
    for _ in range(most_rounds):
        links = _small_star(_large_star(links))
        deep = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1)
        many = links.groupBy("b").count().where("count > 1").limit(1)
        if not deep.take(1) and not many.take(1):
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
