"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firegrid.llm.common import HOT_SHARE, Scratch, hot_keys, spread_join


def _large_star(edges: DataFrame, hot: list[int]) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    hung = spread_join(both.filter("v > u"), low.select("u", F.least("low", "u").alias("low")), "u", hot, "v")
    return hung.select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("u", F.col("low").alias("v"))).filter("u <> v")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (u, v), component being the smallest node.

    Nodes may be of any ordered type. Links with a null end and loops are ignored; a node
    without another link is absent. Each round is written and takes the place of the one
    before; the rounds grow with the logarithm of the longest chain. A node with very many
    links is dealt over several tasks.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.keep("edges-0", links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).dropna().filter("u <> v").distinct())
    state, hot, turn = None, _state(edges)[1], 0
    while True:
        turn += 1
        stars = scratch.keep(f"edges-{turn}", _small_star(_large_star(edges, hot).distinct()).distinct())
        scratch.drop(f"edges-{turn - 1}")
        now, hot = _state(stars)
        if now == state:
            return stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
                stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state, edges = now, stars


def _state(edges: DataFrame) -> tuple[tuple, list[int]]:
    """Number and checksum of the edges, and the hashes of the hot smaller ends, at most HOT_SHARE of them."""
    ends = edges.groupBy("v").agg(F.count("*").alias("count"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    number, total, most = ends.agg(F.coalesce(F.sum("count"), F.lit(0)), F.sum("sum"), F.max("count")).first()
    return (number, total), hot_keys(ends, "v", number) if (most or 0) > max(16, number // HOT_SHARE) else []
