"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours under the smallest node it sees."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # joined on the node, so a node with very many neighbours is a skewed join Spark can split
    return both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hangs itself and its smaller neighbours under the smallest of them (a < b in ``links``)."""
    low = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(low, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    own = low.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return moved.union(own).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has a link; root is the component's smallest node.

    ``links`` are undirected; self links, repeats and nulls are dropped.  Each round is a
    few equi-joins on node numbers and is checkpointed; rounds grow with the logarithm
    of the diameter.  Only counts reach the driver.  An empty table gives no rows.
    """
    links = links.select(F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b"))
    links = cut_lineage(links.where(F.col("a") < F.col("b")).distinct())
    state = _state(links)
    while state[0]:
        links = cut_lineage(_small_star(_large_star(links)))
        now = _state(links)
        if now == state:
            break
        state = now
    stars = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return stars.union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
