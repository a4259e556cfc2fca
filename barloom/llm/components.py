"""Connected components of an edge table, by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import beside, dropped, stored


def _is_done(edges: DataFrame) -> bool:
    """Whether every larger end hangs on one node, which itself hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 OR hangs = 1 AND holds = 1").isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root), stored: for every node of ``edges`` the smallest node it is connected with.

    Each round hangs all larger neighbours of a node on its smallest neighbour (large star), then its smaller ones
    (small star), until all hang on a smallest node: a logarithmic number of rounds. Minima are aggregated before the shuffle, so
    a node with very many neighbours costs one row a task; nodes of no edge with another node are left out.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    e = stored(e)
    while not _is_done(e):
        # Large star: v > u of u's neighbours go to the least of u and its neighbours.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        larger = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = larger.join(beside(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u's smaller neighbours, and u, go to the least of them.
        large = stored(large)
        dropped(e)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(beside(least), "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        e = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(large)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = stored(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()))
    dropped(e)
    return roots
