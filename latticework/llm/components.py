"""Connected components of a link table, by alternating large and small stars.

Each round is a few aggregations and equi-joins on the links alone; no node's neighbours are ever gathered in one
row, so a node with very many links costs a partial aggregate and a join side that adaptive execution can split.
Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """links: (u, v) of one comparable type. Returns (node, root): each linked node but the least of its component, with that least node."""
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), folder, "links-0")
    before, k = None, 0
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, k = state, k + 1
        links = written(_small_star(_large_star(links)), folder, f"links-{k}")
