"""Connected components of links, by alternating large and small stars.

Each round is a grouped minimum (pre-aggregated before its shuffle) and a join back to the links, read from the
shared folder so that Spark can split a key that holds a third of all links. Every round's links are written to
the shared folder; the number of rounds grows with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriate.llm.common import dropped, new_path, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links of each node moved to its smallest neighbour; large: of its larger neighbours, else of its smaller ones and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = both if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = rows.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = rows.where("v > u") if large else rows
    moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root of every node that has a link (u, v); root is the component's smallest node."""
    spark = links.sparkSession
    first = new_path(spark, "links")
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", first)
    before, paths = None, [first]
    while True:
        digest = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(digest) == before or not digest["n"]:
            break
        before = tuple(digest)
        for large in (True, False):
            path = new_path(spark, "stars")
            edges = stored(_stars(edges, large), "stars", path)
            paths.append(path)
    dropped(spark, *paths[:-1])
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
