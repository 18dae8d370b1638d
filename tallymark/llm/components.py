"""Connected components of an edge table by large-star and small-star steps, each a join and written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.vocabulary import write_shared


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least of u and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame, write=write_shared) -> DataFrame:
    """``node``, ``label`` (the least node of its component) for every node of the edges ``u``, ``v``.

    ``write`` stores the table of each round. The number of rounds grows with the logarithm of the longest path; hubs are joins that Spark can split.
    """
    stars = write(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    seen = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = _least_neighbour(large)
        small = down.select("v", "m").union(down.select("u", "m")).toDF("u", "v").filter("u <> v").distinct()
        stars = write(small, "stars")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    tops = stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(tops)
