"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepane.sources.shared import stage


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges``: ``a, b`` (comparable ids). Returns ``id, component`` (the smallest id reachable)
    for every id that has an edge to another. Raises if ``most_rounds`` do not suffice.

    Each round writes the edges to the shared folder. Minima are aggregated before the shuffle, so
    a centre with very many neighbours is no large group; joins on it can be split when skewed.
    """
    edges = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        size = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == before:
            break
        before = size
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = both.where("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.union(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components are not final after {most_rounds} rounds")
    ends = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = edges.select(F.col("v").alias("id")).distinct().join(ends.select("id"), "id", "left_anti")
    return ends.union(roots.select("id", F.col("id").alias("component")))
