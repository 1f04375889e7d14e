"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendtrace.llm.staging import stored


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, component) for every id in ``edges``; component is the smallest id reachable.

    Each round hangs every node's larger neighbours on its smallest neighbour,
    then every node's smaller neighbours likewise (large-star and small-star).
    Stars come out after O(log^2 n) rounds whatever the shape, and each round's
    edge table has at most as many rows as there are edges. Reductions are
    map-side combined minima; joins are equi-joins that the engine splits where
    a node is hot. Nulls and self loops carry no link. Empty edges: no rows.
    """
    current = stored(
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a != b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("b", "m").where("b != m").union(low.select(F.col("a").alias("b"), "m"))
        following = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "small-star")
        # Stars: no node is both a child and a parent, and every child has one parent.
        parents = following.select(F.col("b").alias("a")).distinct()
        settled = following.join(parents, "a", "left_semi").limit(1).count() == 0
        single = settled and following.groupBy("a").count().where("count > 1").limit(1).count() == 0
        current = following
        if single:
            break
    roots = current.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
