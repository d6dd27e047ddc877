"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) for each node that an edge names.

    Each step is one aggregation, which combines before it shuffles, and one join, whose hot side
    Spark splits; so a star of millions of leaves isn't gathered in a task. Self loops and repeated
    edges are allowed; null ends are dropped. An empty table gives an empty one.
    """
    spark = edges.sparkSession
    links = save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    while not _flat(links):
        # Large-star: of u's neighbours (either way), those above u move to the least of u and its neighbours.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).persist()
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().persist()
        # Small-star: a node's lower neighbours, and the node itself, move to the least of them.
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).persist()
        pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
        small = save(large.join(lowest, "u").select(F.explode(F.array(pair("u", "m"), pair("v", "m"))).alias("e")).select("e.u", "e.v").where("u != v").distinct())
        for x in (least, large, lowest):
            x.unpersist()
        drop(spark, links)
        links = small
    tops = links.select(F.col("v").alias("node")).distinct()
    return save(links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component"))))


def _flat(links: DataFrame) -> bool:
    """Whether each node has one link at most, to a node without any: then the stars are the components."""
    if not links.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return links.select(F.col("v").alias("u")).distinct().join(links, "u", "left_semi").isEmpty()
