"""Connected components of a graph of any size, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.frames import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. ("Connected
    Components in MapReduce and Beyond", 2014). Nodes are joined by their own value
    and minima are combined before the shuffle, so a node with very many neighbours
    is a skewed join at worst, which adaptive execution splits. Every round is a
    stored table; the number of rounds grows with the logarithm of the longest path. One grouped pass tells
    whether another round is needed, so a graph that is made of stars already costs none.
    Loops and NULL ends are ignored. No edges: no rows.
    """
    kind = edges.schema["a"].dataType
    stars = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("a is not null and b is not null and u <> v")
        .distinct(),
        "edges",
    )
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.sum(F.expr("CAST(v < u AS BIGINT)")).alias("below"), F.count("*").alias("edges"))
        # Done when every node hangs from one smaller node that hangs from none.
        if not near.filter("below > 1 or below = 1 and edges > 1").agg(F.count("*")).first()[0]:
            break
        least = both.groupBy(F.col("u").alias("c")).agg(F.least("c", F.min("v")).alias("m"))
        large = both.join(least, both.u == least.c).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(least, large.u == least.c)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        stars = stored(small.filter("u <> v").distinct(), "edges")
    return (
        stars.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("component"))
        .unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .distinct()
    )
