"""Connected components of a graph of any size, by joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): of each node in ``links`` (a, b), the least node that links lead to.

    Large stars and small stars take turns until nothing changes, which takes about as many rounds as the
    logarithm of the longest path. Each round hangs nodes to the least one they know, so that no
    node's neighbours meet in one place: minima are taken per task first.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        # large star: every larger neighbour hangs to the least of the neighbourhood
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        # small star: every smaller neighbour, and the node itself, hang to the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), "m", "n")
        joined = large.join(least, F.col("u") == F.col("w"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("n") > 1).alias("more")).where("u <> v").union(joined.select("u", F.col("m").alias("v"), (F.col("n") > 1).alias("more")))
        edges = written(small.groupBy("u", "v").agg(F.max("more").alias("more")), "links")
        # stars already: no node hung to two, and no centre hangs to another node
        if edges.where("more").isEmpty() and edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        edges = edges.drop("more")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v").distinct()).groupBy("node").agg(F.min("component").alias("component"))
