"""Connected components of a graph of any size, by joins and grouped minima."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.functions.scratch import settled


def components(links: DataFrame, kept: Callable[[DataFrame], DataFrame] = settled) -> DataFrame:
    """(node, component): of each node in ``links`` (a, b), the least node that links lead to; nodes are of any type with an order.

    Large stars and small stars take turns until nothing changes, which takes about as many rounds as the
    logarithm of the longest path. Each round hangs nodes to the least one they know, so that no
    node's neighbours meet in one place: minima are taken per task first, and ``kept`` before they are joined,
    which lets a join split a node of very many neighbours.
    """
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: every larger neighbour hangs to the least of the neighbourhood
        both = edges.select("u", "v").union(edges.select("v", "u"))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
        large = kept(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: every smaller neighbour, and the node itself, hang to the least one
        least = kept(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), "m", "n"))
        joined = large.join(least, F.col("u") == F.col("w"))
        more = (F.col("n") > 1).alias("more")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v"), more).where("u <> v").union(joined.select("u", F.col("m").alias("v"), more))
        edges = kept(small.groupBy("u", "v").agg(F.max("more").alias("more")))
        # stars already: no node hung to two, and no centre hangs to another node
        if edges.where("more").isEmpty() and edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v").distinct()).groupBy("node").agg(F.min("component").alias("component"))


#: Pairs that one task contracts at last.
_LAST = 1 << 22


def contracted(links: DataFrame, last: int = _LAST) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b), a node's own link included: tasks contract what they hold to stars until ``last`` pairs or fewer
    are left, which one task puts together. Where they do not become fewer it is ``components`` that goes on."""
    kind = dict(links.dtypes)["a"]
    held = settled(links.select("a", "b").mapInArrow(_stars, f"a {kind}, b {kind}"))
    count = held.count()
    while count > last:
        tasks = max(1, held.rdd.getNumPartitions() // 8)
        fewer = settled(held.repartition(tasks, "a").mapInArrow(_stars, f"a {kind}, b {kind}")) if tasks > 1 else held
        before, count = count, fewer.count() if tasks > 1 else count
        held = fewer
        if count > last and count * 2 > before:
            alone = held.select(F.col("a").alias("node"), F.col("a").alias("component"))
            found = components(held)
            return found.unionByName(alone.join(found, "node", "left_anti").distinct())
    return settled(held.repartition(1).mapInArrow(_stars, f"a {kind}, b {kind}").toDF("node", "component"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's links with one node of its component there, stars being folded whenever there are many links."""
    held: list[pa.RecordBatch] = []

    def star() -> pa.Table:
        table = pa.Table.from_batches(held)
        n = len(table)
        coded = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (table["a"], table["b"])]).dictionary_encode()
        code = coded.indices.to_numpy()
        a, b, root = code[:n], code[n:], np.arange(len(coded.dictionary))
        while len(a):
            u, v = root[a], root[b]
            apart = u != v
            a, b, u, v = a[apart], b[apart], u[apart], v[apart]
            root[np.maximum(u, v)] = np.minimum(u, v)
            while not np.array_equal(above := root[root], root):
                root = above
        return pa.table({"a": coded.dictionary, "b": coded.dictionary.take(pa.array(root))})

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) > 1 << 21:
            folded = star()
            # few are left, or it would be folded in vain each time
            if len(folded) > 1 << 20:
                yield from folded.to_batches(1 << 16)
                held = []
            else:
                held = folded.to_batches()
    if held:
        yield from star().to_batches(1 << 16)
