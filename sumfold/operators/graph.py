"""Weighted directed graphs as two DataFrames, and small undirected ones of variables on the driver."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumfold.operators.components import components


@dataclass(frozen=True)
class Digraph:
    """``edges`` (src, dst, weight), parallel ones allowed, and ``vertices`` (id), also such without edges."""

    edges: DataFrame
    vertices: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None) -> "Digraph":
        ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        ends = ends if vertices is None else ends.union(vertices.select("id"))
        return cls(edges.select("src", "dst", "weight"), ends.distinct())

    @classmethod
    def from_adjacency(cls, spark: SparkSession, adjacency: Mapping[int, Iterable[tuple[int, float]]]) -> "Digraph":
        edges = [(int(s), int(d), float(w)) for s, arcs in adjacency.items() for d, w in arcs]
        return cls.of(spark.createDataFrame(edges, "src bigint, dst bigint, weight double"), spark.createDataFrame([(int(v),) for v in adjacency], "id bigint"))

    def vertex_count(self) -> int:
        return self.vertices.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def is_empty(self) -> bool:
        return self.vertices.isEmpty()

    def flipped(self) -> "Digraph":
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def with_self_loops(self, weight: float = 0.0) -> "Digraph":
        return replace(self, edges=self.edges.unionByName(self.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(weight).alias("weight"))))

    def has_zero_self_loops(self) -> bool:
        loops = self.edges.where("src = dst AND weight = 0").select(F.col("src").alias("id"))
        return self.vertices.join(loops, "id", "left_anti").isEmpty()

    @staticmethod
    def merged(graphs: Iterable["Digraph"]) -> "Digraph":
        """All edges, as often as they come."""
        graphs = list(graphs)
        return Digraph(reduce(DataFrame.unionByName, [g.edges for g in graphs]), reduce(DataFrame.union, [g.vertices for g in graphs]).distinct())

    def cheapest_edges(self) -> "Digraph":
        return replace(self, edges=self.edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))

    def map_weights(self, f) -> "Digraph":
        return replace(self, edges=self.edges.withColumn("weight", f(F.col("weight"))))

    def asymmetric_edges(self) -> DataFrame:
        """Edges without one of equal weight the other way."""
        back = self.flipped().edges
        return self.edges.join(back, ["src", "dst", "weight"], "left_anti")

    def is_undirected(self) -> bool:
        return self.asymmetric_edges().isEmpty()

    def neighbour_pairs(self) -> DataFrame:
        """(id, neighbour): ends of edges either way, each pair once, without the vertex itself; for vertices of any number of neighbours."""
        both = self.edges.select("src", "dst").union(self.edges.select("dst", "src")).where("src <> dst")
        return both.select(F.col("src").alias("id"), F.col("dst").alias("neighbour")).distinct()

    def neighbours(self) -> DataFrame:
        """(id, neighbours): the same, a sorted list by vertex, which one row must hold."""
        return self.neighbour_pairs().groupBy("id").agg(F.sort_array(F.collect_list("neighbour")).alias("neighbours"))

    def adjacency(self) -> DataFrame:
        """(id, arcs): outgoing edges as (dst, weight), sorted; vertices without any have none."""
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "weight"))).alias("arcs"))
        return self.vertices.join(out, "id", "left")

    def reverse_adjacency(self) -> DataFrame:
        return self.flipped().adjacency()

    def outgoing_subgraph(self, ids: DataFrame) -> "Digraph":
        """The vertices ``ids`` with all edges that leave them."""
        return Digraph.of(self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi"), self.vertices.join(ids, "id", "left_semi"))

    def induced(self, ids: DataFrame) -> "Digraph":
        inside = self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Digraph(inside.select("src", "dst", "weight"), self.vertices.join(ids, "id", "left_semi"))

    def without(self, ids: DataFrame) -> "Digraph":
        return self.induced(self.vertices.join(ids, "id", "left_anti"))

    def components(self) -> DataFrame:
        """(id, component): the least vertex that edges lead to, directions aside."""
        found = components(self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "id")
        return self.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    def is_connected(self) -> bool:
        """Weakly, by edges: vertices without any do not count."""
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst")).distinct()
        return self.components().join(ends, "id", "left_semi").select("component").distinct().limit(2).count() <= 1


class UndirectedGraph:
    """A graph of variables: no loops, no parallel edges; small, on the driver."""

    def __init__(self, vertices: Iterable[Any] = (), edges: Iterable[tuple[Any, Any]] = ()):
        self.near: dict[Any, set] = {v: set() for v in vertices}
        for a, b in edges:
            self.add_edge(a, b)

    @classmethod
    def of_cliques(cls, cliques: Iterable[Collection]) -> "UndirectedGraph":
        g = cls()
        for c in cliques:
            for a in c:
                g.near.setdefault(a, set()).update(x for x in c if x != a)
        return g

    def add_edge(self, a: Any, b: Any) -> None:
        if a == b:
            raise ValueError("no loops")
        self.near.setdefault(a, set()).add(b)
        self.near.setdefault(b, set()).add(a)

    def remove_edge(self, a: Any, b: Any) -> None:
        self.near[a].discard(b)
        self.near[b].discard(a)

    def add_vertex(self, v: Any) -> None:
        self.near.setdefault(v, set())

    def remove_vertex(self, v: Any) -> None:
        for n in self.near.pop(v):
            self.near[n].discard(v)

    def copy(self) -> "UndirectedGraph":
        g = UndirectedGraph()
        g.near = {v: set(n) for v, n in self.near.items()}
        return g

    def union(self, other: "UndirectedGraph") -> "UndirectedGraph":
        g = self.copy()
        for v, n in other.near.items():
            g.near.setdefault(v, set()).update(n)
        return g

    def induced(self, vertices: Collection) -> "UndirectedGraph":
        keep = set(vertices)
        g = UndirectedGraph()
        g.near = {v: n & keep for v, n in self.near.items() if v in keep}
        return g

    def vertices(self) -> set:
        return set(self.near)

    def edges(self) -> set[frozenset]:
        return {frozenset((a, b)) for a, n in self.near.items() for b in n}

    def is_complete(self) -> bool:
        return all(len(n) == len(self.near) - 1 for n in self.near.values())


