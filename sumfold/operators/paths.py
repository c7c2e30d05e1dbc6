"""Shortest distances: linear systems over (min, +), in dense blocks too, and relaxation over edges of any number."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumfold.functions.scratch import settled
from sumfold.functions.semiring import min_plus
from sumfold.operators import blocks, cores, pieces, regions
from sumfold.operators.closed import ClosedSystem
from sumfold.operators.graph import Digraph, UndirectedGraph
from sumfold.operators.matrix import Matrix
from sumfold.plans.elimination import EliminationOrder
from sumfold.plans.engine import Mode, query, solve
from sumfold.plans.triangulation import triangulated

TROPICAL = min_plus()


@dataclass(frozen=True)
class Query:
    sources: tuple
    target: Any


def system(graph: Digraph, labels: frozenset, target: Any) -> ClosedSystem:
    """M[u, v] is the cheapest edge from u to v; b is 0 at the target."""
    edges = graph.edges.groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.min("weight").alias("__value"))
    m = Matrix(TROPICAL, edges, labels, labels)
    b = graph.vertices.where(F.col("id") == F.lit(target)).select(F.col("id").alias("row"), F.lit(0.0).alias("__value"))
    return ClosedSystem.of(m, b)


def decomposition(graph: Digraph) -> list[Digraph]:
    """Subgraphs of the edges that leave a group of vertices, groups drawn around eliminated neighbourhoods; for small graphs."""
    near = {r["id"]: frozenset(r["neighbours"]) | {r["id"]} for r in graph.neighbours().collect()}
    if not near:
        return [graph]
    left, groups = dict(near), []
    for v in EliminationOrder([[str(x) for x in c] for c in near.values()]):
        group = [x for x, c in left.items() if v in map(str, c)]
        for x in group:
            del left[x]
        if group:
            groups.append(group)
    spark = graph.edges.sparkSession
    kind = dict(graph.vertices.dtypes)["id"]
    alone = [r["id"] for r in graph.vertices.collect() if r["id"] not in near]
    return [graph.outgoing_subgraph(spark.createDataFrame([(x,) for x in g], f"id {kind}")) for g in groups + ([alone] if alone else [])]


def clique_decomposition(graph: Digraph) -> list[Digraph]:
    """Subgraphs of the maximal cliques of the graph's triangulation, each edge in the first that has both its ends; for small graphs."""
    edges = graph.cheapest_edges().edges
    ends = [(r["src"], r["dst"]) for r in edges.select("src", "dst").collect()]
    vertices = [r["id"] for r in graph.vertices.collect()]
    _, cliques = triangulated(UndirectedGraph(vertices, [e for e in ends if e[0] != e[1]]))
    kind, spark = dict(graph.vertices.dtypes)["id"], graph.edges.sparkSession
    owner = [(s, d, next(i for i, c in enumerate(cliques) if s in c and d in c)) for s, d in ends]
    owned = edges.join(F.broadcast(spark.createDataFrame(owner, f"src {kind}, dst {kind}, nth int")), ["src", "dst"])
    of = lambda i, c: Digraph.of(owned.where(F.col("nth") == i).drop("nth"), spark.createDataFrame([(v,) for v in sorted(c)], f"id {kind}"))
    return [of(i, c) for i, c in enumerate(cliques)]


def _systems(graphs: Sequence[Digraph], target: Any) -> list[ClosedSystem]:
    return [system(g, frozenset(r["id"] for r in g.vertices.collect()), target) for g in graphs]


def single_target(graphs: Sequence[Digraph], asked: Query, mode: Mode = Mode.FUSION) -> list[float]:
    """The least distance from each source to the target over all graphs together; infinite if there is no way."""
    wanted = frozenset(asked.sources) | {asked.target}
    answer = query(_systems(graphs, asked.target), wanted, mode).solution()
    return _in_order(answer, asked.sources)


def single_target_solved(graphs: Sequence[Digraph], asked: Query) -> list[float]:
    """The same by an inward pass and solution extension."""
    wanted = frozenset(asked.sources) | {asked.target}
    return _in_order(solve(_systems(graphs, asked.target), wanted), asked.sources)


def single_targets(graphs: Sequence[Digraph], asked: Sequence[Query], mode: Mode | None = None) -> list[list[float]]:
    """One list of distances per query; all targets in one elimination, or with a ``mode`` target by target."""
    if mode is not None or not asked:
        return [single_target(graphs, q, mode) for q in asked]
    graph = Digraph.merged(list(graphs))
    kind = dict(graph.vertices.dtypes)["id"]
    targets = graph.edges.sparkSession.createDataFrame([(t,) for t in {q.target for q in asked}], f"id {kind}")
    sources = {s for q in asked for s in q.sources}
    # as many rows as there are sources and targets asked for
    found = {(r["id"], r["target"]): r["distance"] for r in to_targets(graph, targets).where(F.col("id").isin(list(sources))).collect()}
    return [[found.get((s, q.target), math.inf) for s in q.sources] for q in asked]


def _cells(graph: Digraph) -> DataFrame:
    return graph.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").cast("double").alias("__value"))


def to_targets(graph: Digraph, targets: DataFrame, size: int = blocks.SIZE, local: int = cores.LOCAL, held: int = pieces.HELD) -> DataFrame:
    """(id, target, distance) from every vertex that reaches a target (id): one linear system with a right-hand side per target.

    Vertices of few neighbours are eliminated as they are, and the rest, among them the targets, is dense, by components of up to ``local`` vertices; a component of
    up to ``held`` edges is solved in one task, and its targets by pieces. Larger cores are solved in blocks, whose work grows with the cube of the vertices. Negative weights are allowed. ``distances`` does better on sparse graphs without these.
    """
    cells = _settled_cells(graph)
    asked = targets.where("id IS NOT NULL").select(F.col("id").alias("label")).distinct()
    p = pieces.of(cells, "targets", asked, local, held)
    found = lambda df: df.select(F.col("row").alias("id"), F.col("col").alias("target"), F.col("__value").alias("distance"))
    # targets without edges reach themselves
    alone = _alone(p, asked).select(F.col("label").alias("id"), F.col("label").alias("target"), F.lit(0.0).alias("distance"))
    out = found(pieces.targets(p)).unionByName(alone)
    if p.left is not None:
        apart = lambda labels: labels.join(_left(p), "label", "left_semi")
        out = out.unionByName(_to_targets(_cells_left(p, cells), apart(asked), size, local))
    return out


def _to_targets(cells: DataFrame, targets: DataFrame, size: int, local: int) -> DataFrame:
    """``to_targets`` of components too large for a task, all of whose labels have edges."""
    targets = settled(targets)
    cells, system = _split(cells, targets, local)
    right = targets.select(F.col("label").alias("row"), F.col("label").alias("col"), F.lit(0.0).alias("__value"))
    found = lambda df: df.select(F.col("row").alias("id"), F.col("col").alias("target"), F.col("__value").alias("distance"))
    if system is None:
        return found(blocks.solution(cells, right, TROPICAL, size))
    out = found(cores.extended(system, cores.solved(system, right.select(F.col("row").alias("label"), F.col("col").alias("target"), F.col("__value").alias("v")))))
    if system.large is not None:
        held = system.large.withColumnRenamed("label", "row")
        out = out.unionByName(found(blocks.solution(cells.join(held, "row", "left_semi"), right.join(held, "row", "left_semi"), TROPICAL, size)))
    return out


def _settled_cells(graph: Digraph) -> DataFrame:
    return settled(_cells(graph).where("row IS NOT NULL AND col IS NOT NULL"))


def _alone(p: pieces.Pieces, labels: DataFrame) -> DataFrame:
    """Those without edges."""
    return labels.join(p.comps.select(F.col("node").alias("label")), "label", "left_anti")


def _left(p: pieces.Pieces) -> DataFrame:
    """(label) of the components that are left over."""
    return p.comps.join(p.left.select(F.col("comp").alias("component")), "component", "left_semi").select(F.col("node").alias("label"))


def _cells_left(p: pieces.Pieces, cells: DataFrame) -> DataFrame:
    return cells.join(_left(p).withColumnRenamed("label", "row"), "row", "left_semi")


def _split(cells: DataFrame, fixed: DataFrame | None, local: int) -> tuple[DataFrame, cores.Split | None]:
    """The least of each place of a matrix, and its core and what is around it."""
    cells = settled(cells.groupBy("row", "col").agg(F.min("__value").alias("__value")))
    return cells, cores.split(cells, TROPICAL, fixed, local)


def to_targets_by_regions(graph: Digraph, targets: DataFrame, size: int = regions.SIZE, small: int = regions.SMALL) -> DataFrame:
    """The same as ``to_targets`` for large sparse graphs: cut into regions of ``size`` vertices, only separators are combined.

    Rounds go by the logarithm of a region's size and the number of blocks of ``small`` separators, not by the edges of the longest way.
    """
    right = targets.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(0.0).alias("__value"))
    found = regions.solution(_cells(graph), right, TROPICAL, size, small)
    return found.select(F.col("row").alias("id"), F.col("col").alias("target"), F.col("__value").alias("distance"))


def all_pairs(graph: Digraph, size: int = blocks.SIZE) -> DataFrame:
    """(src, dst, distance) of all vertices: the star of the matrix of edges, in blocks."""
    found = blocks.star(_cells(graph), TROPICAL, graph.vertices.select(F.col("id").alias("label")), size)
    return found.select(F.col("row").alias("src"), F.col("col").alias("dst"), F.col("__value").alias("distance"))


def reach(graph: Digraph, size: int = blocks.SIZE, local: int = cores.LOCAL, held: int = pieces.HELD) -> DataFrame:
    """(id, reached, total, farthest): how many vertices each one reaches, itself included, and the sum and the largest of their distances.

    These are the rows of ``all_pairs``, folded where they are computed, components and their pieces as in ``to_targets``: pairs are not written out, but for those of components with a core of more than ``local`` vertices.
    """
    cells = _settled_cells(graph)
    p = pieces.of(cells, "reach", None, local, held)
    vertices = graph.vertices.where("id IS NOT NULL").select(F.col("id").alias("label"))
    out = pieces.reach(p).withColumnRenamed("label", "id")
    out = out.unionByName(_alone(p, vertices).select(F.col("label").alias("id"), F.lit(1).cast("bigint").alias("reached"), F.lit(0.0).alias("total"), F.lit(0.0).alias("farthest")))
    return out if p.left is None else out.unionByName(_reach(_cells_left(p, cells), size, local))


def _reach(cells: DataFrame, size: int, local: int) -> DataFrame:
    """``reach`` of components too large for a task."""
    cells, system = _split(cells, None, local)
    folded = lambda df: df.groupBy(F.col("row").alias("id")).agg(F.count("*").alias("reached"), F.sum("__value").alias("total"), F.max("__value").alias("farthest"))
    if system is None:
        return folded(blocks.star(cells, TROPICAL, cells.select(F.col("row").alias("label")).union(cells.select("col")).distinct(), size))
    out = cores.reach(system).withColumnRenamed("label", "id")
    if system.large is not None:
        held = cells.join(system.large.withColumnRenamed("label", "row"), "row", "left_semi")
        out = out.unionByName(folded(blocks.star(held, TROPICAL, system.large, size)))
    return out


def _in_order(answer: DataFrame, sources: Sequence) -> list[float]:
    # as many rows as sources
    found: Mapping = {r["row"]: r["__value"] for r in answer.where(F.col("row").isin(list(sources))).collect()}
    return [found.get(s, math.inf) for s in sources]


def distances(graph: Digraph, targets: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, target, distance) from every vertex that reaches a target (id), for all targets in one run.

    Relaxation: each round joins what has become shorter with the edges that lead there, and writes what is shorter than
    all that is known. No matrix is built; earlier rounds' rows are read, not written again. Weights are not negative.
    """
    edges = settled(graph.cheapest_edges().edges)
    if not edges.where("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    fresh = settled(targets.select("id", F.col("id").alias("target"), F.lit(0.0).alias("distance")))
    rows, done = [fresh], 0
    known = lambda: reduce(DataFrame.unionByName, rows).groupBy("id", "target").agg(F.min("distance").alias("distance"))
    while not fresh.isEmpty() and (rounds is None or done < rounds):
        step = fresh.join(edges, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "target", (F.col("distance") + F.col("weight")).alias("new"))
        step = step.groupBy("id", "target").agg(F.min("new").alias("new"))
        better = step.join(known(), ["id", "target"], "left").where("distance IS NULL OR new < distance")
        fresh = settled(better.select("id", "target", F.col("new").alias("distance")))
        rows.append(fresh)
        if len(rows) > 16:
            rows = [settled(known())]
        done += 1
    return known()


#: Whole numbers that a double holds.
_EXACT = 2**53


def routes(graph: Digraph, targets: DataFrame, local: int = cores.LOCAL, held: int = pieces.HELD, separator: str | None = None) -> DataFrame:
    """(id, target, distance, hops, route): a shortest way from every vertex to each target (id) that it reaches, as the vertices on it or, with a ``separator``, as text.

    Of ways of one length the one of fewest edges is taken, then the one whose next vertex is least. Weights are not negative. Whole numbers, with whose sums a
    double can hold the number of edges too, make a system that is solved around its core, as in ``to_targets``, and ways are read off its solution. Other weights and
    components with a core of more than ``local`` vertices are relaxed.
    """
    edges = settled(graph.edges.where("src <> dst"))
    if not edges.where("weight < 0").isEmpty():
        raise ValueError("weights must not be negative")
    cells = edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").cast("double").alias("__value"))
    asked = targets.where("id IS NOT NULL").select(F.col("id").alias("label")).distinct()
    p = pieces.of(cells, "routes", asked, local, held)
    text = separator if p.label in ("bigint", "int", "smallint", "tinyint", "string") else None
    joined = lambda df: df if separator is None else df.withColumn("route", F.array_join(F.transform("route", lambda x: x.cast("string")), separator))
    found = pieces.routes(p, text).withColumnRenamed("label", "id")
    out = found if text is not None else joined(found)
    # targets without edges
    alone = _alone(p, asked).select(F.col("label").alias("id"), F.col("label").alias("target"), F.lit(0.0).alias("distance"), F.lit(0).cast("bigint").alias("hops"), F.array("label").alias("route"))
    out = out.unionByName(joined(alone))
    if p.left is not None:
        left = _left(p).withColumnRenamed("label", "src")
        rest = settled(asked.withColumnRenamed("label", "src").join(left, "src", "left_semi").select(F.col("src").alias("id")))
        out = out.unionByName(joined(_routes(settled(edges.join(left, "src", "left_semi").groupBy("src", "dst").agg(F.min("weight").alias("weight"))), rest, local)))
    return out


def _routes(edges: DataFrame, targets: DataFrame, local: int) -> DataFrame:
    """``routes`` of components too large for a task, or whose weights are not whole numbers, from settled edges."""
    # one edge more counts less than any difference of lengths
    count = edges.select("src").union(edges.select("dst")).distinct().count()
    step = 1 << count.bit_length()
    longest = edges.agg(F.max(F.col("weight").cast("double"))).first()[0] or 0.0
    whole = longest * count * step < _EXACT and edges.where("weight IS NULL OR isnan(weight) OR weight <> floor(weight)").isEmpty()
    system = None
    if whole:
        cells = settled(edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").alias("row"), F.col("dst").alias("col"), (F.col("weight").cast("double") * step + 1).alias("__value")))
        system = cores.split(cells, TROPICAL, targets.select(F.col("id").alias("label")), local)
    if system is None:
        return _relaxed(edges, targets)
    asked = targets.where("id IS NOT NULL").select(F.col("id").alias("label"), F.col("id").alias("target"), F.lit(0.0).alias("v")).distinct()
    found = cores.ways(system, cores.solved(system, asked, 256))
    out = found.select(F.col("label").alias("id"), "target", F.floor(F.col("code") / step).cast("double").alias("distance"), (F.col("code") % step).cast("bigint").alias("hops"), "route")
    rest = asked.join(system.numbers, "label", "left_anti").select(F.col("label").alias("id"))
    return out if rest.isEmpty() else out.unionByName(_relaxed(edges.join(_or_none(system, cells), "src", "left_semi"), rest))


def _or_none(system: cores.Split, cells: DataFrame) -> DataFrame:
    """(src) of the components that are left."""
    large = cells.select(F.col("row").alias("label")).limit(0) if system.large is None else system.large
    return large.withColumnRenamed("label", "src")


def _relaxed(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """``routes`` by relaxation over settled edges, as in ``distances``; what is relaxed carries the number of edges and the next vertex.

    Ways are put together in as many rounds as the logarithm of their edges.
    """
    edges = settled(edges)
    best = F.min(F.struct("distance", "hops", "via")).alias("best")
    none = F.lit(None).cast(dict(edges.dtypes)["src"])
    fresh = settled(targets.select("id", F.col("id").alias("target"), F.struct(F.lit(0.0).alias("distance"), F.lit(0).cast("bigint").alias("hops"), none.alias("via")).alias("best")).distinct())
    rows = [fresh]
    known = lambda: reduce(DataFrame.unionByName, rows).groupBy("id", "target").agg(F.min("best").alias("best"))
    while not fresh.isEmpty():
        step = fresh.join(edges, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "target", (F.col("best.distance") + F.col("weight")).alias("distance"), (F.col("best.hops") + 1).alias("hops"), F.col("dst").alias("via"))
        step = step.groupBy("id", "target").agg(best).withColumnRenamed("best", "new")
        better = step.join(known(), ["id", "target"], "left").where("best IS NULL OR new < best")
        fresh = settled(better.select("id", "target", F.col("new").alias("best")))
        rows.append(fresh)
        if len(rows) > 16:
            rows = [settled(known())]
    found = settled(known().select("id", "target", "best.*"))
    longest = found.agg(F.max("hops")).first()[0] or 0
    ways = found.select("id", "target", F.when(F.col("hops") > 0, F.array("id")).otherwise(F.array().cast(f"array<{dict(found.dtypes)['id']}>")).alias("way"), F.coalesce("via", "id").alias("end"))
    done = 1
    while done < longest:
        further = ways.select(F.col("id").alias("end"), "target", F.col("way").alias("more"), F.col("end").alias("last"))
        ways = settled(ways.join(further, ["end", "target"]).select("id", "target", F.concat("way", "more").alias("way"), F.col("last").alias("end")))
        done *= 2
    return found.join(ways, ["id", "target"]).select("id", "target", "distance", "hops", F.concat("way", F.array("target")).alias("route"))


def single_target_of(graph: Digraph, asked: Query, mode: Mode = Mode.FUSION) -> list[float]:
    """``single_target`` of one graph, split by ``decomposition`` first."""
    return single_target(decomposition(graph), asked, mode)
