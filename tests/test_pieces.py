"""Systems by components that one task takes each, against dense blocks, relaxation and the ways around a core."""

import numpy as np
import pytest
from test_cores import rows, spread

from sumfold.functions.dense import dense
from sumfold.functions.semiring import min_plus
from sumfold.operators import components, cores, paths, pieces
from sumfold.operators.graph import Digraph


@pytest.fixture
def whole(spark):
    """Weights above zero, whole."""
    graph = spread(spark)
    return Digraph.of(graph.edges.where("weight > 0").selectExpr("src", "dst", "ceil(weight / 10) AS weight"), graph.vertices)


def expected(graph, targets):
    """Rows of ``to_targets`` and of ``reach``, by the closure of one dense matrix."""
    ids, asked = sorted(r[0] for r in graph.vertices.collect()), {r[0] for r in targets.collect()}
    d, at = dense(min_plus()), {v: i for i, v in enumerate(ids)}
    a = d.zeros(len(ids), len(ids))
    for s, t, w in graph.edges.collect():
        if w is not None:
            a[at[s], at[t]] = min(a[at[s], at[t]], w)
    a = d.closure(a)
    to = [(s, t, float(a[at[s], at[t]])) for s in ids for t in ids if t in asked and a[at[s], at[t]] < np.inf]
    return to, [(s, len(x), float(x.sum()), float(x.max())) for s in ids for x in [a[at[s]][a[at[s]] < np.inf]]]


@pytest.mark.parametrize("held", [pieces.HELD, 60])
def test_targets_and_reach_by_components(spark, monkeypatch, whole, held):
    # a component of its own beside those that are left over
    edges = whole.edges.union(spark.createDataFrame([(5000, 5001, 2), (5001, 5002, 3), (5002, 5000, 4)], "src bigint, dst bigint, weight bigint"))
    graph = Digraph.of(edges, whole.vertices)
    targets = graph.vertices.where("id < 0 OR id IN (2000, 5001)")
    to, folded = expected(graph, targets)
    if held == pieces.HELD:
        # nothing goes round a core by joins
        monkeypatch.setattr(cores, "split", None)
        monkeypatch.setattr(pieces, "CELLS", 300)
        monkeypatch.setattr(pieces, "SUMS", 900)
    assert rows(paths.to_targets(graph, targets, held=held), "id", "target", "distance") == to
    assert rows(paths.reach(graph, held=held), "id", "reached", "total", "farthest") == folded


@pytest.mark.parametrize("factor", [1, 500, 10**6, 0.5, -1])
def test_numbers_of_each_width(spark, factor):
    """16 and 32 bits, doubles, and edges below zero."""
    graph = Digraph.of(spread(spark).edges.selectExpr("src", "dst", f"weight * {factor if factor > 0 else 1} AS weight").where("weight > 0 OR src <> -1" if factor > 0 else "true"))
    if factor == 10**6:
        graph = Digraph.of(graph.edges.selectExpr("src", "dst", "weight * 1000 AS weight"))
    targets = graph.vertices.where("id < 0")
    to, folded = expected(graph, targets)
    assert rows(paths.to_targets(graph, targets), "id", "target", "distance") == to
    assert rows(paths.reach(graph), "id", "reached", "total", "farthest") == folded


def test_a_cycle_without_end(spark):
    graph = Digraph.of(spark.createDataFrame([(1, 2, 1.0), (2, 1, -3.0), (3, 1, 1.0), (4, 4, -1.0), (5, 4, 2.0), (4, 5, 2.0), (6, 3, None), (6, 1, float("inf"))], "src bigint, dst bigint, weight double"))
    to, folded = expected(graph, graph.vertices)
    assert rows(paths.to_targets(graph, graph.vertices), "id", "target", "distance") == to
    assert rows(paths.reach(graph), "id", "reached", "total", "farthest") == folded


def test_targets_of_a_wider_type(spark):
    graph = Digraph.of(spark.createDataFrame([(1, 2, 3.0)], "src int, dst int, weight double"))
    assert rows(paths.to_targets(graph, spark.range(2, 4)), "id", "target", "distance") == [(1, 2, 3.0), (2, 2, 0.0), (3, 3, 0.0)]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_routes_as_labels_and_as_text(spark, monkeypatch, whole, kind):
    graph = Digraph.of(whole.edges.selectExpr(f"cast(src AS {kind}) AS src", f"cast(dst AS {kind}) AS dst", "weight"))
    targets = graph.vertices.where("id < 0")
    columns = ("id", "target", "distance", "hops", "route")
    relaxed = rows(paths._relaxed(graph.cheapest_edges().edges.where("src <> dst"), targets), *columns)
    if kind == "string":
        assert rows(paths.routes(graph, targets, held=100), *columns) == relaxed
    for name in ("_relaxed", "_routes"):
        monkeypatch.setattr(paths, name, None)
    monkeypatch.setattr(pieces, "_WAYS", 20)
    monkeypatch.setattr(pieces, "_BATCH", 50)
    assert rows(paths.routes(graph, targets), *columns) == relaxed
    text = rows(paths.routes(graph, targets, separator=">"), *columns)
    assert text == [(*r[:4], ">".join(map(str, r[4]))) for r in relaxed]


def test_components_by_contraction(spark):
    r = np.random.default_rng(3)
    pairs = [(int(a), int(a) + int(b)) for a, b in zip(r.integers(0, 900, 700), r.integers(0, 3, 700))]
    links = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(9)
    names = dict(rows(components.components(links), "node", "component"))
    for last in (components._LAST, 100, 1):
        found = rows(components.contracted(links, last), "node", "component")
        assert [n for n, _ in found] == sorted({x for p in pairs for x in p})
        assert len({c for _, c in found}) == len({(c, names.get(n, n)) for n, c in found}) == len({names.get(n, n) for n, _ in found})
