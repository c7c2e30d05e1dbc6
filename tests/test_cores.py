"""Systems of a sparse part around a core against dense ones."""

from functools import partial

import numpy as np
import pytest

from sumfold.functions.semiring import sum_product
from sumfold.operators import blocks, cores, paths
from sumfold.operators.graph import Digraph


def spread(spark, copies=2, hubs=5, others=30, seed=5):
    """Hubs (below zero) and vertices at some of them, one way or both, with loops, edges between hubs and, in the first copy, an end that nothing leaves; copies are apart."""
    r, rows = np.random.default_rng(seed), []
    for c in range(copies):
        hub = [-1 - c * hubs - h for h in range(hubs)]
        for i in range(others):
            for h in r.choice(hubs, 3, replace=False):
                rows += [(c * others + i, hub[h], float(r.integers(1, 50)))] * int(r.integers(1, 3)) + [(hub[h], c * others + i, float(r.integers(1, 50)))] * int(r.integers(0, 2))
        rows += [(hub[0], hub[1], 2.0), (c * others, c * others, 3.0), (hub[2], hub[2], 1.0)]
    rows += [(0, 1000, 7.0), (-1, 1000, -0.5)]
    return Digraph.of(spark.createDataFrame(rows, "src bigint, dst bigint, weight double"), spark.createDataFrame([(2000,)], "id bigint"))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


@pytest.mark.parametrize("local", [cores.LOCAL, 3])
def test_targets_and_rows_of_the_star_are_those_of_dense_blocks(spark, monkeypatch, local):
    graph = spread(spark)
    targets = graph.vertices.where("id < 0 OR id = 2000")
    pairs = paths.all_pairs(graph).cache()
    to = rows(pairs.join(targets.withColumnRenamed("id", "dst"), "dst"), "src", "dst", "distance")
    folded = rows(pairs.groupBy("src").agg({"*": "count", "distance": "sum"}), "src", "count(1)", "sum(distance)")
    most = dict(rows(pairs.groupBy("src").agg({"distance": "max"}), "src", "max(distance)"))
    if local == cores.LOCAL:
        # neither the whole nor a core is dense in blocks
        monkeypatch.setattr(paths.blocks, "solution", None)
        monkeypatch.setattr(paths.blocks, "star", None)
        monkeypatch.setattr(cores, "WIDE_EDGES", 40)
        monkeypatch.setattr(cores, "reach", partial(cores.reach, edges=20))
    assert rows(paths.to_targets(graph, targets, local=local), "id", "target", "distance") == to
    found = paths.reach(graph, local=local)
    assert rows(found, "id", "reached", "total") == folded
    assert dict(rows(found, "id", "farthest")) == most


def test_numbers_in_panels_and_chunks(spark):
    r, n = np.random.default_rng(6), 24
    a = np.zeros((n, n))
    for i in range(4, n):
        for j in r.choice(4, 2, replace=False):
            a[i, j], a[j, i] = r.random() / 9, r.random() / 9
        a[i, i] = r.random() / 3
    cells = spark.createDataFrame([(f"l{i}", f"l{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))], "row string, col string, __value double")
    b = np.zeros((n, 5))
    b[:4] = r.random((4, 5))
    right = spark.createDataFrame([(f"l{i}", int(j), float(b[i, j])) for i, j in zip(*np.nonzero(b))], "label string, target int, v double")
    s = cores.split(cells, sum_product(), right.select("label").distinct())
    got = np.zeros((n, 5))
    for x in cores.extended(s, cores.solved(s, right, width=2), edges=7).collect():
        got[int(x["row"][1:]), x["col"]] += x["__value"]
    assert np.allclose(got, np.linalg.solve(np.eye(n) - a, b))


def test_graphs_without_a_sparse_part_stay_dense(spark):
    n = 7
    graph = Digraph.of(spark.createDataFrame([(i, j, float((i * j) % 7 + 1)) for i in range(n) for j in range(n) if i != j], "src bigint, dst bigint, weight double"))
    assert rows(paths.to_targets(graph, spark.range(2)), "id", "target", "distance") == rows(paths.distances(graph, spark.range(2)), "id", "target", "distance")
    pairs = blocks.star(spark.createDataFrame([], "row bigint, col bigint, __value double"), paths.TROPICAL, spark.range(2).selectExpr("id AS label"))
    assert pairs.count() == paths.reach(Digraph.of(graph.edges.limit(0), spark.range(2))).count() == 2


def test_routes_around_a_core_are_those_of_relaxation(spark, monkeypatch):
    graph = spread(spark)
    graph = Digraph.of(graph.edges.where("weight > 0").selectExpr("src", "dst", "ceil(weight / 10) AS weight"), graph.vertices)
    targets = graph.vertices.where("id < 0")
    columns, plain = ("id", "target", "distance", "hops", "route"), paths._relaxed
    expected = rows(plain(graph.cheapest_edges().edges.where("src <> dst"), targets), *columns)
    # components of more than three core labels are relaxed
    alone = graph.vertices.where("id < 0 OR id = 2000")
    assert rows(paths.routes(graph, alone, local=3), *columns) == sorted([*expected, (2000, 2000, 0.0, 0, [2000])])
    monkeypatch.setattr(paths, "_relaxed", None)
    monkeypatch.setattr(cores, "ways", partial(cores.ways, edges=20))
    assert rows(paths.routes(graph, targets), *columns) == expected
