"""Systems cut into regions against dense ones and relaxation."""

import numpy as np
import pytest

from sumfold.functions.semiring import counting, min_plus, sum_product
from sumfold.operators import paths, regions
from sumfold.operators.graph import Digraph


def grid(spark, w, h):
    """A street grid, both ways, of weights that differ."""
    at = lambda x, y: x * h + y
    rows = [(at(x, y), at(a, b), float((7 * x + 3 * y + 5 * a + b) % 9 + 1)) for x in range(w) for y in range(h) for a, b in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if 0 <= a < w and 0 <= b < h]
    return spark.createDataFrame(rows, "src bigint, dst bigint, weight double")


def test_regions_are_bounded_connected_and_cover_all(spark):
    edges = grid(spark, 8, 4).selectExpr("src AS row", "dst AS col")
    parts = {r["id"]: r["part"] for r in regions.regions(edges, 10).collect()}
    assert sorted(parts) == list(range(32))
    by_part = {p: {i for i, q in parts.items() if q == p} for p in set(parts.values())}
    assert max(map(len, by_part.values())) <= 10 and len(by_part) <= 12
    near = [(r["row"], r["col"]) for r in edges.collect()]
    for members in by_part.values():
        seen = {min(members)}
        while more := {b for a, b in near if a in seen and b in members} - seen:
            seen |= more
        assert seen == members


def test_distances_are_those_of_relaxation(spark):
    graph = Digraph.of(grid(spark, 12, 3))
    targets = graph.vertices.where("id IN (0, 20, 35)")
    rows = lambda df: sorted(map(tuple, df.select("id", "target", "distance").collect()))
    assert rows(paths.to_targets_by_regions(graph, targets, size=9, small=20)) == rows(paths.distances(graph, targets))


def test_numbers_and_names_and_parts_that_are_known(spark):
    r, n = np.random.default_rng(4), 40
    a = np.zeros((n, n))
    for i in range(n):
        for j in (i - 2, i - 1, i, i + 1):
            if 0 <= j < n:
                a[i, j] = r.random() / 5
    b = np.zeros((n, 2))
    b[3, 0], b[3, 1], b[20, 1] = 1.0, 2.0, 3.0
    table = lambda m, name: spark.createDataFrame([(f"l{i:02}", name(int(j)), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "row string, col string, __value double")
    parts = spark.createDataFrame([(f"l{i:02}", i // 10) for i in range(n)], "id string, part int")
    found = regions.solution(table(a, lambda j: f"l{j:02}"), table(b, str), sum_product(), small=5, parts=parts)
    got = np.zeros((n, 2))
    for row in found.collect():
        got[int(row["row"][1:]), int(row["col"])] += row["__value"]
    assert np.allclose(got, np.linalg.solve(np.eye(n) - a, b))


def test_graphs_without_separators_nothing_and_other_semirings(spark):
    n = 12
    cells = spark.createDataFrame([(i, j, float((i * j) % 7 + 1)) for i in range(n) for j in range(n) if i != j], "row bigint, col bigint, __value double")
    right = spark.createDataFrame([(0, 0, 0.0)], "row bigint, col bigint, __value double")
    graph = Digraph.of(cells.selectExpr("row AS src", "col AS dst", "__value AS weight"))
    expected = sorted((r["id"], r["distance"]) for r in paths.distances(graph, spark.range(1)).collect())
    assert sorted((r["row"], r["__value"]) for r in regions.solution(cells, right, min_plus(), size=3, small=4).collect()) == expected
    assert regions.solution(cells.limit(0), right.limit(0), min_plus()).count() == 0
    with pytest.raises(ValueError, match="dense"):
        regions.solution(cells, right, counting())


def test_regions_without_neighbours_need_no_dense_blocks(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a dense system as large as the right-hand side")

    monkeypatch.setattr(regions.blocks, "solution", refuse)
    # 200 chains of 6 labels, each to its last one, and labels that only the right-hand side has
    cells = spark.range(1000).selectExpr("concat(id div 5, '/', id % 5) AS row", "concat(id div 5, '/', id % 5 + 1) AS col", "CAST(id % 5 + 1 AS DOUBLE) AS __value")
    right = spark.range(220).selectExpr("concat(id, '/', 5) AS row", "'last' AS col", "0D AS __value")
    found = {r["row"]: r["__value"] for r in regions.solution(cells, right, min_plus(), size=8, small=50).collect()}
    assert len(found) == 1220
    assert all(v == sum(range(int(k.split("/")[1]) + 1, 6)) for k, v in found.items())
