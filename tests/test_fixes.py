"""Defined cases of relations, stars, components, sums, systems and positions."""

import pytest
from pyspark.sql import functions as F

from sumfold import algebra_queries
from sumfold.functions import radix
from sumfold.functions.semiring import counting, min_plus, sum_product
from sumfold.operators import paths
from sumfold.operators.closed import ClosedSystem
from sumfold.operators.factor import Factor
from sumfold.operators.graph import Digraph
from sumfold.operators.matrix import Matrix
from sumfold.operators.relation import answer, expanded
from sumfold.plans.engine import UnanswerableQuery, solve


def test_bags_with_an_empty_component(spark):
    a = spark.createDataFrame([("x",), ("y",)], "a string")
    assert answer([a, spark.createDataFrame([], "b string")], ["a"]).count() == 0
    bag = Factor(counting(), spark.createDataFrame([("x", 70_000), ("y", 0), ("z", 1)], "a string, __value bigint"), frozenset("a"))
    assert {r["a"]: r["count"] for r in expanded(bag).groupBy("a").count().collect()} == {"x": 70_000, "z": 1}


def test_star_with_negative_cycle(spark):
    inf = float("inf")
    m = Matrix.from_cells(spark, min_plus(), [(("a", "b"), -2.0), (("b", "a"), 1.0), (("c", "a"), 3.0)], default=inf)
    star = {(r["row"], r["col"]): r["__value"] for r in m.to_square().quasi_inverse(spark).df.collect()}
    assert star == {(x, y): -inf for x in "abc" for y in "ab"} | {("c", "c"): 0.0}
    fine = Matrix.from_cells(spark, min_plus(), [(("a", "b"), -2.0), (("b", "a"), 2.0)], default=inf)
    assert {(r["row"], r["col"]): r["__value"] for r in fine.quasi_inverse(spark).df.collect()} == {("a", "a"): 0, ("a", "b"): -2, ("b", "a"): 2, ("b", "b"): 0}


def test_components_of_strings(spark):
    edges = [("b", "a"), ("c", "b"), ("x", "y"), ("z", "z")]
    graph = Digraph.of(spark.createDataFrame([(*e, 1.0) for e in edges], "src string, dst string, weight double"), spark.createDataFrame([("w",)], "id string"))
    assert {r["id"]: r["component"] for r in graph.components().collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z", "w": "w"}
    assert not graph.is_connected()


def test_no_systems(spark):
    with pytest.raises(UnanswerableQuery):
        solve([])
    with pytest.raises(UnanswerableQuery):
        solve([ClosedSystem.identity(min_plus())])


def test_sums_that_are_null_stay_null(spark):
    s = sum_product("decimal(38,0)")
    df = spark.createDataFrame([("x", None)], "a string, v decimal(38,0)")
    assert Factor.of(df, s, ["a"], ["v"]).project(()).df.first()[0] is None
    assert Factor.of(df.limit(0), s, ["a"], ["v"]).project(()).df.first()[0] == 0


def test_declared_keys_can_be_checked(spark):
    twice = spark.createDataFrame([("x", 1), ("x", 2)], "a string, v int")
    assert Factor.of(twice, counting(), ["a"], ["v"]).checked().df.first()["__value"] == 3
    with pytest.raises(ValueError, match="two payloads"):
        Factor.of(twice, counting(), ["a"], ["v"], unique=True).checked()


def test_products_and_form_of_matrices(spark):
    m = Matrix.from_rows(spark, counting(), [[1, 2], [3, 4]])
    assert Matrix.multiplied([]) is None and Matrix.multiplied([m, m, m]).find(1, 0) == 81
    assert m.is_well_formed()
    assert not Matrix(counting(), m.df.union(m.df), m.rows, m.cols).is_well_formed()
    assert not Matrix(counting(), m.df, frozenset([0]), m.cols).is_well_formed()


def test_positions(spark):
    sizes = [2, 3, 4]
    assert radix.permutations(sizes) == 24 and radix.factors(sizes) == [12, 4, 1]
    rows = radix.assignments(spark, [("a", ["x", "y"]), ("b", [1, 2, 3]), ("c", list("pqrs"))])
    row = rows.where("a = 'y' AND b = 2 AND c = 's'").first()
    assert row["position"] == 12 + 4 + 3
    back = rows.select("position", radix.index(radix.digits(F.col("position"), sizes), sizes).alias("again"))
    assert back.where("position <> again").isEmpty()
    with pytest.raises(ValueError):
        radix.index([F.lit(1)], sizes)
    numbers = radix.numbered(spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "v string"), "v")
    assert {r["v"]: r["number"] for r in numbers.collect()} == {"a": 0, "b": 1, "c": 2}


def test_distances_over_many_rounds(spark):
    n = 40
    edges = [(i, i + 1, 1.0) for i in range(n)] + [(0, n, 100.0), (n, 0, 2.0)]
    graph = Digraph.of(spark.createDataFrame(edges, "src bigint, dst bigint, weight double").coalesce(1))
    found = {r["id"]: r["distance"] for r in paths.distances(graph, spark.createDataFrame([(n,)], "id bigint")).collect()}
    assert found == {i: float(n - i) for i in range(n + 1)}
    assert paths.single_target_of(Digraph.of(graph.edges.where("src > 37")), paths.Query((38, 39), n)) == [2.0, 1.0]


def test_every_query_has_its_sql():
    assert set(algebra_queries.ORACLES) == set(algebra_queries.QUERIES)


def test_neighbours_as_pairs_and_as_lists(spark):
    from sumfold.operators.graph import Digraph

    edges = spark.createDataFrame([(0, i, 1.0) for i in range(5)] + [(3, 0, 2.0), (4, 3, 1.0), (4, 3, 2.0)], "src bigint, dst bigint, weight double")
    graph = Digraph.of(edges)
    pairs = sorted(map(tuple, graph.neighbour_pairs().collect()))
    assert pairs == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (2, 0), (3, 0), (3, 4), (4, 0), (4, 3)]
    assert {r["id"]: r["neighbours"] for r in graph.neighbours().collect()} == {0: [1, 2, 3, 4], 1: [0], 2: [0], 3: [0, 4], 4: [0, 3]}
