"""Best assignments and shortest ways against every assignment and way."""

import itertools
import random

import pytest
from networks import DISTANCES, ROADS

from sumfold.functions.semiring import counting, max_plus, max_product, min_plus
from sumfold.operators import paths
from sumfold.operators.factor import Factor
from sumfold.operators.graph import Digraph
from sumfold.plans.witnesses import witnesses

LABELS = [("a", "b"), ("b", "c"), ("c", "d", "a"), ("d", "e"), ("x", "y")]


def tables(seed):
    r = random.Random(seed)
    return [{a: float(r.randrange(1, 9)) for a in itertools.product(range(3), repeat=len(label)) if r.random() < 0.8} for label in LABELS]


@pytest.mark.parametrize("semiring", [min_plus(), max_plus(), max_product()])
def test_best_assignments(spark, semiring):
    known = tables(5)
    factors = [Factor.of(spark.createDataFrame([(*a, v) for a, v in t.items()], [*label, "v"]), semiring, list(label), ["v"], unique=True) for label, t in zip(LABELS, known)]
    names = sorted(set().union(*LABELS))
    value = lambda at: [t.get(tuple(at[v] for v in label)) for label, t in zip(LABELS, known)]
    total = (lambda xs: __import__("math").prod(xs)) if semiring.name == "max_product" else sum
    every = {}
    for a in itertools.product(range(3), repeat=len(names)):
        at = dict(zip(names, a))
        if None not in value(at):
            every[a] = total(value(at))
    pick = min if semiring.name == "min_plus" else max
    for domain in (["a", "e"], ["b"], ["x", "c"]):
        best = {}
        for a, v in every.items():
            key = tuple(a[names.index(d)] for d in domain)
            best[key] = pick(v, best.get(key, v))
        rows = witnesses(factors, domain).collect()
        assert len(rows) == len(best)
        for r in rows:
            assignment = tuple(r[v] for v in names)
            assert r["__value"] == every[assignment] == best[tuple(r[d] for d in domain)]


def test_of_equal_choices_the_least_is_taken(spark):
    f = Factor.of(spark.createDataFrame([(k, v, 2.0) for k in range(3) for v in (7, 4, 9)], "k bigint, v bigint, w double"), max_product(), ["k", "v"], ["w"], unique=True)
    assert sorted((r["k"], r["v"], r["__value"]) for r in witnesses([f], ["k"]).collect()) == [(k, 4, 2.0) for k in range(3)]
    assert [(r["k"], r["v"]) for r in witnesses([f], ["k"], evidence={"v": 9}).orderBy("k").collect()] == [(k, 9) for k in range(3)]
    with pytest.raises(ValueError, match="choose"):
        witnesses([Factor.of(spark.range(2).selectExpr("id AS k", "id AS v", "1L AS w"), counting(), ["k", "v"], ["w"])], ["k"])


def test_routes_are_ways_of_the_least_distance(spark):
    graph = Digraph.from_adjacency(spark, ROADS)
    weight = {(s, d): w for s, arcs in ROADS.items() for d, w in arcs}
    rows = paths.routes(graph, graph.vertices.where("id IN (0, 4)")).collect()
    assert len(rows) == 18
    for r in rows:
        assert r["route"][0] == r["id"] and r["route"][-1] == r["target"] and r["hops"] == len(r["route"]) - 1
        assert sum(weight[e] for e in itertools.pairwise(r["route"])) == r["distance"]
        assert r["target"] == 4 or r["distance"] == DISTANCES[r["id"]]


def test_routes_over_loops_of_no_weight_come_to_an_end(spark):
    edges = spark.createDataFrame([(0, 1, 0.0), (1, 0, 0.0), (1, 2, 0.0), (2, 2, 0.0), (3, 1, 1.0), (3, 4, 0.5), (4, 2, 0.5), (5, 6, 1.0)], "src bigint, dst bigint, weight double")
    found = {r["id"]: (r["distance"], r["route"]) for r in paths.routes(Digraph.of(edges), spark.range(2, 3)).collect()}
    # of two ways of one length and as many edges the one with the smaller next vertex
    assert found == {0: (0.0, [0, 1, 2]), 1: (0.0, [1, 2]), 2: (0.0, [2]), 3: (1.0, [3, 1, 2]), 4: (0.5, [4, 2])}
    with pytest.raises(ValueError, match="negative"):
        paths.routes(Digraph.of(edges.selectExpr("src", "dst", "-weight AS weight")), spark.range(1))
