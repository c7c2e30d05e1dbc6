"""Reduced relations, forests of many children, trees led elsewhere, and cliques."""

import itertools
import random

import pytest
from networks import DISTANCES, ROADS

from sumfold.functions.semiring import counting
from sumfold.operators import paths
from sumfold.operators.factor import Factor
from sumfold.operators.graph import Digraph
from sumfold.operators.relation import Relation, answer, expanded, join_tree, reduced
from sumfold.plans.elimination import EliminationOrder
from sumfold.plans.engine import Mode, queries, queries_with_stats
from sumfold.plans.jointree import JoinForest, Kind


def chain(spark):
    """Tables a-b, b-c, c-d and c-e of which few rows have partners."""
    r = random.Random(4)
    make = lambda *cols, n=60: spark.createDataFrame([tuple(r.randrange(12) for _ in cols) for _ in range(n)], ", ".join(f"{c} bigint" for c in cols))
    return [make("a", "b"), make("b", "c"), make("c", "d").where("c < 3"), make("c", "e").where("e = 5"), make("e", "f", n=40)]


def test_nothing_dangles_after_reduction_and_the_answer_stays(spark):
    tables = chain(spark)
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.join(t, sorted(set(whole.columns) & set(t.columns)))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for t, left in zip(tables, reduced(tables)):
        assert rows(left) == rows(t.join(whole.select(*t.columns).distinct(), t.columns, "left_semi"))
        assert left.columns == t.columns
    asked = ["a", "d", "f"]
    assert rows(answer(tables, asked, reduce=True)) == rows(answer(tables, asked)) == rows(whole.select(*asked))


def test_fewer_rows_are_joined_after_reduction(spark):
    tables = chain(spark)
    run = lambda some: queries_with_stats([Relation(t).counted() for t in some], [["a", "f"]])
    joined = lambda r: sum(s.rows for s in r.recorder.steps if s.operator == "combine")
    before, after = run(tables), run(reduced(tables))
    values = lambda r: sorted(map(tuple, r.answers[0].df.select("a", "f", "__value").collect()))
    assert values(before) == values(after) and joined(after) < joined(before)


def test_join_trees_of_tables_apart_and_of_a_circle(spark):
    assert join_tree(["ab", "bc", "xy", "cd"]) in ([(3, 1), (1, 0)], [(3, 1), (1, 0)][::-1]) and join_tree([]) == []
    circle = [spark.createDataFrame(rows, cols) for rows, cols in (([(1, 2), (1, 3)], "a bigint, b bigint"), ([(2, 4), (3, 5)], "b bigint, c bigint"), ([(4, 1), (5, 9)], "c bigint, a bigint"))]
    assert sorted(map(tuple, answer(circle, ["a", "b", "c"], reduce=True).collect())) == [(1, 2, 4)]
    nulls = [spark.createDataFrame([(1, None), (2, 3)], "a bigint, b bigint"), spark.createDataFrame([(None, 1), (3, 4)], "b bigint, c bigint")]
    assert [r.collect() for r in reduced(nulls)] == [[(2, 3)], [(3, 4)]]


def test_columns_named_like_helpers_stay(spark):
    f = Relation(spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "_nth bigint, _piece bigint")).counted()
    assert sorted(map(tuple, expanded(f).select("_nth", "_piece").collect())) == [(1, 2), (1, 2), (3, 4)]


def random_factors(spark, seed, labels):
    r = random.Random(seed)
    return [Factor.of(spark.createDataFrame([(*a, r.randrange(1, 5)) for a in itertools.product(range(3), repeat=len(x)) if r.random() < 0.8], [*x, "v"]), counting(), list(x), ["v"], unique=True) for x in labels]


@pytest.mark.parametrize("labels", [["ab", "ac", "ad", "ae"], ["ab", "bcd", "cde", "ea", "xy"], ["abc", "a", "b", "c"]])
def test_forests_of_many_children_answer_like_binary_ones(spark, labels):
    factors, asked = random_factors(spark, 3, labels), [["a"], ["b", "e"] if any("e" in x for x in labels) else ["b", "c"]]
    values = lambda f: sorted(map(tuple, f.df.select(*sorted(f.label), "__value").collect()))
    many = JoinForest.build(factors, asked, binary=False)
    many.check()
    assert max(len(n.children) for n in many.nodes) > 2
    assert [values(f) for f in queries(factors, asked, Mode.MESSAGES, binary=False)] == [values(f) for f in queries(factors, asked, Mode.BRUTE_FORCE)]


def test_four_factors_on_one_variable_take_one_exchange_each(spark):
    factors = [Factor.of(spark.range(1000).selectExpr("id AS v", f"id % {i + 2} AS w{i}", "1L AS x"), counting(), ["v", f"w{i}"], ["x"], unique=True) for i in range(4)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        (answer_,) = queries(factors, [["w0", "w1"]], Mode.MESSAGES, binary=False)
        plan = answer_.df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(v") == 4


def test_trees_led_to_another_node(spark):
    factors = random_factors(spark, 1, ["ab", "bc", "cd", "xy"])
    forest = JoinForest.build(factors, [["a"], ["d"], ["x"]])
    for node in (n.id for n in forest.nodes):
        turned = forest.redirected(node)
        turned.check()
        assert turned.nodes[-1].domain == forest.nodes[node].domain and turned.nodes[-1].parent is None
        tree = next(t for t in forest.trees() if node in t)
        assert len(turned.nodes) == len(tree) == len(forest.component(node).nodes)
        assert sorted(map(sorted, (n.domain for n in turned.nodes))) == sorted(map(sorted, (forest.nodes[i].domain for i in tree)))
        forest.component(node).check()
    assert sum(n.kind is Kind.QUERY for n in forest.component(0).nodes) == 2
    assert EliminationOrder(["ab", "bc"]).index() == {"a": [0], "b": [0, 1], "c": [1]}


def test_distances_by_cliques_of_the_triangulation(spark):
    graph = Digraph.from_adjacency(spark, ROADS)
    graphs = paths.clique_decomposition(graph)
    assert sum(g.edge_count() for g in graphs) == sum(len(x) for x in ROADS.values())
    assert paths.single_target_solved(graphs, paths.Query(tuple(range(9)), 0)) == DISTANCES
