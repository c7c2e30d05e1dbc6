import itertools
import math
import random

import pytest

from networks import ASKED, BOTH, TABLES, net_text
from sumfold.functions.semiring import counting, min_plus, sum_product
from sumfold.operators.bayes import Conditional, probabilities
from sumfold.operators.factor import COUNTERS, Factor, combine_all
from sumfold.operators.relation import Relation, answer
from sumfold.plans.engine import EmptyQuery, Mode, UnanswerableQuery, queries, query
from sumfold.sources import net

S = sum_product()


def rows(f):
    return {tuple(r[v] for v in sorted(f.label)): r["__value"] for r in f.df.collect()}


def clinic(spark):
    return [Factor.from_lists(spark, S, [(v, (False, True)) for v in vs], x) for vs, x in TABLES]


def test_combine_and_project(spark):
    a = Factor.from_lists(spark, S, [("x", (0, 1)), ("y", (0, 1))], [1.0, 2.0, 3.0, 4.0])
    b = Factor.from_lists(spark, S, [("y", (0, 1)), ("z", (0, 1))], [5.0, 6.0, 7.0, 8.0])
    c = a.combine(b)
    assert c.label == {"x", "y", "z"} and rows(c)[1, 0, 1] == 18.0
    assert rows(c.eliminate(["y", "z"])) == {(0,): 11 + 30, (1,): 33 + 60}
    assert c.project(()).df.first()["__value"] == 134.0
    assert a.project(["x", "y", "w"]) is a
    assert c.frame_length("z") == 2 and c.is_total()


def test_lists_must_fit(spark):
    with pytest.raises(ValueError):
        Factor.from_lists(spark, S, [("x", (0, 1))], [1.0])
    with pytest.raises(ValueError):
        Factor.from_lists(spark, S, [("x", (0, 1)), ("x", (0, 1))], [1.0] * 4)


def test_identity_rename_values_and_lookup(spark):
    a = Factor.from_lists(spark, S, [("x", ("p", "q"))], [1.0, 2.0])
    e = Factor.identity(S)
    assert a.combine(e) is a and e.combine(a) is a and e.project(["x"]) is e
    assert a.rename({"x": "y"}).label == {"y"}
    assert a.map_values("x", {"p": "z", "q": "a"}).lookup({"x": "a"}) == 2.0
    assert a.map_payload(lambda p: [p[0] * 10]).lookup({"x": "p"}) == 10.0
    with pytest.raises(KeyError):
        a.lookup({"x": "unknown"})
    with pytest.raises(ValueError):
        e.lookup({})
    with pytest.raises(ValueError):
        a.combine(Factor.from_lists(spark, S, [("y", (0,))], [1.0])).rename({"x": "y"})
    sparse = Factor.of(spark.createDataFrame([("p", 1, 2.0), ("q", 2, 3.0)], "x string, y int, v double"), S, ["x", "y"], ["v"])
    assert sparse.lookup({"x": "p", "y": 2}) == 0.0


def test_empty_projection_of_no_rows_is_zero(spark):
    none = Factor.of(spark.createDataFrame([], "x int, v double"), min_plus(), ["x"], ["v"])
    assert none.project(()).df.first()["__value"] == math.inf


def test_counters(spark):
    a = Factor.from_lists(spark, S, [("x", (0, 1))], [1.0, 2.0])
    COUNTERS.reset()
    a.combine(Factor.identity(S)).project(["x"])
    assert (COUNTERS.combines, COUNTERS.projects) == (0, 0)
    a.combine(a).project(())
    assert (COUNTERS.combines, COUNTERS.projects) == (1, 1)


@pytest.mark.parametrize("mode", [Mode.FUSION, Mode.MESSAGES])
def test_clinic(spark, mode):
    asked = [Conditional.of(list(a.items()), list(b.items())) for a, b, _ in ASKED[:6]]
    found = probabilities(clinic(spark), asked, mode)
    assert found == pytest.approx([p for *_, p in ASKED[:6]], abs=1e-7)


def test_clinic_more_questions(spark):
    asked = [Conditional(a, b) for a, b, _ in ASKED[6:]]
    assert probabilities(clinic(spark), asked) == pytest.approx([p for *_, p in ASKED[6:]], abs=1e-7)


def test_clinic_with_a_further_factor(spark):
    variables, x = BOTH
    more = Factor.from_lists(spark, S, [(v, (False, True)) for v in variables], x)
    assert probabilities([*clinic(spark), more], [Conditional({"both": True}, {"asia": True})]) == pytest.approx([0.09882268], abs=1e-7)


def test_clinic_file(spark, tmp_path):
    (tmp_path / "clinic.net").write_text(net_text())
    network = net.read(spark, str(tmp_path / "clinic.net"))
    assert network.frames()["tub"] == 2
    word = {True: "yes", False: "no"}
    asked = [Conditional({k: word[v] for k, v in a.items()}, {k: word[v] for k, v in b.items()}) for a, b, _ in ASKED[:2]]
    assert probabilities(network.factors(spark), asked) == pytest.approx([p for *_, p in ASKED[:2]], abs=1e-7)
    with pytest.raises(net.FormatError):
        net.parse("net { } node x { states = ( }")
    with pytest.raises(net.FormatError):
        net.parse('net { } node x { states = ( "a" ); } potential ( x ) { data = ( 1 ) ; }')


def test_impossible_condition(spark):
    f = Factor.from_lists(spark, S, [("x", (0, 1)), ("y", (0, 1))], [0.0, 0.0, 0.5, 0.5])
    assert probabilities([f], [Conditional({"y": 1}, {"x": 0})]) == [0.0]
    with pytest.raises(ValueError):
        Conditional.of([("x", 0), ("x", 1)])


def test_errors(spark):
    f = Factor.from_lists(spark, S, [("x", (0, 1))], [1.0, 2.0])
    with pytest.raises(UnanswerableQuery):
        query([f], ["y"])
    with pytest.raises(EmptyQuery):
        query([f], [])
    with pytest.raises(UnanswerableQuery):
        queries([f], [["y"], []])


@pytest.mark.parametrize("seed", range(4))
def test_modes_agree_on_random_factors(spark, seed):
    r = random.Random(seed)
    variables = "abcdef"
    factors, tables = [], []
    for _ in range(r.randint(2, 5)):
        label = r.sample(variables, r.randint(1, 3))
        values = [float(r.randint(0, 5)) for _ in range(2 ** len(label))]
        factors.append(Factor.from_lists(spark, S, [(v, (0, 1)) for v in label], values))
        tables.append((label, dict(zip(itertools.product((0, 1), repeat=len(label)), values))))
    used = sorted(set().union(*[t[0] for t in tables]))
    domains = [r.sample(used, r.randint(1, min(2, len(used)))) for _ in range(2)]
    expected = []
    for d in domains:
        out = {}
        for a in itertools.product((0, 1), repeat=len(used)):
            at = dict(zip(used, a))
            key = tuple(at[v] for v in sorted(d))
            out[key] = out.get(key, 0.0) + math.prod(t[tuple(at[v] for v in label)] for label, t in tables)
        expected.append(out)
    for mode in Mode:
        for f, e in zip(queries(factors, domains, mode), expected):
            found = rows(f)
            assert {k: found.get(k, 0.0) for k in e} == pytest.approx(e)


def test_messages_share_work(spark):
    chain = [Factor.from_lists(spark, S, [(f"v{i}", (0, 1)), (f"v{i + 1}", (0, 1))], [1.0, 2.0, 3.0, 4.0]) for i in range(6)]
    domains = [[f"v{i}"] for i in range(5)]
    COUNTERS.reset()
    queries(chain, domains, Mode.FUSION)
    apart = COUNTERS.combines + COUNTERS.projects
    COUNTERS.reset()
    queries(chain, domains, Mode.MESSAGES)
    assert COUNTERS.combines + COUNTERS.projects < apart


def test_axioms(spark):
    a = Factor.from_lists(spark, S, [("x", (0, 1)), ("y", (0, 1))], [1.0, 2.0, 3.0, 4.0])
    b = Factor.from_lists(spark, S, [("y", (0, 1)), ("z", (0, 1))], [5.0, 6.0, 7.0, 8.0])
    assert rows(a.combine(b)) == rows(b.combine(a))
    assert rows(a.combine(b).project(["x", "y"]).project(["x"])) == rows(a.combine(b).project(["x"]))
    assert rows(a.combine(b).project(["x", "y"])) == rows(a.combine(b.project(["y"])))
    assert rows(combine_all([a, b, b])) == rows(a.combine(b.combine(b)))


def test_relations(spark):
    t1 = Relation.of(spark, ["Name", "Age", "Birthplace"], [("Ben", "25", "China"), ("Julia", "28", "Australia")])
    t2 = Relation.of(spark, ["Name", "ID"], [("Ben", "1"), ("David", "2"), ("Julia", "3")])
    assert sorted(map(tuple, answer([t1.df, t2.df], ["ID", "Age"]).collect())) == [("25", "1"), ("28", "3")]
    both = t1.combine(t2)
    assert both.df.columns == ["Age", "Birthplace", "ID", "Name"] and both.df.count() == 2
    assert t2.combine(Relation.of(spark, ["K"], [("a",), ("b",)])).df.count() == 6
    twice = Relation.of(spark, ["A", "B"], [("x", "1"), ("x", "2")]).project(["A"])
    assert twice.df.count() == 2
    assert Relation().combine(t1) is t1 and Relation().project(["x"]).is_identity
    assert answer([t1.df, twice.df], ["A", "Name"]).count() == 4
    with pytest.raises(ValueError):
        Relation.of(spark, ["A"], [("x", "y")])


def test_counting_bag_keeps_duplicates(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "a string, b int")
    f = Factor.of(a.withColumn("__value", a.b * 0 + 1), counting(), ["a", "b"])
    assert rows(f) == {("x", 1): 2, ("y", 2): 1}
