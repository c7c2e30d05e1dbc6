"""Sketches that merge, estimates, and plans that go by them."""

from sumfold.functions.semiring import counting
from sumfold.operators.factor import Factor
from sumfold.plans.elimination import EliminationOrder
from sumfold.plans.engine import Mode, queries, queries_with_stats
from sumfold.plans.statistics import Statistics, estimates, joined_rows, merged, projected_rows, rows_of, sketches


def test_sketches_of_parts_merge_to_that_of_the_whole(spark):
    df = spark.range(20_000).selectExpr("id AS a", "id % 700 AS b", "CASE WHEN id % 3 = 0 THEN 'x' || id % 40 END AS c")
    whole = {r["variable"]: (r["rows"], r["distinct"]) for r in estimates(sketches(df, ["a", "b", "c"])).collect()}
    parts = [sketches(df.where(f"a % 4 = {i}"), ["a", "b", "c"]) for i in range(4)]
    put = {r["variable"]: (r["rows"], r["distinct"]) for r in estimates(merged(parts)).collect()}
    assert {v: n for v, (n, _) in put.items()} == {v: n for v, (n, _) in whole.items()} == dict.fromkeys("abc", 20_000)
    for v, exact in (("a", 20_000), ("b", 700), ("c", 40)):
        assert abs(whole[v][1] / exact - 1) < 0.06 and abs(put[v][1] / whole[v][1] - 1) < 0.03
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert estimates(sketches(none, ["a", "b"])).collect() == [("a", 0, 0), ("b", 0, 0)] and sketches(none, []).count() == 0
    assert rows_of(spark, {"df": df, "none": none}) == {"df": 20_000, "none": 0} and rows_of(spark, {}) == {}


def test_estimates_of_joins():
    frames = {"k": 10, "a": 100, "b": 1000}
    assert joined_rows([("ka", 100.0), ("kb", 1000.0)], frames) == 100 * 1000 / 10
    assert joined_rows([("ka", 100.0), ("kb", 1000.0), ("k", 10.0)], frames) == 100 * 1000 / 10
    assert joined_rows([("a", 100.0), ("b", 1000.0)], frames) == 100_000
    assert projected_rows("k", 500.0, frames) == 10 and projected_rows("b", 500.0, frames) == 500 and projected_rows("", 5.0, frames) == 1
    assert joined_rows([("k", 0.0)], frames) == 1


def around(spark, n=1500, few=3):
    """A circle h - x - k - y - h: x and y are keys, h has few values."""
    c = counting()
    make = lambda a, b, expr: Factor.of(spark.range(n).selectExpr(f"id AS {a}", f"{expr} AS {b}", "1L AS v"), c, [a, b], ["v"])
    return [make("x", "h", f"id % {few}"), make("y", "h", f"id % {few}"), make("x", "k", "id % 20"), make("y", "m", "id % 7")]


def test_a_skewed_case_is_planned_better(spark):
    factors = around(spark)
    known = Statistics.of(factors)
    assert [f.rows for f in known.factors] == [1500.0] * 4 and abs(known.frames["x"] / 1500 - 1) < 0.05 and known.frames["h"] == 3
    by_labels = list(EliminationOrder([f.label for f in factors], ["k", "m"]))
    by_rows = list(EliminationOrder([f.label for f in known.factors], ["k", "m"], known.frames, [f.rows for f in known.factors]))
    # by labels alone, h goes first: every x with every y of a value
    assert by_labels[0] == "h" and by_rows[-1] == "h"
    blind = queries_with_stats(factors, [["k", "m"]])
    seeing = queries_with_stats(known.factors, [["k", "m"]], frames=known.frames, sized=True)
    values = lambda run: sorted(map(tuple, run.answers[0].df.select("k", "m", "__value").collect()))
    assert values(blind) == values(seeing)
    most = lambda run: max(s.rows for s in run.recorder.steps)
    assert most(blind) == 3 * 500 * 500 and most(seeing) == 1500


def test_every_mode_answers_alike_with_statistics(spark):
    known = Statistics.of(around(spark, 60))
    values = lambda f: sorted(map(tuple, f.df.select(*sorted(f.label), "__value").collect()))
    asked = [["k", "m"], ["h"], ["x"]]
    expected = [values(f) for f in queries(known.factors, asked, Mode.BRUTE_FORCE)]
    for mode in Mode:
        assert [values(f) for f in queries(known.factors, asked, mode, frames=known.frames, sized=True)] == expected
    assert Statistics.of([Factor.identity(counting())]).frames == {}
