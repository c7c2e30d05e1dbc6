"""Measured runs, and messages that are computed once and at the same time."""

import pytest
from networks import DISTANCES, ROADS

from sumfold.functions.semiring import counting
from sumfold.operators.factor import Factor
from sumfold.plans.engine import Messages, Mode, queries, queries_with_stats, solve_with_stats


def factors(spark):
    rows = lambda df: spark.createDataFrame(df, ", ".join(f"{c} bigint" for c in "pq"[: len(df[0])]))
    c = counting()
    out = []
    for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("b", "d"), ("d", "e"), ("x", "y")]):
        df = rows([(k, (k * (i + 2)) % 5) for k in range(8)]).toDF(a, b)
        out.append(Factor.of(df.selectExpr(a, b, "1L AS v"), c, [a, b], ["v"]))
    return out


def values(f):
    return sorted(map(tuple, f.df.select(*sorted(f.label), "__value").collect()))


@pytest.mark.parametrize("mode", list(Mode))
def test_measured_answers_are_the_answers(spark, mode):
    fs, asked = factors(spark), [["a"], ["c", "e"], ["y"]]
    run = queries_with_stats(fs, asked, mode)
    assert [values(f) for f in run.answers] == [values(f) for f in queries(fs, asked, Mode.BRUTE_FORCE)]
    steps = run.recorder.steps
    assert sum(s.operator == "combine" for s in steps) == run.combines and sum(s.operator == "project" for s in steps) == run.projects
    assert all(s.rows is not None for s in steps)
    # what a factor puts out is what it has, and no operator's rows come from nowhere
    by_label = {f.label: f.df.count() for f in fs}
    assert all(s.rows == by_label[s.label] for s in steps if s.operator == "factor")
    for s in steps:
        into = run.recorder.rows_in(s)
        if s.operator == "project":
            assert s.rows <= into[0] or not s.label
    table = run.recorder.table(spark).where("operator = 'project'").selectExpr("rows_out", "rows_in[0] AS i").collect()
    assert len(table) == run.projects


def test_rows_of_each_operator(spark):
    left = Factor.of(spark.createDataFrame([(i % 3, i, 1) for i in range(30)], "k bigint, l bigint, v bigint"), counting(), ["k", "l"], ["v"], unique=True)
    right = Factor.of(spark.createDataFrame([(i % 2, i, 1) for i in range(10)], "k bigint, r bigint, v bigint"), counting(), ["k", "r"], ["v"], unique=True)
    run = queries_with_stats([left, right], [["l", "r"]], Mode.BRUTE_FORCE)
    got = {(s.operator, tuple(sorted(s.label))): (run.recorder.rows_in(s), s.rows) for s in run.recorder.steps}
    assert got["combine", ("k", "l", "r")] == ([30, 10], 100) and got["project", ("l", "r")] == ([100], 100)


def test_each_message_is_computed_once_and_some_at_the_same_time(spark):
    fs, asked = factors(spark), [["a"], ["c"], ["e"], ["a", "d"]]
    run = queries_with_stats(fs, asked, Mode.MESSAGES, threads=4)
    names = [s.name for s in run.recorder.sent if s.name.startswith("message")]
    assert len(names) == len(set(names)) > 4
    assert run.recorder.overlapped()
    messages = Messages(fs, asked)
    messages.compute(4)
    before = dict(messages.sent)
    messages.answers()
    assert messages.sent == before  # answers compute no further message
    assert run.forest.tree_widths and run.forest.vertices


def test_an_error_in_a_message_comes_out(spark):
    bad = Factor.of(spark.range(3).selectExpr("id AS a", "id AS z", "raise_error('broken') AS v"), counting(), ["a", "z"], ["v"])
    with pytest.raises(Exception, match="broken"):
        queries([*factors(spark), bad], [["a"], ["c"]], Mode.MESSAGES, threads=3)


def test_no_question_has_no_answer_in_every_mode(spark):
    neutral = [Factor.identity(counting())]
    for mode in Mode:
        assert queries(neutral, [], mode) == [] and queries_with_stats(neutral, [], mode).answers == []


def test_solutions_come_with_measures(spark):
    from sumfold.operators import paths
    from sumfold.operators.graph import Digraph

    graph = Digraph.from_adjacency(spark, ROADS)
    run = solve_with_stats(paths._systems([Digraph.of(graph.edges.where(c)) for c in ("src < 4", "src >= 4")], 0))
    assert {r["row"]: r["__value"] for r in run.answers[0].collect()} == dict(enumerate(DISTANCES))
    assert run.combines > 0 and run.forest.valuations == [2]


def test_a_stream_is_read_to_its_end(spark, tmp_path):
    from sumfold.streaming import factors as stream

    rows = [(f"2024-01-01 {h:02}:{m:02}:00", k) for h in (3, 4, 9) for m in (0, 59) for k in "ab"]
    for i in range(3):
        spark.createDataFrame(rows[i::3], "ts string, k string").selectExpr("CAST(ts AS timestamp) AS ts", "k", "1 AS one").write.parquet(f"{tmp_path}/in/{i}")
    schema = "ts timestamp, k string, one int"
    counted = lambda path: stream.windowed_factor(spark.readStream.schema(schema).parquet(path), counting(), ["k"], "one")
    found = stream.run(counted(f"{tmp_path}/in/*"), f"{tmp_path}/out")
    assert sorted((r["window_start"].hour, r["k"], r["__value"]) for r in found.collect()) == [(h, k, 2) for h in (3, 4, 9) for k in "ab"]
    # again, from where it was: nothing is read twice
    assert stream.run(counted(f"{tmp_path}/in/*"), f"{tmp_path}/out").count() == 0
    (tmp_path / "none").mkdir()
    assert stream.run(counted(f"{tmp_path}/none"), f"{tmp_path}/out2").count() == 0


def test_assignments_are_put_together_and_cut(spark):
    from sumfold.operators.closed import combined_assignments, empty_assignment, projected_assignment

    x = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, None)], "row bigint, v double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(combined_assignments(empty_assignment(x), x)) == [(1, 2.0), (2, 3.0), (3, None)]
    assert rows(projected_assignment(x, spark.range(2, 9).selectExpr("id AS row"))) == [(2, 3.0), (3, None)]
    with pytest.raises(Exception, match="two values of 1"):
        combined_assignments(x, x.where("row = 1")).collect()
